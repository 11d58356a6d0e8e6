"""Write-backs of the queue, token rotation, and streams with late data, against plain loops."""

import datetime as dt
import os
import random
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marlstone.operators import graph, jobs, resolution
from marlstone.plans import registry
from marlstone.streaming import ratelimit, sessions

DAY = dt.datetime(2024, 5, 1)


def write_events(folder, files):
    for i, minutes in enumerate(files):
        rows = [{"user_id": u, "ts": DAY + dt.timedelta(minutes=m)} for u, m in minutes]
        pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([("user_id", pa.int64()), ("ts", pa.timestamp("us"))])), folder / f"{i}.parquet")


def starts(window_rows):
    return {(r.user_id, r.window_start - int(DAY.replace(tzinfo=dt.UTC).timestamp())): r.n for r in window_rows.collect()}


def test_sliding_windows_over_several_batches(spark, tmp_path):
    drawn = random.Random(2)
    files = [[(drawn.randrange(3), 10 * i + drawn.randrange(40)) for _ in range(20)] for i in range(3)]
    write_events(tmp_path, files)
    found = starts(ratelimit.replay_counts(spark, str(tmp_path), 3600, 900, maxFilesPerTrigger="1"))
    expected = Counter((u, (m // 15 - k) * 900) for f in files for u, m in f for k in range(4))
    assert found == dict(expected)


def test_late_events_are_not_counted(spark, tmp_path):
    """Files are batches in the order of their times; the third holds an event two hours behind the watermark's day."""
    write_events(tmp_path, [[(1, 720)], [(1, 725), (1, 700)], [(1, 540), (1, 726)]])
    for i in range(3):
        os.utime(tmp_path / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    found = starts(ratelimit.replay_counts(spark, str(tmp_path), 900, maxFilesPerTrigger="1"))
    assert found == {(1, 43200): 3, (1, 41400): 1}


def test_sweep_keeps_the_cutoff_itself(spark):
    buckets = spark.createDataFrame([(1, 0), (1, 900), (2, 1800)], "user_id long, window_start long")
    assert sorted(r.window_start for r in ratelimit.swept(buckets, 900).collect()) == [900, 1800]


def test_completed_jobs(spark):
    rows = [(1, "RUNNING", None, 0), (2, "RUNNING", None, 0), (3, "RUNNING", "rate_limited", 3), (4, "RUNNING", None, None), (5, "QUEUED", "rate_limited", 1), (6, "RUNNING", None, 2)]
    table = spark.createDataFrame([(j, 0, s, k, a, None) for j, s, k, a in rows], "job_id long, source_id long, status string, failure_kind string, attempt_count int, started_at timestamp")
    told = spark.createDataFrame([(1, "INDEXED", None), (2, "FAILED", "rate_limited"), (3, "FAILED", "rate_limited"), (4, "FAILED", "checksum_mismatch"), (6, "FAILED", None)], "job_id long, outcome string, kind string")
    found = {r.job_id: (r.status, r.failure_kind, r.attempt_count, r.wait) for r in jobs.completed(table, told).collect()}
    assert found == {
        1: ("INDEXED", None, 0, None), 2: ("QUEUED", "rate_limited", 1, 600), 3: ("DEAD_LETTER", "rate_limited", 4, None),
        4: ("FAILED", "checksum_mismatch", 1, None), 5: ("QUEUED", "rate_limited", 1, None), 6: ("FAILED", None, 3, None),
    }


def test_cutover_and_soft_delete(spark):
    versions = spark.createDataFrame([(1, "a", "INDEXED"), (2, "a", "PROCESSING"), (3, "b", "INDEXED"), (4, "c", "PROCESSING"), (5, "d", "STALE")], "version_id long, source_id string, status string")
    sources = spark.createDataFrame([("a", 1, True), ("b", 3, True), ("c", None, True), ("d", 5, False)], "source_id string, current_version long, is_active boolean")
    ready = spark.createDataFrame([("a", 2), ("c", 4), ("d", 5)], "source_id string, new_version long")
    left, moved = jobs.cutover(versions, sources, ready)
    assert {r.version_id: r.status for r in left.collect()} == {1: "STALE", 2: "INDEXED", 3: "INDEXED", 4: "INDEXED", 5: "INDEXED"}
    assert {r.source_id: r.current_version for r in moved.collect()} == {"a": 2, "b": 3, "c": 4, "d": 5}
    gone = jobs.soft_deleted(moved, spark.createDataFrame([("a",), ("a",), ("z",)], "source_id string"))
    assert {r.source_id: r.is_active for r in gone.collect()} == {"a": False, "b": True, "c": True, "d": False}


def test_token_rotation_is_the_loop_over_a_users_events(spark):
    drawn = random.Random(7)
    events = [(i, drawn.randrange(4), DAY + dt.timedelta(minutes=drawn.randrange(200)), drawn.choice(["login", "use", "use", "use", "spent"])) for i in range(300)]
    state, expected = {}, {}
    for i, user, _, kind in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        if kind == "login":
            state[user], expected[i] = "live", "issued"
        elif user not in state:
            expected[i] = "unknown"
        else:
            state[user] = "revoked" if kind == "spent" else state[user]
            expected[i] = "reuse" if state[user] == "revoked" else "rotated"
    df = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, kind string")
    found = jobs.refresh_outcomes(df, F.col("kind") == "login", F.col("kind") == "spent")
    assert {r.event_id: r.outcome for r in found.collect()} == expected
    assert set(expected.values()) == {"issued", "rotated", "reuse"} | ({"unknown"} & set(expected.values()))


def test_ticket_dialogue_as_a_stream(spark, tmp_path):
    """The stream, in batches of one file, ends each dialogue where the batch replay of the same turns does."""
    said = {1: ["it broke", "me@x.org"], 2: ["help", "no", "no", "no"], 3: ["help", "never mind"], 4: [None]}
    rows = [(c, t, text) for c, texts in said.items() for t, text in enumerate(texts)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for turn in range(4):
        now = [{"conv_id": c, "turn": t, "text": x} for c, t, x in rows if t == turn]
        pq.write_table(pa.Table.from_pylist(now, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("text", pa.string())])), source / f"{turn}.parquet")
        run = sessions.stream(spark.readStream.schema("conv_id long, turn long, text string").parquet(str(source))).writeStream.outputMode("update")
        write = lambda batch, n: batch.withColumn("at", F.lit(n)).write.mode("append").parquet(out)
        run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("conv_id").agg(F.max_by("stage", "at").alias("stage"), F.sum("turns").alias("turns"))
    replayed = sessions.replay(spark, spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    assert {r.conv_id: (r.stage, r.turns) for r in last.collect()} == {r.conv_id: (r.stage, r.turns) for r in replayed.collect()} == {1: ("ticket", 2), 2: ("abandoned", 4), 3: ("cancelled", 2), 4: ("email", 1)}


def test_idle_dialogues_expire(spark, tmp_path):
    """Over restarts a dialogue goes on; one that was idle too long ends, and its next turn begins anew."""
    source, state, out = tmp_path / "turns", str(tmp_path / "state"), str(tmp_path / "out")
    source.mkdir()

    def batch(n, turns, idle_ms):
        rows = [{"conv_id": c, "turn": n, "text": t} for c, t in turns]
        pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("text", pa.string())])), source / f"{n}.parquet")
        run = sessions.stream(spark.readStream.schema("conv_id long, turn long, text string").parquet(str(source)), idle_ms).writeStream.outputMode("update")
        write = lambda rows, _: rows.withColumn("at", F.lit(n)).write.mode("append").parquet(out)
        run.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        return sorted((r.conv_id, r.stage, r.turns) for r in spark.read.parquet(out).where(f"at = {n}").collect())

    assert batch(0, [(1, "my screen is broken"), (2, "help")], 3_600_000) == [(1, "email", 1), (2, "email", 1)]
    assert batch(1, [(1, "no address"), (2, "ann@example.com")], 1) == [(1, "email", 1), (2, "ticket", 1)]  # after a restart
    time.sleep(0.05)
    found = batch(2, [(3, "new")], 3_600_000)
    assert {(1, "expired", 0), (2, "expired", 0), (3, "email", 1)} <= set(found)
    assert (1, "email", 1) in batch(3, [(1, "ann@example.com")], 3_600_000)  # a reason again, not an address


def test_collapse_statistics(spark):
    rows = spark.createDataFrame([("a", "one large green bolt"), ("a", "one large green bolt."), ("a", "steel"), ("b", "x"), ("b", "x"), ("c", "y"), (None, "z"), ("c", None)], "group string, value string")
    found = resolution.collapse_statistics(rows, resolution.collapse_near_duplicates(rows)).first()
    assert (found.removed, found.affected, found.attributes) == (2, 2, 4)
    none = resolution.collapse_statistics(rows.limit(0), rows.limit(0)).first()
    assert (none.removed, none.affected, none.attributes) == (0, 0, 0)


def test_paths_and_depths_are_those_of_a_plain_search(spark):
    drawn = random.Random(5)
    links = {(f"n{drawn.randrange(30)}", f"n{drawn.randrange(30)}") for _ in range(45)}
    edges = spark.createDataFrame(sorted(links | {(b, a) for a, b in links}), "a string, b string")
    beside = {}
    for a, b in links:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    level, best = {"n1": ["n1"]}, {"n1": ["n1"]}
    for _ in range(3):
        step = {}
        for node, path in level.items():
            for b in beside.get(node, ()):
                if b not in best:
                    step[b] = min(step.get(b, path + [b]), path + [b])
        best |= step
        level = step
    found = graph.reach(edges, spark.createDataFrame([("n1",)], "entity_id string"), 3)
    assert {r.node: r.depth for r in found.collect()} == {n: len(p) - 1 for n, p in best.items()}
    for end in [max(best, key=lambda n: len(best[n])), "n1", "nowhere"]:
        path = [r.entity_id for r in graph.shortest_path(edges, "n1", end).orderBy("position").collect()]
        assert path == best.get(end, [])


def test_citations_out_of_range_are_dropped(spark, tmp_path):
    rows = [{"conv_id": 3, "turn": t, "role": "user", "text": ""} for t in range(12)] + [{"conv_id": 22, "turn": 5, "role": None, "text": None}]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "conversations.parquet")
    found = {r.conv_id: r.cited for r in registry.QUERIES["jn23_citations"](spark, str(tmp_path)).collect()}
    assert found == {3: "1:user,1:user,8:user", 22: ""}
