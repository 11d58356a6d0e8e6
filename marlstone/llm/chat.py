"""Chat formatting by quotation linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read_table, shuffle_width

#: A quote mark at the front of a line: any number of `>`, with blanks between them; and white space.
QUOTE, GAP = r"^[\x20\x09]*(?:>[\x20\x09]*)+", r"[\x20\x09-\x0D]+"
#: Words of a quoted passage that are compared at one time.
GRAM = 5
#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "model": "assistant"}


def quote_lines(text: Column) -> Column:
    """The lines of a text as (level, body): level counts a line's quote marks, body is what follows them."""
    mark = lambda x: F.regexp_extract(x, QUOTE, 0)
    line = lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.substring(x, F.length(mark(x)) + 1, F.length(x)).alias("body"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def passages(lines: Column) -> Column:
    """The passages of a text as (level, words): lines of one level that follow one another are one passage, read as
    words in lower case.
    """
    changes = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (x[i]["level"] != x[F.greatest(i - 1, F.lit(0))]["level"]))
    words = lambda x: F.filter(F.split(F.lower(F.array_join(F.transform(x, lambda y: y["body"]), " ")), GAP), lambda w: w != "")
    until = lambda at, k, n: F.coalesce(F.try_element_at(at, k + 2), n)
    return F.transform(changes(lines), lambda i, k: F.struct(lines[i]["level"].alias("level"), words(F.slice(lines, i + 1, until(changes(lines), k, F.size(lines)) - i)).alias("words")))


def grams(words: Column) -> Column:
    """All runs of GRAM words, as texts; a shorter passage is one run, one without a word none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - GRAM + 1), lambda i: F.array_join(F.slice(words, i, GRAM), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) <= GRAM, F.array(F.array_join(words, " "))).otherwise(runs)


def line_grams(lines: Column) -> Column:
    """The unquoted lines of fewer than GRAM words, as texts: what a short quote can name."""
    words = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: F.filter(F.split(F.lower(x["body"]), GAP), lambda w: w != ""))
    return F.transform(F.filter(words, lambda w: (F.size(w) > 0) & (F.size(w) < GRAM)), lambda w: F.array_join(w, " "))


def own_text(lines: Column) -> Column:
    """The unquoted lines, without white space at both ends."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.regexp_replace(own, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def _links(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to): the earlier message that each message quotes. Of the runs of GRAM words of a message's
    quoted passages, those of the lowest level that stand in an earlier message of the conversation count, each once; the
    message with most of them is the one replied to, the later of two. A run's original is the first message that has it
    unquoted. Runs meet by their hash and are then compared.
    """
    keyed = messages.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    quoting = keyed.where(F.exists("lines", lambda x: x["level"] > 0))
    by_hash = lambda df: df.withColumn("hash", F.xxhash64("gram"))
    quoted = quoting.select("conv", "turn", F.explode(passages(F.col("lines"))).alias("p")).where("p.level > 0")
    quoted = by_hash(quoted.select("conv", "turn", F.col("p.level").alias("level"), F.explode(grams(F.col("p.words"))).alias("gram")).distinct())
    said = keyed.join(quoting.select("conv").distinct(), "conv", "left_semi")
    own = F.flatten(F.transform(F.filter(passages(F.col("lines")), lambda p: p["level"] == 0), lambda p: grams(p["words"])))
    said = by_hash(said.select("conv", "turn", F.explode(F.array_distinct(F.concat(own, line_grams(F.col("lines"))))).alias("gram")))
    originals = said.groupBy("conv", "hash", "gram").agg(F.min("turn").alias("origin"))
    found = quoted.join(originals, ["conv", "hash", "gram"]).where("origin < turn").groupBy("conv", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("conv", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "n", "origin")).alias("reply_to"))


def _threads(links: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, thread): thread is the turn that a chain of replies begins with, by pointer doubling."""
    at = cut(links.withColumn("thread", F.col("reply_to")))
    while True:
        up = at.select(F.col("conv").alias("of_conv"), F.col("turn").alias("of_turn"), F.col("thread").alias("up"))
        joined = at.join(up, (F.col("conv") == F.col("of_conv")) & (F.col("thread") == F.col("of_turn")), "left")
        joined = joined.select("conv", "turn", "reply_to", F.coalesce("up", "thread").alias("thread"), F.col("up").isNotNull().alias("moved"))
        joined = cut(joined)
        at = joined.drop("moved")
        if not joined.where("moved").take(1):
            return at


def _positions(keys: DataFrame) -> DataFrame:
    """keys (conv, turn, n, thread, ...) with position: how many messages come before in (thread, turn) order. A
    conversation's keys are spread over tasks by range; each task counts its own, and only one row for each task and
    conversation is summed across tasks.
    """
    ranged = keys.repartitionByRange(shuffle_width(keys.sparkSession), "conv", "thread", "turn").withColumn("task", F.spark_partition_id())
    ranged = cut(ranged)
    tasks = ranged.groupBy("conv", "task").agg(F.sum("n").alias("in_task"))
    before = tasks.withColumn("before", F.sum("in_task").over(W.partitionBy("conv").orderBy("task")) - F.col("in_task")).select(F.col("conv").alias("b_conv"), F.col("task").alias("b_task"), "before")
    inside = F.sum("n").over(W.partitionBy("conv", "task").orderBy("thread", "turn")) - F.col("n")
    placed = ranged.withColumn("inside", inside)
    joined = placed.join(before, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("task") == F.col("b_task")))
    return joined.withColumn("position", F.col("before") + F.col("inside")).drop("b_conv", "b_task", "task", "before", "inside")


def link_conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, position, turn, role, reply_to, thread, quoted_lines, text) of every message, ready to be read in
    order of position: messages that reply to one another by quotes are a thread, a message that quotes nothing known is
    a thread of its own, and threads stand in the order of their first messages, each with its messages by turn. text is
    without quoted lines; role is in lower case with common other names replaced.

    Null texts are empty; a null conversation is one conversation whose messages link to nothing; null turns come first;
    repeated rows and equal turns share a position, as in rank(); an empty table gives an empty one; other columns of
    messages are not read. A conversation's messages are never brought together in one task.
    """
    name = F.lower(F.trim(F.col(role)))
    name = F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[name], name)
    rows = messages.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), name.alias("role"), quote_lines(F.col(text)).alias("lines"))
    threads = _threads(_links(rows))
    keys = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"))
    keys = keys.join(threads, ["conv", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    places = _positions(keys).select(F.col("conv").alias("p_conv"), F.col("turn").alias("p_turn"), "position", "reply_to", "thread")
    out = rows.select("conv", "turn", "role", F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("quoted_lines"), own_text(F.col("lines")).alias("text"))
    out = out.join(places, F.col("conv").eqNullSafe(F.col("p_conv")) & F.col("turn").eqNullSafe(F.col("p_turn")))
    return out.select(F.col("conv").alias(conversation), "position", F.col("turn").alias(turn), F.col("role").alias(role), "reply_to", "thread", "quoted_lines", F.col("text").alias(text))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(read_table(spark, sf_dir, "conversations"))


OP5_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS row_no, conv_id, turn,
         coalesce(map {'human': 'user', 'prompter': 'user', 'bot': 'assistant', 'ai': 'assistant', 'model': 'assistant'}[lower(trim(role))], lower(trim(role))) AS role,
         string_split(coalesce(text, ''), chr(10)) AS parts
  FROM conversations),
lines AS (
  SELECT row_no, conv_id, turn, i, length(regexp_replace(regexp_extract(part, '^[\x20\x09]*(?:>[\x20\x09]*)+'), '[^>]', '', 'g')) AS level,
         substr(part, length(regexp_extract(part, '^[\x20\x09]*(?:>[\x20\x09]*)+')) + 1) AS body
  FROM (SELECT row_no, conv_id, turn, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM split)),
numbered AS (
  SELECT *, i - row_number() OVER (PARTITION BY row_no, level ORDER BY i) AS run FROM lines
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
passages AS (
  SELECT row_no, conv_id, turn, level, run, list_filter(regexp_split_to_array(lower(string_agg(body, ' ' ORDER BY i)), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM numbered GROUP BY row_no, conv_id, turn, level, run),
runs AS (
  SELECT conv_id, turn, level, unnest(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS gram
  FROM passages WHERE len(w) > 0
  UNION ALL
  SELECT conv_id, turn, 0, array_to_string(w, ' ')
  FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(body), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM numbered WHERE level = 0)
  WHERE len(w) BETWEEN 1 AND 4),
originals AS (
  SELECT conv_id, gram, min(turn) AS origin FROM runs WHERE level = 0 GROUP BY ALL),
found AS (
  SELECT p.conv_id, p.turn, level, origin, count(DISTINCT p.gram) AS n
  FROM runs p JOIN originals o ON p.conv_id = o.conv_id AND p.gram = o.gram
  WHERE level > 0 AND origin < p.turn GROUP BY ALL),
links AS (
  SELECT conv_id, turn, origin AS reply_to FROM found
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
chain AS (
  SELECT conv_id, turn, reply_to AS top FROM links
  UNION ALL
  SELECT c.conv_id, c.turn, l.reply_to FROM chain c JOIN links l ON c.conv_id = l.conv_id AND c.top = l.turn),
threads AS (
  SELECT conv_id, turn, min(top) AS thread FROM chain GROUP BY ALL),
own AS (
  SELECT row_no, CAST(count(*) FILTER (WHERE level > 0) AS INTEGER) AS quoted_lines,
         coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') AS text
  FROM lines GROUP BY row_no)
SELECT s.conv_id, CAST(rank() OVER (PARTITION BY s.conv_id ORDER BY coalesce(t.thread, s.turn) NULLS FIRST, s.turn NULLS FIRST) - 1 AS BIGINT) AS position,
       s.turn, s.role, l.reply_to, coalesce(t.thread, s.turn) AS thread, o.quoted_lines,
       regexp_replace(o.text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g') AS text
FROM split s JOIN own o ON s.row_no = o.row_no
LEFT JOIN links l ON s.conv_id = l.conv_id AND s.turn = l.turn
LEFT JOIN threads t ON s.conv_id = t.conv_id AND s.turn = t.turn
"""
