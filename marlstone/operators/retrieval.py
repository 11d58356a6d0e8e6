"""Vector search and hybrid retrieval: threshold, top-k, margin, rank, dedupe, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Least similarity, hits, margin below the best, weights, and the sizes of a context.
THRESHOLD, TOP_K, MARGIN = 0.50, 8, 0.12
WEIGHT_FACT, WEIGHT_SIMILARITY, WEIGHT_FRESHNESS = 1.0, 0.70, 0.10
MOST_FACTS, MOST_CHUNKS = 20, 12
#: Queries of one group on average, pairs of a block that meet at one time, numbers of the vectors that are multiplied pair
#: by pair at one time, pivots, and decimals of a similarity: equal vectors must be equally similar, in whatever block they stand.
QUERY_GROUP, BLOCK_PAIRS, PAIRED, PIVOTS, DIGITS = 1 << 16, 1 << 20, 1 << 21, 16, 12
#: What rounding may add to a similarity's bound.
SLACK = 1e-9


def live_chunks(chunks: DataFrame, versions: DataFrame, sources: DataFrame, current_only: bool = True) -> DataFrame:
    """Chunks of indexed versions of active sources (of the source's current version, unless told otherwise)."""
    live = versions.where("status = 'INDEXED'").join(sources.where("is_active"), "source_id")
    if current_only:
        live = live.where("version_id = current_version")
    return chunks.join(live.select("version_id", "source_id", "version_number", "site"), "version_id")


class _Cell:
    """The queries of one cell of the grid, and the best of the chunks that have streamed past them.

    A block of chunks meets only those queries that it can reach: the angles of chunks and queries to a few pivots, taken
    from the cell's own queries, bound every angle between them (triangle inequality), and a query's bound is the
    threshold or its k-th best similarity so far. Products of blocks only tell which pairs may count; these are multiplied
    one by one, as such products depend on the block in their last bits, and a rounded one may then depend on it too.
    """

    def __init__(self, ids: pa.Array, vectors: np.ndarray, threshold: float | None, k: int | None, by: str) -> None:
        self.raw, self.norm, vectors, real = _unit(vectors)
        self.ids, self.queries, self.k, self.by, self.threshold = ids.filter(pa.array(real)), vectors, k, by, threshold
        pivots, nearest = [], np.full(len(vectors), -1.0)
        for _ in range(min(PIVOTS, len(vectors))):
            pivots.append(vectors[int(np.argmin(nearest))])  # the farthest from those taken
            nearest = np.maximum(nearest, vectors @ pivots[-1])
        self.pivots = np.array(pivots).reshape(len(pivots), vectors.shape[1])
        self.angles = _angles(vectors, self.pivots)
        self.bound = np.full(len(vectors), -np.inf if threshold is None else threshold)
        self.top = np.full((len(vectors), k), -np.inf) if k else None
        self.held: list[tuple[np.ndarray, np.ndarray, pa.StructArray]] = []
        self.n_held = 0

    def meet(self, items: pa.StructArray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.StructArray]]:
        """Without k the pairs over the threshold, block by block; with k they are kept for best()."""
        raw, norm, vectors, real = _unit(vectors)
        if not len(vectors) or not len(self.queries):
            return
        items, angles = items.filter(pa.array(real)), _angles(vectors, self.pivots)
        near = np.argmin(angles, axis=1)
        order = np.lexsort((angles[np.arange(len(near)), near], near))
        step = max(8, BLOCK_PAIRS // len(self.queries))
        for at in range(0, len(order), step):
            block = order[at : at + step]
            least, most = angles[block].min(axis=0), angles[block].max(axis=0)
            apart = np.maximum(least - self.angles, self.angles - most).max(axis=1, initial=0.0)
            live = np.flatnonzero(np.cos(np.minimum(apart, np.pi)) >= self.bound - SLACK)
            if not len(live):
                continue
            sims = self.queries[live] @ vectors[block].T
            if self.k:
                both = np.concatenate([self.top[live], sims], axis=1)
                self.top[live] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
                self.bound[live] = np.maximum(self.bound[live], self.top[live].min(axis=1))
            query, row = np.nonzero(sims >= self.bound[live, None] - SLACK)
            query, row = live[query], block[row]
            sim = self._cosines(query, raw, norm, row)
            if self.threshold is not None:
                kept = sim >= self.threshold
                query, row, sim = query[kept], row[kept], sim[kept]
            if len(query):
                found = (query, sim, items.take(pa.array(row)))
                if not self.k:
                    yield found
                    continue
                self.held.append(found)
                self.n_held += len(query)
                if self.n_held > 2 * len(self.queries) * self.k + BLOCK_PAIRS:
                    self.held = list(self.best())
                    self.n_held = sum(len(h[0]) for h in self.held)

    def _cosines(self, query: np.ndarray, raw: np.ndarray, norm: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The cosine of each pair by the plain formula, halves of the last decimal rounded up in size, as SQL does."""
        sim, step = np.empty(len(query)), max(1, PAIRED // raw.shape[1])
        for at in range(0, len(query), step):
            q, r = query[at : at + step], row[at : at + step]
            sim[at : at + step] = np.einsum("ij,ij->i", self.raw[q], raw[r]) / (self.norm[q] * norm[r])
        return np.copysign(np.floor(np.abs(sim) * 10.0**DIGITS + 0.5), sim) / 10.0**DIGITS

    def best(self) -> Iterator[tuple[np.ndarray, np.ndarray, pa.StructArray]]:
        """Each query's k best of what is held, ties by the column `by`."""
        if not self.held:
            return
        query, sim = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        items = pa.concat_arrays([h[2] for h in self.held])
        order = pc.sort_indices(pa.table({"q": query, "s": sim, "by": items.field(self.by)}), sort_keys=[("q", "ascending"), ("s", "descending"), ("by", "ascending")]).to_numpy()
        q = query[order]
        place = np.arange(len(q))
        kept = order[place - np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], place, 0)) < self.k]
        yield query[kept], sim[kept], items.take(pa.array(kept))


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vectors that have a direction, times a power of two that keeps products in range and every bit, their lengths,
    the same at length one, and which they are.
    """
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    real = (norm > 0) & np.isfinite(norm)
    power = -np.frexp(norm[real])[1]
    raw, norm = np.ldexp(vectors[real], power[:, None]), np.ldexp(norm[real], power)
    return raw, norm, raw / norm[:, None], real


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1, 1))


def score(chunks: DataFrame, queries: DataFrame, threshold: float | None = None, k: int | None = None, by: str = "chunk_id") -> DataFrame:
    """Chunks' columns but the embedding, query_id and sim: the exact cosine of chunks (column embedding) with queries
    (query_id, probe), to DIGITS decimals. With threshold only pairs at least that similar; with k each task's k best of
    each query, ties by the column `by`.

    Both tables are distributed, and their product is a grid: queries are dealt to groups of about QUERY_GROUP, chunks to
    as many parts as make every task busy, and a cell has one group and one part. Chunks stream past the group's queries,
    so that only the queries, a block of products and the best so far are held. What goes to the driver is the number of
    queries. Vectors that are null, without a direction, or of another size than the query's have no similarity.
    """
    spark, others = chunks.sparkSession, [c for c in chunks.columns if c != "embedding"]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-queries.count() // QUERY_GROUP))
    parts = max(1, -(-2 * width // groups))
    kinds, query_kind = dict(chunks.dtypes), queries.schema["query_id"].dataType.simpleString()
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", F.col("probe").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    asked = asked.select("query_id", F.lit(None).alias("item"), "vector", F.pmod(F.xxhash64("query_id", "vector"), F.lit(groups)).alias("g"), each(parts).alias("p"))
    stored = chunks.select(F.struct(*(f"`{c}`" for c in others)).alias("item"), F.col("embedding").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    stored = stored.select(F.lit(None).cast(query_kind).alias("query_id"), "item", "vector", each(groups).alias("g"), F.pmod(F.xxhash64("item"), F.lit(parts)).alias("p"))
    asked = asked.withColumns({"item": F.col("item").cast(stored.schema["item"].dataType), "side": F.lit(0)})
    met = asked.unionByName(stored.withColumn("side", F.lit(1)))
    met = met.select((F.col("g") * parts + F.col("p")).cast("int").alias("cell"), F.size("vector").alias("size"), "side", "query_id", "item", "vector")
    dealt = met.repartitionById(groups * parts, F.col("cell")).sortWithinPartitions("cell", "size", "side")
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + [f"query_id {query_kind}", "sim double"])

    def shown(cell: _Cell, found: Iterator[tuple[np.ndarray, np.ndarray, pa.StructArray]]) -> Iterator[pa.RecordBatch]:
        for query, sim, items in found:
            yield pa.RecordBatch.from_arrays([*items.flatten(), cell.ids.take(pa.array(query)), pa.array(sim)], names=[*others, "query_id", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, ids, probes = None, None, [], []
        for batch in batches:
            head = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]).any(axis=1), True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                key, side = tuple(head[a, :2].tolist()), int(head[a, 2])
                if key != now:
                    if cell and k:
                        yield from shown(cell, cell.best())
                    now, cell, ids, probes = key, None, [], []
                vectors = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(b - a, key[1])
                if side == 0:
                    ids.append(part.column(3))
                    probes.append(vectors)
                elif ids:
                    cell = cell or _Cell(pa.concat_arrays(ids), np.concatenate(probes), threshold, k, by)
                    yield from shown(cell, cell.meet(part.column(4), vectors))
        if cell and k:
            yield from shown(cell, cell.best())

    return dealt.mapInArrow(run, schema)


def top_hits(scored: DataFrame, threshold: float = THRESHOLD, k: int = TOP_K, margin: float = MARGIN) -> DataFrame:
    """Hits over the threshold, the k best of each query (ties by chunk_id), then those within margin of its best. The
    k best of each task are taken before the shuffle.
    """
    w = W.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id")
    kept = scored.where(F.col("sim") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if margin <= 0:
        return kept
    best = F.max("sim").over(W.partitionBy("query_id"))
    return kept.withColumn("best", best).where(F.col("sim") >= F.col("best") - margin).drop("best")


def ranked(hits: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Chunks by weighted similarity and freshness v / (v + 1), facts by confidence, in one order for each query."""
    fresh = F.col("version_number") / (F.col("version_number") + 1)
    chunks = hits.select("query_id", F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("item"), (WEIGHT_SIMILARITY * F.col("sim") + WEIGHT_FRESHNESS * fresh).alias("score"))
    if facts is None:
        return chunks
    return facts.select("query_id", F.lit("fact").alias("kind"), "item", (WEIGHT_FACT * F.col("confidence")).alias("score")).unionByName(chunks)


def deduplicated(results: DataFrame) -> DataFrame:
    """The best row of each (query, kind, item)."""
    w = W.partitionBy("query_id", "kind", "item").orderBy(F.desc("score"))
    return results.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def context(results: DataFrame) -> DataFrame:
    """For each query the first facts and chunks by score as one numbered text; a fixed sentence where there is none."""
    w = W.partitionBy("query_id", "kind").orderBy(F.desc("score"), "item")
    cut = results.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.when(F.col("kind") == "fact", MOST_FACTS).otherwise(MOST_CHUNKS))
    line = F.format_string("%d. %s", "n", "item")
    section = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", line.alias("line"))))), lambda x: x["line"]), "\n")
    made = cut.groupBy("query_id").agg(section("fact").alias("facts"), section("chunk").alias("chunks"))
    return made.select("query_id", F.when(F.col("facts") == "", "No structured facts.").otherwise(F.col("facts")).alias("facts"), F.when(F.col("chunks") == "", "No documentation.").otherwise(F.col("chunks")).alias("chunks"))
