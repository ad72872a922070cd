"""Operator 9: exact top-k search by inner product, with a vector-approximation file.

Method: equal vectors are one class, with the k + 1 smallest of its vec_ids. Each class has a row in a file with two readings: its exact components, and
its approximation, one byte a component: component = low + step * cell + rest, 0 <= rest < step, low and step being the vector's own. For a query q,
low * sum(q) + step * (q . cells) + (step - 1) * (sum of q's negative parts, sum of its positive parts) bounds the score from below and above. The scan reads
only cells and keeps the classes whose upper bound reaches the k-th largest lower bound. Exact vectors are then read in the order of their upper bounds:
the first k of a query give its k-th score so far, and of the others only those whose upper bound reaches it can still be results.

Scale: a grid of query groups (about BLOCK queries) and parts of the cell file; a task holds the queries of one cell of the grid and streams the
part's approximations, a few thousand at a time. Nothing is collected by the driver but the number of queries, and nothing is broadcast by demand: the
candidates meet exact vectors and queries in joins that AQE plans and splits. Copies of one vector are limited to k + 1 vec_ids before they are shuffled, so
a vector that a third of all rows hold is one class and a few rows a task.

Defined cases: vectors that are null, empty, of another length than the query, or hold null or non-finite components take no part; a null vec_id takes
no part; every row with the query's own vec_id is "its own" and no candidate; repeated vec_ids of other rows count each, ties fall to the smaller vec_id; a
vec_id that repeats among queries asks with its first vector in the order of components; a component beyond 2**61 counts as that, and a score
beyond 64 bits counts as the largest or smallest long; vectors may be of any length; fewer than k candidates: all of them; other
columns are ignored, whatever their names; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, spread, table

K, EVERY, BLOCK, CHUNK = 5, 50, 4096, 4096
LARGEST = 2**61
NOTHING = -np.inf


def valid(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and integer components v of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0))
    whole = lambda x: F.floor(F.greatest(F.least(F.lit(256.0) * x.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long")
    return fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, whole).alias("v"))


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """The file: key, ids (vec_id and its number of rows, the k + 1 smallest vec_ids), v, and the approximation low, step, cells of every distinct vector."""
    counted = vectors.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = first.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    ranged = ids.withColumn("low", F.array_min("v")).withColumn("step", F.expr("(array_max(v) - low) div 256 + 1"))
    cells = F.transform("v", lambda x: F.call_function("div", x - F.col("low"), F.col("step")) - F.lit(128))
    return ranged.select(F.monotonically_increasing_id().alias("key"), "ids", "v", "low", "step", cells.cast("array<tinyint>").alias("cells"))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, flat.reshape(len(at), d) if len(at) == len(lengths) else np.stack([flat[ends[i] - d : ends[i]] for i in at])


class _Block:
    """Queries of one length, and their candidates so far: rows (key, lower bound, upper bound) and the k-th largest lower bound."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.k, self.q = ids, k, q.astype(np.float64)
        self.sums, self.less, self.more = self.q.sum(1), np.minimum(self.q, 0).sum(1), np.maximum(self.q, 0).sum(1)
        self.found: list[list] = [[] for _ in ids]
        self.kth = np.full(len(ids), NOTHING)

    def scan(self, keys: np.ndarray, own: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray, rows: int = 256) -> None:
        cells = cells.astype(np.float64) + 128
        size = np.abs(low) + 256 * step
        for a in range(0, len(self.ids), rows):
            q = slice(a, a + rows)
            near = (self.q[q] @ cells.T) * step + self.sums[q, None] * low
            # Whole numbers are exact below 2**53; beyond, bounds give way by more than rounding can take.
            far = (self.more[q] - self.less[q])[:, None] * size * (cells.shape[1] + 4)
            slack = np.where(far < 2.0**52, 0.0, far * 2.0**-50)
            lower, upper = near + self.less[q, None] * (step - 1) - slack, near + self.more[q, None] * (step - 1) + slack
            none = self.ids[q, None] == own[None, :]
            lower[none] = upper[none] = NOTHING
            floor = np.partition(lower, -self.k, axis=1)[:, -self.k] if lower.shape[1] >= self.k else np.full(lower.shape[0], NOTHING)
            self.kth[q] = np.maximum(self.kth[q], floor)
            reach = (upper >= self.kth[q, None]) & ~none
            for i in np.flatnonzero(reach.any(1)).tolist():
                at = np.flatnonzero(reach[i])
                self._keep(a + i, np.stack([lower[i, at], upper[i, at]]), keys[at])

    def _keep(self, i: int, bounds: np.ndarray, keys: np.ndarray) -> None:
        if self.found[i]:
            bounds, keys = np.concatenate([self.found[i][0], bounds], axis=1), np.concatenate([self.found[i][1], keys])
        if len(keys) >= self.k:
            self.kth[i] = max(self.kth[i], np.partition(bounds[0], -self.k)[-self.k])
            left = bounds[1] >= self.kth[i]
            bounds, keys = bounds[:, left], keys[left]
        self.found[i] = [bounds, keys]

    def batches(self, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for i, found in zip(self.ids.tolist(), self.found):
            if found:
                held.append((np.full(len(found[1]), i), found[1], *found[0]))
                n += len(found[1])
            if n >= rows:
                yield _bounds(held)
                held, n = [], 0
        if held:
            yield _bounds(held)


def _bounds(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["query_id", "key", "lower", "upper"])


def candidates(file: DataFrame, asked: DataFrame, groups: int, k: int) -> DataFrame:
    """(query_id, key, lower, upper): what the scan of the cells leaves, per task."""
    parts = spread(file)
    own = F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"])
    scanned = file.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("row"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), F.lit(1).alias("kind"), "key", own.alias("own"), "low", "step", "cells", F.lit(None).cast("array<bigint>").alias("q"))
    asking = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(0).alias("kind"), F.col("query_id").alias("key"), *[F.lit(None).cast("bigint").alias(c) for c in ("own", "low", "step")], F.lit(None).cast("array<tinyint>").alias("cells"), "q")
    dealt = scanned.unionByName(asking).repartition(spread(file) * groups, "row", "part").sortWithinPartitions("row", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asks, blocks = None, [], {}

        def ready() -> None:
            if asks:
                whole = pa.Table.from_batches(asks).combine_chunks()
                ids, q = whole["key"].to_numpy(), whole["q"].combine_chunks()
                for rows, m in _matrices(q):
                    blocks[m.shape[1]] = _Block(ids[rows], m, k)
                asks.clear()

        for whole in batches:
            cell = np.stack([whole[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "part", "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0).any(0)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if (here := tuple(cell[:2, a].tolist())) != at:
                    for block in blocks.values():
                        yield from block.batches()
                    at, asks, blocks = here, [], {}
                if not cell[2, a]:
                    asks.append(whole.slice(a, b - a).select(["key", "q"]))
                    continue
                ready()
                for c in range(a, b, CHUNK) if blocks else ():
                    batch = whole.slice(c, min(CHUNK, b - c))
                    keys, own, low, step = (batch[x].fill_null(-1).to_numpy(zero_copy_only=False) for x in ("key", "own", "low", "step"))
                    alone = batch["own"].is_valid().to_numpy(zero_copy_only=False)
                    own = np.where(alone, own.astype(np.float64), np.nan) if abs(own).max(initial=0) < 2**53 else np.array([x if y else None for x, y in zip(own.tolist(), alone)], object)
                    for rows, m in _matrices(batch["cells"]):
                        if m.shape[1] in blocks:
                            blocks[m.shape[1]].scan(keys[rows], own[rows], low[rows].astype(np.float64), step[rows].astype(np.float64), m)
        for block in blocks.values():
            yield from block.batches()

    return dealt.mapInArrow(run, "query_id long, key long, lower double, upper double")


def exact(left: DataFrame, file: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, key, ids, score) of candidates, from their exact vectors."""
    met = left.select("query_id", "key").join(file.select("key", "ids", "v"), "key").join(asked, "query_id").select("query_id", "key", "ids", "v", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows, np.int64)
            for (rows, v), (_, q) in zip(_matrices(batch["v"]), _matrices(batch["q"])):
                big = np.abs(v.astype(np.float64) * q).sum(1) >= 2.0**62
                score[rows] = (v * q).sum(1)
                for i in np.flatnonzero(big).tolist():
                    true = sum(x * y for x, y in zip(v[i].tolist(), q[i].tolist()))
                    score[rows[i]] = max(-(2**63), min(2**63 - 1, true))
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["key"], batch["ids"], pa.array(score)], names=["query_id", "key", "ids", "score"])

    return met.mapInArrow(run, "query_id long, key long, ids array<struct<vec_id:long,n:long>>, score long")


def search(rows: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is divisible by `every`."""
    vectors = valid(rows, vector)
    file = materialize(classes(vectors, k), "vector-cells")
    asked = materialize(vectors.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")), "vector-queries")
    groups = max(1, -(-asked.count() // block))
    found = materialize(candidates(file, asked, groups, k), "vector-bounds")
    by = Window.partitionBy("query_id")
    kth = found.withColumn("place", F.row_number().over(by.orderBy(F.desc("lower")))).where(F.col("place") <= k)
    kth = kth.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("lower")).otherwise(NOTHING).alias("kth"))
    near = found.join(kth, "query_id").where(F.col("upper") >= F.col("kth")).select("query_id", "key", "upper")
    near = near.withColumn("place", F.row_number().over(by.orderBy(F.desc("upper"), "key")))
    first = materialize(exact(near.where(F.col("place") <= k), file, asked), "vector-scores")
    sure = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-(2**63)).alias("sure"))
    more = exact(near.where(F.col("place") > k).join(sure, "query_id").where(F.col("upper") >= F.col("sure").cast("double")), file, asked)
    copies = first.unionByName(more).select("query_id", "score", F.explode("ids").alias("c")).where(F.col("c.vec_id") != F.col("query_id"))
    each = copies.select("query_id", "score", F.col("c.vec_id").alias("vec_id"), F.explode(F.array_repeat(F.lit(0), F.least(F.col("c.n"), F.lit(k)).cast("int"))))
    rank = F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
