"""Operator 13: MinHash near-dedup - documents of one component of links Jaccard >= num/den of k-word shingles are near copies; the smallest doc_id stays.

Method: signature-coordinate inverted join. A set's signature has COORDS coordinates, each the minimum of its own hash function over the set; two sets agree in a coordinate with
a chance that is their Jaccard similarity. Documents are posted under every coordinate-value pair, collisions are counted, and pairs with MATCHES of them or more
are retained:

 1. Posting lists. (coordinate, value) pairs of one document alone count nothing; a document with fewer than MATCHES others has no partner.
 2. Prefix. A document's pairs are ordered by the length of their lists, shortest first, and all but the MATCHES - 1 last are its prefix: two documents that share MATCHES pairs share one in
    both prefixes. So the long lists of frequent passages are mostly left alone.
 3. Merging. Within a prefix list, collisions are counted over all coordinates (one byte of each). Documents that lists already tie to each other are skipped: what comes out of a task is a forest of
    retained pairs, never all pairs of a list. A list beyond 2 * BLOCK is cut into blocks, and each two blocks meet in a task.
 4. Confirmation. Components of retained pairs are regions, and every linked pair lies inside one. Links within regions are found on the full sets, by the exact join that operator 1 makes within its regions.

So links are exact but for pairs that agree in fewer than MATCHES coordinates: at similarity 0.85 a chance of 3 * 10^-10, less above it (binomial tail of COORDS and MATCHES).
Equal sets are collapsed to their smallest doc_id before all of it (by 128 bits of fingerprints), so copies cost nothing there.

Scale: (value, doc_id) rows, two longs each, are shuffled twice, signatures of one byte a coordinate once for each pair of the prefix, texts once, of documents in regions only. The
counts of lists are summed map-side and joined back (AQE splits such joins).

Defined cases: a null or wordless text has an empty set, no link, and is its own component; fewer than k words are one shingle; a very long text is hashed in pieces; repeated doc_ids are one document
with the union of their links, each row is returned; a null doc_id takes no part, has no component and is kept; other columns are ignored by the query, kept by `deduplicated`; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import SPACE, U, join_back, materialize, mix, slices, spread, table, tidy, unused
from .components import components, forest

COORDS, MATCHES, BLOCK, ROWS, CHUNK = 64, 32, 1000, 20_000, 1024
_SEEDS = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * U(0xA24BAED4963EE407))[:, None]


def signature(s: np.ndarray) -> np.ndarray:
    """A value for each coordinate of a set of hashes (not empty), its coordinate mixed in."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for x in range(0, len(s), CHUNK):
        h = (s[None, x : x + CHUNK] ^ _SEEDS) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        low = np.minimum(low, h.min(1))
    return mix(low + _SEEDS[:, 0])


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, two fingerprints f and g of the set, its signature `sig`, and one byte of each coordinate in `low`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, f, g, sigs, lows = [], [], [], [], []
            for t in batch["text"].to_pylist():
                s = jaccard.shingles(t, k)
                n.append(len(s))
                f.append(mix(s).sum(dtype=np.uint64))
                g.append(mix(s ^ U(0x5BD1E995)).sum(dtype=np.uint64))
                sig = signature(s) if len(s) else jaccard.NO_ROWS
                sigs.append(sig.view(np.int64))
                lows.append(sig.astype(np.uint8).tobytes())
            prints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f, g)]
            cols = [batch["doc_id"], pa.array(n, pa.int64()), *prints, pa.array(sigs, pa.list_(pa.int64())), pa.array(lows, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "f", "g", "sig", "low"])
        jaccard._hashes().clear()
        tidy()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f long, g long, sig array<long>, low binary")


def posted(reps: DataFrame, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """(value, cell, rep, low): documents under the values of their prefixes; those of long lists in each cell of two blocks. reps: rep, sig, low."""
    rows = reps.select("rep", F.explode("sig").alias("value"))
    lists = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = join_back(rows, lists, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("p"))
    prefix = shared.where(F.size("p") >= matches).select(F.col("rep").alias("_r"), F.expr(f"slice(p, 1, size(p) - {matches - 1})").alias("p"))
    posts = reps.join(prefix, F.col("rep") == F.col("_r")).select("rep", "low", F.inline("p"))
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("rep", "value"), F.col("blocks"))
    others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != F.col("own")), lambda b: F.least(b, F.col("own")) * F.col("blocks") + F.greatest(b, F.col("own")))
    cells = F.when(F.col("blocks") <= 2, F.array(F.lit(0).cast("long"))).otherwise(others)
    return posts.withColumn("blocks", blocks).withColumn("own", own).select("value", F.explode(cells).alias("cell"), "rep", "low")


def tied(cell: np.ndarray, low: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of pairs in one cell that agree in `matches` coordinates: enough of them to connect all such pairs. Rows of a cell are neighbours."""
    at, top, d = np.arange(len(cell)), np.arange(len(cell)), 1
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(at):
        at = at[: np.searchsorted(at, len(cell) - d)]
        at = at[cell[at] == cell[at + d]]
        open_ = at[top[at] != top[at + d]]  # the others are tied already
        for x in range(0, len(open_), ROWS):
            i = open_[x : x + ROWS]
            hit = i[(low[i] == low[i + d]).sum(1) >= matches]
            a.append(hit)
            b.append(hit + d)
        if not d & (d - 1) and any(map(len, a[1:])):
            a, b = [np.concatenate(a)], [np.concatenate(b)]
            root, node = forest(a[0], b[0])
            top = np.arange(len(cell))
            top[node] = root
            a, b = [root[root != node]], [node[root != node]]
        d += 1
    return np.concatenate(a), np.concatenate(b)


def retained(posts: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(a, b): forests of the pairs of a list that agree in `matches` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def out(key: np.ndarray, rep: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = tied(np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(1)])), low, matches)
            pair = np.unique(np.stack([rep[a], rep[b]]), axis=1) if len(a) else np.empty((2, 0), np.int64)
            if pair.size:
                a, b = forest(pair[0], pair[1])
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*kept)]

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("value", "cell")], axis=1)
            kept.append((key, batch["rep"].to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch["low"].to_pylist()), np.uint8).reshape(-1, COORDS)))
            if sum(len(x[0]) for x in kept) >= ROWS:
                key, rep, low = joined()
                end = np.flatnonzero((key != key[-1]).any(1))  # the last cell may go on
                end = end[-1] + 1 if len(end) else 0
                if end:
                    yield from out(key[:end], rep[:end], low[:end])
                kept = [(key[end:], rep[end:], low[end:])]
        if kept:
            yield from out(*joined())
        tidy()

    return posts.repartition(spread(posts), "value", "cell").sortWithinPartitions("value", "cell").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, k: int = 5, num: int = 85, den: int = 100, matches: int = MATCHES, block: int = BLOCK, **how) -> tuple[DataFrame, DataFrame]:
    """The measured documents, and links (a, b) whose components are those of all pairs with Jaccard >= num/den."""
    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    sized = materialize(signed(raw, k), "minhash")
    full = sized.where("n_shingles > 0 and doc_id is not null")
    first = full.groupBy("f", "g").agg(F.min("doc_id").alias("first"))
    reps = materialize(join_back(full, first, "f", "g").where("doc_id = first").select(F.col("doc_id").alias("rep"), "sig", "low"), "minhash-reps")
    region = components(retained(posted(reps, matches, block), matches), "minhash-regions").toDF("doc_id", "region")
    return sized, jaccard.inside(raw, sized, region, k, num, den, **how)


def connected(docs: DataFrame, k: int = 5, num: int = 85, den: int = 100, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    sized, found = links(docs, k, num, den, **how)
    groups = components(found, "minhash-links").toDF("node", "component")
    out = sized.join(groups, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 85, den: int = 100, **how) -> DataFrame:
    """docs without those whose component holds a smaller doc_id."""
    name = unused("_later", docs)
    later = connected(docs, k, num, den, **how).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(later, F.col("doc_id") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""
