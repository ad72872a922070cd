"""Operator 12: conversation prefix trie - every distinct sequence of first turns is a node, with what its subtree holds and what storing shared turns once saves.

Method: pointer-jumping rollup. A node's key is the digest of its turns, 128 bits that roll along a conversation by exclusive-or, so a turn also knows the key of its
parent: an edge. Leaves and savings are accumulated to all ancestors in doubling rounds. In round i a node holds the sums of its descendants less than 2^i below it, and a pointer
to its ancestor 2^i above; nodes add their sums to those their pointers name, and pointers jump to their pointers' pointers. Rounds are as
many as the depth has binary digits, where walking level by level would take one a turn.

Scale: texts are hashed once and leave then; rows are longs. Places and rolling digests are computed in chunks of a conversation (`chat.places`, `chat.rolled`), so a conversation with a large share of all turns fills
many tasks. A first turn that all conversations share is one row a task (sums and minima are map-side combined), and joins with parents and pointers have unique keys on one
side and are made from written tables, so AQE splits hot ones. Each round is written to the shared folder. Where very many conversations end in one node, their ids
are sorted and joined to pieces of PIECE ids in many tasks, and one task hashes the pieces as they stream by, as SHA-256 needs them in order.

Defined cases: rows with a null conv_id take no part; turns are in the order of turn (null first), role, text, and repeated rows count each; a null role or text is ''; a very long text is one row; a
conversation whose turns all go ends in the root; empty table: empty result, without a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import places, rolled
from .common import materialize, spread, table

FAMILY, HEADS, PIECE = 100, 6, 4096


def hashed(conversations: DataFrame) -> DataFrame:
    """conv_id, place, t1, t2 (two hashes of role and text) and chars (code points of the text) of every turn."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", blank("role"), blank("text"))
    hashes = [F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("b"), "role", "text").alias("t2")]
    return places(rows, "role", "text").select("conv_id", F.col("place").cast("long"), *hashes, F.char_length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns (as of `hashed`) whose first ones are replaced by those of the conversation that leads its family of FAMILY ids; how many is told by the id's checksum."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")
    lead = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("lead")
    starts = turns.where(F.col("place") < HEADS).where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("lead"), "place", "t1", "t2", "chars")
    heads = turns.select("conv_id", h, lead).distinct().join(starts, "lead").where("place <= h").select("conv_id", "place", "t1", "t2", "chars")
    lengths = starts.groupBy("lead").agg(F.count(F.lit(1)).alias("have"))
    tails = turns.select("*", h, lead).where("place > h").join(lengths, "lead", "left")
    place = F.col("place") - F.col("h") + F.least("h", F.coalesce("have", F.lit(0)))
    return heads.unionByName(tails.select("conv_id", place.alias("place"), "t1", "t2", "chars"))


def ends_hashed(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(h1, h2, ends_sha256): of the conv_ids of each key, ascending and joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            h1, h2, ids = (batch[c].to_pylist() for c in ("h1", "h2", "conv_id"))
            a = 0
            for b in range(1, len(ids) + 1):
                if b == len(ids) or (h1[b], h2[b]) != (h1[a], h2[a]) or b - a == piece:
                    for part, v in zip(rows, (h1[a], h2[a], ids[a], ",".join(map(str, ids[a:b])))):
                        part.append(v)
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["h1", "h2", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        rows: tuple[list, ...] = ([], [], [])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, (pa.int64(), pa.int64(), pa.string()))], names=["h1", "h2", "ends_sha256"])

        for batch in batches:
            for h1, h2, ids in zip(*(batch[c].to_pylist() for c in ("h1", "h2", "ids"))):
                if (h1, h2) == key:
                    state.update(b",")
                else:
                    if key:
                        for part, v in zip(rows, (*key, state.hexdigest())):
                            part.append(v)
                    key, state = (h1, h2), hashlib.sha256()
                state.update(ids.encode())
            yield out()
            rows = ([], [], [])
        if key:
            rows = ([key[0]], [key[1]], [state.hexdigest()])
            yield out()

    n = spread(ends)
    parts = ends.select("h1", "h2", "conv_id").repartitionByRange(n, "h1", "h2", "conv_id").sortWithinPartitions("h1", "h2", "conv_id").mapInArrow(pieces, "h1 long, h2 long, first long, ids string")
    return parts.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2", "first").select("h1", "h2", "ids").mapInArrow(digests, "h1 long, h2 long, ends_sha256 string")


def rollup(nodes: DataFrame) -> DataFrame:
    """(h1, h2, n_leaves, saved_tokens): leaves and savings summed over each node's subtree. nodes: h1, h2, p1, p2 (the parent, null at the root), depth, leaf, saving."""
    state = nodes.select("h1", "h2", "depth", F.col("leaf").alias("n_leaves"), F.col("saving").alias("saved_tokens"), F.col("p1").alias("u1"), F.col("p2").alias("u2"))
    deepest, reach = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        # Only nodes at least `reach` deep have a pointer, and only those twice as deep have one after the jump.
        given = state.where(F.col("depth") >= reach).groupBy(F.col("u1").alias("h1"), F.col("u2").alias("h2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        sums = {c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))}
        added = state.join(given, ["h1", "h2"], "left").withColumns(sums).drop("more_leaves", "more_saved")
        jumps = state.where(F.col("depth") >= reach).select(F.col("h1").alias("u1"), F.col("h2").alias("u2"), F.col("u1").alias("j1"), F.col("u2").alias("j2"))
        far = added.where(F.col("depth") >= 2 * reach).join(jumps, ["u1", "u2"]).drop("u1", "u2").withColumnsRenamed({"j1": "u1", "j2": "u2"})
        near = added.where(F.col("depth") < 2 * reach).withColumns({c: F.lit(None).cast("long") for c in ("u1", "u2")})
        state = materialize(far.unionByName(near), "trie-round")
        reach *= 2
    return state.select("h1", "h2", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every node of the prefix trie. turns: conv_id, place (from 1, without gaps), t1, t2, chars; conversations: conv_id, with those that have no turns."""
    x = [F.xxhash64("place", t).alias(x) for t, x in (("t1", "x1"), ("t2", "x2"))]
    own = rolled(turns.select("conv_id", "place", "chars", *x, *[c.alias(f"_{i}") for i, c in enumerate(x)]))
    rows = own.select("conv_id", "place", "chars", F.col("x1").alias("h1"), F.col("x2").alias("h2"), F.col("x1").bitwiseXOR(F.col("_0")).alias("p1"), F.col("x2").bitwiseXOR(F.col("_1")).alias("p2"))
    root = conversations.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("place", "chars", "h1", "h2")], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    rows = materialize(rows.unionByName(root), "trie-rows")
    nodes = rows.groupBy("h1", "h2").agg(F.max("place").alias("depth"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    below = nodes.where("depth > 0").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(below, ["h1", "h2"], "left").na.fill(0, ["n_children"]), "trie-nodes")
    sums = rollup(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("chars")}))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("e")).select("conv_id", "e.h1", "e.h2")
    parents = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["p1", "p2"], "left").join(sums, ["h1", "h2"]).join(ends_hashed(last), ["h1", "h2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(hashed(table(spark, sf_dir, "conversations")), "trie-turns")
    return trie(rebuilt(turns), turns.select("conv_id").distinct())


SQL = f"""
WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT conv_id, list_transform(list(byte ORDER BY i), lambda x: x) AS bytes FROM (SELECT conv_id, i, ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1)) AS byte FROM t, range(1, 21) r(i) WHERE i <= length(CAST(conv_id AS VARCHAR))) GROUP BY conv_id),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda x: [x::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % {HEADS} AS h FROM b),
r AS (SELECT t.conv_id, list_concat(coalesce(f.l[1:h.h], []), t.l[h.h + 1:]) AS l FROM t JOIN h USING (conv_id) LEFT JOIN t f ON f.conv_id = t.conv_id - t.conv_id % {FAMILY}),
p AS (SELECT conv_id, d, l[1:d] AS k, d = len(l) AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS e FROM p GROUP BY k, d),
c AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.k[1:n.d] = n.k) AS kids FROM n),
s AS (SELECT k[1:a] AS k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(k[d].text) END) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM c) GROUP BY k[1:a])
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, c.n AS n_convs, CAST(c.kids AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, c.e AS ends_sha256
FROM c JOIN s ON s.k = c.k LEFT JOIN n q ON q.d = c.d - 1 AND q.k = c.k[1:c.d - 1]
"""
