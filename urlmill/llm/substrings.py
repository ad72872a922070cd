"""Operator 10: substring dedup - words covered by a window of LENGTH words that a document with a smaller doc_id holds too are removed.

Method: suffix automata of reference shards. A shard holds reference passages, its suffix automaton accepts every run of words in them, and
documents stream through it for matching statistics (the longest run that ends at each word); spans of at least LENGTH are removed.
Sending every document through the automata of all of the corpus would be quadratic, so candidates come first, exactly:

 1. Anchors. Of each window's runs of GRAM words, the one with the smallest hash is its anchor; equal windows have equal anchors, and
    neighbours mostly share theirs, so a document has about one anchor in eighteen words. Windows of anchors that only one document has are
    alone. (Documents that equal a smaller one entirely are removed whole, and take no part.)
 2. Windows of the shared anchors are hashed; the smallest doc_id of each is its owner. Windows of one document are alone.
 3. The owners' runs of owned windows are the reference - each shared window once. A shard is about SHARD words of them, dealt by
    owner, so its automaton has a bounded size; other documents' runs go to the shard of their owner. A shard that many documents ask is
    sent to several tasks, its documents split among them, PROBES words each.
 4. The automaton decides on what the window hashes name: only runs that its matching statistics find over at least LENGTH words, comparing words, are removed, so
    a collision of window hashes removes nothing. Whole copies (step 1) are told by 128 bits of hashes and the number of words.

Scale: texts are written once, with a number for each row, bucketed by it, and joined with anchors, windows and spans without being shuffled; only hashes move.
Minima per hash are map-side combined and joined back (AQE splits such joins), so a passage in a third of all documents meets in no
single task.

Defined cases: a null or blank text has no words; a very long text is hashed whole, and only its repeated passages go to automata; documents of fewer than LENGTH words lose nothing; rows with equal doc_ids are not judged by one
another, each loses what smaller doc_ids hold of its own text, and each is returned; a null doc_id loses nothing; other columns are ignored by the query; empty table: empty
result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, grams, join_back, materialize, mix, shared_dir, spread, table

LENGTH, GRAM, SHARD, PROBES = 50, 16, 100_000, 400_000


@cache
def _hashes() -> WordHashes:
    return WordHashes()


def window_anchors(w: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchor of each window of `length` words: the smallest hash of its runs of `gram` words."""
    m, span, have = grams(w, gram), length - gram + 1, 1
    while have < span:  # minima of doubling spans
        step = min(have, span - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def _batch(names: str, *arrays: list) -> pa.RecordBatch:
    kinds = {"s": pa.string(), "l": pa.int64()}
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kinds[n[0]]) for n, x in zip(names.split(), arrays)], names=[n[2:] for n in names.split()])


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (key, row, doc_id): the distinct anchors of a document; and (key, row, doc_id, other, n): two fingerprints and the number of words of each with `length` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, ids, ns, other = [], [], [], [], []
            for row, i, t in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text"))):
                words = t.split() if t and i is not None else []
                if len(words) < length:
                    continue
                w = _hashes().of(words)
                m = np.unique(window_anchors(w, length, gram))
                whole = mix(w + mix(np.arange(len(w), dtype=np.uint64)))
                keys += [whole.sum(keepdims=True), m]
                other += [mix(whole).sum(keepdims=True).view(np.int64), np.zeros(len(m), np.int64)]
                at.append(np.full(len(m) + 1, row))
                ids.append(np.full(len(m) + 1, i))
                ns += [np.array([len(w)]), np.zeros(len(m), np.int64)]
            if ids:
                yield _batch("l.key l.row l.doc_id l.other l.n", np.concatenate(keys).view(np.int64), *map(np.concatenate, (at, ids, other, ns)))

    return docs.mapInArrow(run, "key long, row long, doc_id long, other long, n long")


def windows(marked: DataFrame, length: int, gram: int) -> DataFrame:
    """(wh, row, doc_id, start) of the windows whose anchors are among the document's marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, rows, ids, starts = [], [], [], []
            for row, i, t, marks in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), batch["marks"]):
                words = t.split() if t else []
                if len(words) < length:
                    continue
                w = _hashes().of(words)
                at = np.flatnonzero(np.isin(window_anchors(w, length, gram), marks.values.to_numpy(zero_copy_only=False).view(np.uint64)))
                hs.append(grams(w, length)[at])
                rows.append(np.full(len(at), row))
                ids.append(np.full(len(at), i))
                starts.append(at)
            if ids:
                h, r, d, s = map(np.concatenate, (hs, rows, ids, starts))
                for x in range(0, len(h), 100_000):
                    yield _batch("l.wh l.row l.doc_id l.start", h[x : x + 100_000].view(np.int64), *(v[x : x + 100_000] for v in (r, d, s)))

    return marked.mapInArrow(run, "wh long, row long, doc_id long, start long")


def passages(owned: DataFrame, length: int) -> DataFrame:
    """(owner, row, doc_id, start, words): runs of windows with one owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for row, i, t, hits in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), batch["hits"]):
                start, owner = (hits.values.field(x).to_numpy(zero_copy_only=False) for x in ("start", "owner"))
                order = np.argsort(start, kind="stable")
                start, owner, words = start[order], owner[order], t.split()
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (owner[1:] != owner[:-1]), [True]]))
                for a, b in zip(cut[:-1], cut[1:]):
                    if start[b - 1] + length <= len(words):
                        for part, x in zip(rows, (int(owner[a]), row, i, int(start[a]), b" ".join(words[start[a] : start[b - 1] + length]).decode())):
                            part.append(x)
            yield _batch("l.owner l.row l.doc_id l.start s.words", *rows)

    return owned.mapInArrow(run, "owner long, row long, doc_id long, start long, words string")


class Automaton:
    """Suffix automaton of passages (lists of words); a sign of its own ends each passage."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last, self.ends = [-1], [0], 0, 0

    def add(self, words: list[str]) -> None:
        for w in words:
            self._extend(w)
        self.ends += 1
        self._extend(self.ends)  # a number: no word equals it

    def _extend(self, c: str | int) -> None:
        nxt, link, length = self.next, self.link, self.length
        new, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        self.last = new

    def spans(self, words: list[str], least: int) -> list[tuple[int, int]]:
        """Maximal spans covered by runs of at least `least` words that some passage holds, from the matching statistics of words."""
        out: list[tuple[int, int]] = []
        state, have = 0, 0
        nxt, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            if w in nxt[state]:
                state, have = nxt[state][w], have + 1
            if have >= least:
                a = i + 1 - have
                if out and a <= out[-1][1]:
                    out[-1] = (min(a, out[-1][0]), i + 1)
                else:
                    out.append((a, i + 1))
        return out


def matched(parts: DataFrame, length: int) -> DataFrame:
    """(row, start, end): what the automaton of a shard finds in the passages that ask it. Rows (shard, part, asks, row, start, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, machine = None, Automaton()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [])
            for shard, part, asks, i, start, words in zip(*(batch[c].to_pylist() for c in ("shard", "part", "asks", "row", "start", "words"))):
                if (shard, part) != key:
                    key, machine = (shard, part), Automaton()
                if not asks:
                    machine.add(words.split(" "))
                    continue
                for a, b in machine.spans(words.split(" "), length):
                    for x, y in zip(rows, (i, start + a, start + b)):
                        x.append(y)
            yield _batch("l.row l.start l.end", *rows)

    dealt = parts.repartition(spread(parts), "shard", "part").sortWithinPartitions("shard", "part", "asks")
    return dealt.mapInArrow(run, "row long, start long, end long")


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, start, end): spans of words that a document with a smaller doc_id holds. texts: row long (unique), doc_id long, text binary, best bucketed by row."""
    found = materialize(anchors(texts, length, gram), "anchors")
    heads = found.where("n > 0")
    first = heads.groupBy("key", "other").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = materialize(join_back(heads, first, "key", "other").where("doc_id > first").select("row", "n"), "copies")
    own = found.where("n = 0").join(copies.select("row"), "row", "left_anti")
    shared = own.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    marks = join_back(own, shared, "key").groupBy("row").agg(F.collect_list("key").alias("marks"))
    seen = materialize(windows(texts.join(marks, "row").select("row", "doc_id", "text", "marks"), length, gram), "windows")
    owners = seen.groupBy("wh").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("b")).where("owner < b").select("wh", "owner")
    hits = materialize(join_back(seen, owners, "wh").groupBy("row").agg(F.collect_list(F.struct("start", "owner")).alias("hits")), "hits")
    runs = materialize(passages(texts.join(hits, "row").select("row", "doc_id", "text", "hits"), length), "passages")
    size = (F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1).cast("long")
    asks = F.col("doc_id") != F.col("owner")
    total = runs.where(~asks).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD))
    dealt = runs.select(F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard"), asks.alias("asks"), "row", "start", "words")
    loads = dealt.where("asks").groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / PROBES)).cast("int").alias("parts"))
    both = dealt.join(loads, "shard")
    asking = both.where("asks").withColumn("part", F.pmod(F.xxhash64("row", "start"), F.col("parts")).cast("int"))
    held = both.where("not asks").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spans = matched(asking.unionByName(held).select("shard", "part", "asks", "row", "start", "words"), length)
    return spans.unionAll(copies.select("row", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))


def bucketed(docs: DataFrame) -> DataFrame:
    """row, doc_id and text (binary) of docs, in buckets of row in the shared folder: joins by row then leave the texts where they are. A row's number is what was written,
    so it is the same in every read. The catalog forgets the table at once, as its plan knows files and buckets."""
    spark, name = docs.sparkSession, f"urlmill_texts_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows.write.bucketBy(spread(docs), "row").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.schema  # resolved while the catalog has it
    spark.sql(f"DROP TABLE {name}")
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    texts = bucketed(docs)
    spans = repeated(texts, length, gram).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, gone, kept = batch["doc_id"], [], [], []
            for t, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                words = t.split() if t else []
                if spans:
                    lost = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        lost[min(s["start"], len(words))] += 1
                        lost[min(s["end"], len(words))] -= 1
                    words_left = [w for w, x in zip(words, np.cumsum(lost)[:-1].tolist()) if not x]
                else:
                    words_left = words
                n.append(len(words))
                gone.append(len(words) - len(words_left))
                kept.append(b" ".join(words_left).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {LENGTH} + 2)) AS i FROM w WHERE len(ws) >= {LENGTH}),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+{LENGTH - 1}], ' ')) AS h FROM s),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS o FROM h) WHERE o < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS p FROM d),
r AS (SELECT doc_id, list(p) AS ps FROM p GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(ps), 0) AS gone,
  CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END AS kept FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
