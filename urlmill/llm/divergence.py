"""Operator 11: source divergence audit - how far the term frequencies of a language's sources lie apart, pair by pair, and which terms set a source apart.

Method: deduplicate count columns. A term's counts over the sources of its language are a sparse vector; most rare terms share theirs with others. Terms
are grouped by identical vectors, every pair of sources is evaluated once per distinct vector, and the value counts as often as terms have the vector. Then the
original terms are ranked.

A pair of sources (s, t) takes f(p_s, p_t) from every kept term, also from terms that neither or only one of them has. With z the p of a count of 0,

    f(p_s, p_t) = f(z_s, z_t) + [f(p_s, z_t) - f(z_s, z_t)] + [f(z_s, p_t) - f(z_s, z_t)] + g,

where a bracket is 0 if that side has no count, and g is 0 if either has none. So the first is one product a pair, brackets need one row per distinct count of a source,
and only g is evaluated on vectors, for the sources in them: the zeros of a sparse vector cost nothing. All of it is integers: p by decimals, f and its sums in longs (a sum of f
over a language is below 2 * 10^9 + 2 * terms).

Scale: tasks count the words of whole texts into (lang, source, term) rows, at most HELD of them at a time, so a word that every document has is one row a task and source before the shuffle. A
vector holds at most the sources of a language, and the result holds a row for every pair of them. Nothing is keyed by language or source alone but counts that are
summed map-side, the list of sources, and top ranks, which Spark limits before their shuffle. Joins with totals are made from written tables, so AQE broadcasts small ones and splits hot keys.

Defined cases: null text, lang and source are '' ; a blank text still makes its group occur; a very long text is one count in memory; repeated rows count each, as documents of their own; ties rank by
the UTF-8 bytes of the item; a language without kept terms has value 0 for all pairs and no terms; one source alone: no pairs; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table, tidy

LEAST, SCALE, TOP, HELD = 10, 1_000_000_000, 10, 300_000
#: Letters lower-cased, other ASCII a space; bytes of other characters stay.
LETTERS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of what a task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        having: dict[tuple, Counter] = defaultdict(Counter)
        since = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                own, names = having[lang, source], list(terms)
                for x in range(0, len(names), 50_000):
                    part = names[x : x + 50_000]
                    cols = [pa.array([v] * len(part), pa.string()) for v in (lang, source)]
                    cols += [pa.array(part, pa.binary()).cast(pa.string())] + [pa.array([c[t] for t in part], pa.int64()) for c in (terms, own)]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            n.clear()
            having.clear()

        for batch in slices(batches):
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text"))):
                words = text.translate(LETTERS).split()
                n[lang, source].update(words)
                having[lang, source].update(set(words))
                since += len(words)
            if since > HELD:  # as many distinct terms at most
                since = sum(map(len, n.values()))
                if since > HELD:
                    yield from flush()
                    since = 0
        yield from flush()
        tidy()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count among `total` occurrences of `terms` kept terms, in parts of SCALE."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2), whole(total + 2 * terms)) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of a language's sources, and the `top` terms of each source, by divergence."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(blank("lang"), blank("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sums = counted(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("v")
    kept = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector).where(F.col("docs") >= least)
    terms = materialize(kept.select("lang", "term", "v"), "divergence-terms")
    vectors = materialize(terms.groupBy("lang", "v").agg(F.min("term").alias("head"), F.count(F.lit(1)).alias("m")), "divergence-vectors")

    totals = vectors.select("lang", "m", F.inline("v")).groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    langs = vectors.groupBy("lang").agg(F.sum("m").alias("terms"), F.sum(F.col("m") * F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.n)).alias("all"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "all"])
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
    groups = materialize(groups.withColumn("z", zero), "divergence-groups")

    # One row for each source of each distinct vector, with p there and q of the language.
    entries = vectors.withColumn("count", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.n)).select("lang", "head", "m", "count", F.inline("v"))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("count"), F.col("all"), F.col("terms"))
    entries = materialize(entries.join(groups, ["lang", "source"]).select("lang", "head", "m", "source", "z", p.alias("p"), q.alias("q")), "divergence-entries")

    pairs = groups.select("lang", "source", "z", "terms").join(groups.selectExpr("lang", "source AS item", "z AS z_"), "lang").where("source <> item")
    both_ways = lambda df: df.select("lang", F.inline(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    p, q, z, z_ = map(F.col, ("p", "p_", "z", "z_"))
    none = pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * gap(z, z_), F.lit(0)).alias("value"))
    counts = entries.groupBy("lang", "source", "p").agg(F.sum("m").alias("m"))
    one = pairs.join(counts, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (gap(p, z_) - gap(z, z_))).alias("value"))
    met = entries.select("lang", "head", "m", "source", "p", "z").join(entries.selectExpr("lang", "head", "source AS item", "p AS p_", "z AS z_"), ["lang", "head"]).where("source < item")
    both = met.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (gap(p, q) - gap(p, z_) - gap(z, q) + gap(z, z_))).alias("value"))
    apart = none.unionByName(both_ways(one)).unionByName(both_ways(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    # Terms of the first `top` values are among the vectors of the first `top` values.
    by = Window.partitionBy("lang", "source")
    best = entries.where("p > q").select("lang", "head", "source", gap(F.col("p"), F.col("q")).alias("value"))
    best = best.withColumn("place", F.dense_rank().over(by.orderBy(F.desc("value")))).where(F.col("place") <= top).drop("place")
    heads = terms.join(vectors.select("lang", "v", "head"), ["lang", "v"]).select("lang", "head", F.col("term").alias("item"))
    rank = F.row_number().over(by.orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(apart, "pair").unionByName(ranked(best.join(heads, ["lang", "head"]), "term").where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, i, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS own, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * v.v) AS p, 1 + {SCALE}::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE own > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
