"""Operator 7 [native]: quality rules with risk-controlled thresholds.

Method: every rule has a score that grows as a document gets worse, and a cutoff that goes in STEPS equal steps from lenient to strict, all rules at once:
a fixed path that ends where published rules for web text stand. A document's level is the first step at which any rule rejects it. Labelled documents
that pass the base rules are the holdout. For each stratum (language class) the steps are tested from the most lenient on; a step holds if the exact
binomial tail P(X <= k | n, RISK) of its k rejections among the stratum's n good documents is at most CONFIDENCE / strata - fixed-sequence testing
along the path needs no correction, Bonferroni corrects over the strata. The last step before the first failure gives the stratum's cutoffs; where none
holds, the rules reject nothing there. So with confidence 1 - CONFIDENCE in no stratum are more than RISK of the good documents that
pass the base rules rejected by all rules together. A stratum needs log(CONFIDENCE / strata) / log(1 - RISK) = 182 good documents for any cutoff.

All of it is Spark SQL expressions: no Python runs on executors, and nothing but the driver-side plan is built in Python. A text's
measures need only that text, so documents are not shuffled; the steps chosen are at most 5 rows, broadcast.
Labels join their documents by doc_id; only measures (a few numbers a row) move.

Defined cases: a null or blank text has zero words and measures, fails the base rule and is not kept; a text of any length is measured whole, in one row; a null
lang is in the stratum "other"; labels with a null quality do not count, repeated ones count once, and each row of a repeated doc_id; no labels: only the base rule decides; repeated
rows are judged alike; empty table: empty result; other columns of the input are ignored by the query and kept by `filter_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, table

STRATA = ("en", "fr", "de", "es")
#: rule: (numerator, denominator) of its score
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "long_words": ("word_chars", "n_words"),
}
#: rule: its first and last cutoff
PATH = {"symbols": (3.0, 0.1), "repeats": (1.0, 0.2), "dup_lines": (1.0, 0.3), "long_words": (40.0, 10.0)}
STEPS = 30
RISK, CONFIDENCE = 0.025, 0.05
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = "[#*$%&|<>]"


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        *keep,
        F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    n = F.size("_words")
    hashed = base.select(
        *keep, "word_chars", "n_symbols", n.alias("n_words"), F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(n >= 3, F.zip_with(
            F.zip_with(F.slice("_words", 1, n - 2), F.slice("_words", 2, n - 2), lambda a, b: F.concat(a, F.lit(" "), b)),
            F.slice("_words", 3, n - 2), lambda a, b: F.xxhash64(a, b))).alias("_w3"),
    )
    # Sorted with their places, equal windows are neighbours.
    sorted_ = hashed.withColumn("_w3", F.when(F.size(F.array_distinct("_w3")) < F.size("_w3"), F.array_sort(F.transform("_w3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("_w3")
    same = sorted_.withColumn("_same", F.zip_with(F.slice("_w3", 1, m - 1), F.slice("_w3", 2, m - 1), lambda a, b: a.h == b.h))
    twin = F.zip_with(F.zip_with(F.col("_w3"), F.concat(F.array(F.lit(False)), F.col("_same")), lambda w, s: F.struct(w.i.alias("i"), s.alias("s"))),
                      F.concat(F.col("_same"), F.array(F.lit(False))), lambda w, s: F.when(w.s | s, w.i))
    places = same.withColumn("_at", F.array_sort(F.array_compact(twin)))
    k = F.size("_at")
    # A window covers three words, or as many as there are up to the next one.
    covered = F.aggregate(F.zip_with(F.slice("_at", 2, k - 1), F.slice("_at", 1, k - 1), lambda b, a: F.least(b - a, F.lit(3))), F.lit(3), lambda s, x: s + x)
    repeat = F.when(F.col("_at").isNull() | (k < 1), 0).otherwise(covered)
    cols = {"n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_lines": F.col("n_lines"), "n_dup_lines": F.col("n_dup_lines"), "n_repeat_words": repeat}
    return places.select(*keep, *[c.cast("long").alias(k) for k, c in cols.items()])


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise("other")


def score(rule: str) -> Column:
    """The score of a rule; 0 where there are no words or lines."""
    n, d = RULES[rule]
    return F.when(F.col(d) > 0, F.col(n).cast("double") / F.col(d)).otherwise(0.0)


def level() -> Column:
    """The first step at which a rule rejects: its cutoff lies below the score; STEPS + 1 if none does."""
    first = [F.floor((F.lit(lenient) - score(r)) / F.lit((lenient - strict) / STEPS)) + 1 for r, (lenient, strict) in PATH.items()]
    return F.greatest(F.lit(0), F.least(F.lit(STEPS + 1), *first)).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p), summed in logarithms term by term from 0 to k."""
    step = lambda s, i: F.struct(
        (s.t + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.log(F.lit(p / (1 - p)))).alias("t"),
        (s.p + F.exp(s.t + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.log(F.lit(p / (1 - p))))).alias("p"),
    )
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("p"))
    return F.when(k >= 1, F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda s: s.p)).otherwise(F.exp(n * F.log(F.lit(1 - p))))


def steps(good: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, step): the last step that the holdout supports, -1 for none. good: stratum and level of good labelled documents, counted by map-side sums."""
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("level") <= t).cast("long")).alias(f"k{t}") for t in range(STEPS + 1)])
    each = counts.select("stratum", "n", F.posexplode(F.array(*[F.col(f"k{t}") for t in range(STEPS + 1)])).alias("step", "k"))
    # From P(X <= k) <= level, k < n * risk follows, so longer sums are not needed.
    few = F.col("k") <= F.col("n") * risk
    holds = few & (tail(F.when(few, F.col("k")).otherwise(0), F.col("n"), risk) <= confidence / (len(STRATA) + 1))
    failed = F.min(F.when(~holds, F.col("step")))
    return each.groupBy("stratum").agg((F.coalesce(failed, F.lit(STEPS + 1)) - 1).alias("step"))


def cutoffs(chosen: DataFrame) -> DataFrame:
    """(stratum, rule, cutoff) of the steps chosen; score > cutoff rejects."""
    each = [F.struct(F.lit(r).alias("rule"), (F.lit(a) - F.col("step") * F.lit((a - b) / STEPS)).alias("cutoff")) for r, (a, b) in PATH.items()]
    return chosen.where("step >= 0").select("stratum", F.inline(F.array(*each)))


def judged(seen: DataFrame, good: DataFrame, *keep: str, **how) -> DataFrame:
    """base_failed and kept for measured documents `seen` with a lang; good: measured good documents of the holdout."""
    chosen = steps(good.where(~base_failed()).select(stratum(F.col("lang")).alias("stratum"), level().alias("level")), **how)
    joined = seen.withColumn("_stratum", stratum(F.col("lang"))).join(F.broadcast(chosen), F.col("_stratum") == F.col("stratum"), "left")
    passes = level() > F.coalesce(F.col("step"), F.lit(-1))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*[F.col(f"`{c}`") for c in keep], *names, base_failed().alias("base_failed"), (~base_failed() & passes).alias("kept"))


def holdout(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id").distinct()


def filter_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents kept, with all their columns. Texts are measured once: rows that the base rules leave are written with their measures, and the holdout is read from these."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "lang")
    # The number keeps the optimizer from moving filters and the join below the measures, where it would repeat them for each condition and move texts.
    number = F.monotonically_increasing_id()
    seen = measures(named, "_row", "doc_id", "lang").withColumn("_nr", number).where(~base_failed() & (F.col("_nr") >= 0))
    seen = materialize(seen.drop("_nr"), "measured")
    good = seen.drop("_row").join(holdout(labels), "doc_id", "left_semi")
    return judged(seen.drop("doc_id"), good, "_row", **how).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = materialize(measures(table(spark, sf_dir, "documents"), "doc_id", "lang"), "quality")
    good = seen.join(holdout(table(spark, sf_dir, "labels")), "doc_id", "left_semi")
    return judged(seen, good, "doc_id")


def _sql() -> str:
    words = f"regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')"
    first = ", ".join(f"floor(({a!r}::DOUBLE - CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0 END) / {(a - b) / STEPS!r}::DOUBLE) + 1" for (n, d), (a, b) in zip(RULES.values(), PATH.values()))
    return f"""
WITH w AS (SELECT doc_id, lang, {words} AS ws, coalesce(text, '') AS text,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, CASE WHEN lang IN {STRATA!r} THEN lang ELSE 'other' END AS stratum, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
seen AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m),
s AS (SELECT *, greatest(0, least({STEPS + 1}, {first})) AS level FROM seen),
good AS (SELECT stratum, level FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (level <= step) AS k FROM good, (SELECT unnest(range(0, {STEPS + 1})) AS step) GROUP BY ALL),
t AS (SELECT stratum, step, k <= n * {RISK!r} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r})))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) <= {CONFIDENCE / (len(STRATA) + 1)!r} AS ok FROM k),
f AS (SELECT stratum, coalesce(min(step) FILTER (NOT ok), {STEPS + 1}) - 1 AS step FROM t GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND level > coalesce(step, -1) AS kept FROM s LEFT JOIN f USING (stratum)
"""


SQL = _sql()
