"""Operator 8: mix sources to target weights.

Method: aggregate sizes per source, turn the targets into repetition rates, then emit each document
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.

The per-source table has one row per source after map-side aggregation; targets come from one sorted pass over it
(water filling in closed form) and are joined back by source. The join has one row per source on its small side, so
Spark broadcasts it below its own size threshold and splits skewed sources otherwise.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 has target 0;
repeated doc_ids are decided alike (the draw depends on the doc_id); an empty table gives an empty result; other columns are kept by
`mix` and ignored by the query. A null doc_id draws as the text "null".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, table

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all sizes, as a fraction
LIMIT = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed and doc_id only: the first 52 bits of their MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """(source, source_size, target, rate) of a table (source, size).

    A source's target is weight * level, at most limit * size. Sources in the order of their limit/weight stop one after
    another; the level is fixed at the first source whose own limit lies above the level that the rest would share.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", (limit * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share[0] / F.lit(float(share[1]))
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    per = per.withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy()))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("at.level"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def plan(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row of docs."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    per = targets(sized, **how).withColumnRenamed("source", "_source")
    joined = sized.join(per, F.col("source").eqNullSafe(F.col("_source")), "left")
    copies = F.floor("rate") + (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """docs with every row as often as the mix takes it; copies are equal rows."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    per = targets(sized.select("source", "size"), **how).select(F.col("source").alias("_of"), F.col("rate").alias("_rate"))
    joined = sized.join(per, F.col("source").eqNullSafe(F.col("_of")), "left")
    copies = F.floor("_rate") + (draw(F.col("doc_id"), seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, CAST(list_extract([5,2,1], CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS weight,
  CAST(2 * source_size AS DOUBLE) AS cap FROM per),
leveled AS (SELECT *, cap / weight AS r,
  ((SELECT sum(source_size) FROM per) * 3 / 2.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM named),
fixed AS (SELECT level AS lvl FROM leveled WHERE level * weight <= cap ORDER BY r, level LIMIT 1),
aimed AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT lvl FROM fixed), cap)) AS target FROM leveled),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aimed)
SELECT s.doc_id, s.size, CAST(a.source_size AS BIGINT) AS source_size, a.target,
  CAST(s.size * (floor(a.rate) + CASE WHEN CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE
    < a.rate - floor(a.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated a ON s.source IS NOT DISTINCT FROM a.source
"""
