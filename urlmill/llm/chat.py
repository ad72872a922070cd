"""Operator 3: chat formatting, after the collapse of cumulative snapshots.

Method: every turn of a conversation gets the hash of all turns up to it, rolling along the conversation. A conversation whose last hash is a
proper prefix hash of another one is a snapshot of it: an anti-join drops it. Equal conversations collapse to the smallest conv_id.
What is left is rendered in chat markup.

The rolling hash is the exclusive-or of two 64-bit hashes of (place, role, text) over the turns so far, so it splits into chunks: places and
hashes are computed within chunks of CHUNK turn numbers and shifted by what earlier chunks hold. A conversation with a
large share of all turns therefore fills many tasks until its one text is put together, which takes the memory of that text in one task. Both sides of the anti-join are aggregated to distinct hashes
first (map-side), so a first turn that many conversations share is one row a task.

Defined cases: turns are in the order of turn (null first), role, text, and so are repeated rows, which count each; a null role renders
as "unknown" and a null text as empty, and both differ from other values in comparisons; rows with a null conv_id are one conversation; markup inside a
text loses its bars; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

CHUNK = 4096
START, END = "<|im_start|>", "<|im_end|>"


def places(turns: DataFrame, *ties: str) -> DataFrame:
    """turns with `place`, from 1, within each conv_id: by turn, then ties, null first. Sorted within CHUNK turn numbers, and shifted by what earlier chunks hold."""
    rows = turns.withColumn("_chunk", F.floor(F.col("turn") / CHUNK))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", *ties)])
    return _after(rows.withColumn("place", F.row_number().over(inside)), rows.groupBy("conv_id", "_chunk").agg(F.count(F.lit(1)).alias("place")), F.sum, lambda a, b: a + b)


def rolled(turns: DataFrame) -> DataFrame:
    """turns (conv_id, place, x1, x2 and others) with x1 and x2 as the exclusive-or of all up to this place; by chunks too."""
    rows = turns.withColumn("_chunk", F.floor((F.col("place") - 1) / CHUNK))
    run = Window.partitionBy("conv_id", "_chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "_chunk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    return _after(rows.withColumns({x: F.bit_xor(x).over(run) for x in ("x1", "x2")}), sums, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def _after(rows: DataFrame, per: DataFrame, fold, add) -> DataFrame:
    """The values of rows with those of earlier chunks of the conversation added; per: the values of each chunk."""
    earlier = Window.partitionBy("conv_id").orderBy(F.col("_chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in per.columns if c not in ("conv_id", "_chunk")]
    before = per.select(F.col("conv_id").alias("_c"), F.col("_chunk").alias("_k"), *[F.coalesce(fold(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in names])
    both = rows.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_chunk").eqNullSafe(F.col("_k")))
    return both.withColumns({c: add(F.col(c), F.col(f"_{c}")) for c in names}).drop("_c", "_k", "_chunk", *[f"_{c}" for c in names])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), h1, h2 of every turn: hashes of the conversation up to it."""
    placed = places(turns.select("conv_id", "turn", "role", "text"), "role", "text")
    of = lambda seed: F.xxhash64(*seed, "place", "role", F.col("role").isNull(), "text", F.col("text").isNull())
    return rolled(placed.select("conv_id", "place", of([]).alias("x1"), of([F.lit("b")]).alias("x2"))).select("conv_id", "place", F.col("x1").alias("h1"), F.col("x2").alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies (equal conversations) of those that no other conversation continues."""
    rolled = materialize(prefixes(turns), "chat")
    last = rolled.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    ends = last.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    sizes = last.select(F.col("conv_id").alias("_c"), F.col("place").alias("_n"))
    proper = rolled.join(sizes, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") < F.col("_n"))).select("place", "h1", "h2").distinct()
    return ends.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "copies")


def markup(role: Column, text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<$1>")
    return F.concat(F.lit(START), F.coalesce(role, F.lit("unknown")), F.lit("\n"), plain, F.lit(f"{END}\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text of every maximal conversation."""
    kept = maximal(turns).withColumnRenamed("conv_id", "_c")
    own = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_c")))
    parts = F.array_sort(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), markup(F.col("role"), F.col("text")).alias("m"))))
    out = own.groupBy("conv_id", "n_turns", "copies").agg(parts.alias("p"))
    return out.select("conv_id", "n_turns", "copies", F.array_join(F.col("p.m"), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH c AS (SELECT conv_id, list(coalesce(role, chr(0)) || chr(1) || coalesce(text, chr(0)) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l,
    string_agg('{START}' || coalesce(role, 'unknown') || chr(10) || regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<\\1>', 'g') || '{END}' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:n] AS l FROM (SELECT l, unnest(range(1, len(l))) AS n FROM c)),
m AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, l FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY l)
SELECT c.conv_id, CAST(len(c.l) AS BIGINT) AS n_turns, m.copies, c.text FROM m JOIN c ON c.conv_id IS NOT DISTINCT FROM m.conv_id
"""
