"""What a raw source holds, in one long table, and its rendering as text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import strip, train_normalize
from .profile import invalid_labels, missing

VALID = ("0", "1")


def inspect_source(df: DataFrame, url: str, label: str) -> DataFrame:
    """(measure, value, rows) of a source of labelled URLs as text: rows; labels and invalid labels by value; missing values by column; distinct and repeated trimmed URLs;
    URLs that normalisation changes, strips of credentials or rejects, by reason; distinct, repeated and conflicting normalised URLs.

    A row with an invalid label counts in rows, missing and invalid_label only. A measure of no rows is 0, a value of no rows is left out.
    """
    text = F.trim(F.coalesce(F.col(label).cast("string"), F.lit("")))
    good = df.where(text.isin(*VALID)).select(strip(F.coalesce(F.col(url), F.lit(""))).alias("_raw"), text.alias("_label"))
    # Rows of a text and label meet first, so each distinct text is normalised once, in one branch of the plan.
    per = good.groupBy("_raw", "_label").agg(F.count(F.lit(1)).alias("k"))
    n = train_normalize(per, "_raw")
    number = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    mask = F.bit_or(F.when(F.col("_label") == "0", 1).otherwise(2))
    value, reason = F.col("normalized.value"), F.col("normalized.reason")
    keys = n.groupBy(value.alias("value"), reason.alias("reason")).agg(F.sum("k").alias("k"), mask.alias("m"), number(value != F.col("_raw")).alias("changed"), number(F.col("normalized.has_userinfo")).alias("stripped"))
    valid = F.col("reason").isNull()
    both = F.col("m") == 3
    sums = keys.groupBy("reason").agg(F.sum("k").alias("k"), F.sum("changed").alias("changed"), F.sum("stripped").alias("stripped"), F.count(F.lit(1)).alias("urls"), F.count_if(both).alias("conflicts"), F.sum(F.when(both, F.col("k")).otherwise(0)).alias("conflict_rows"))
    named = {"labelled": F.col("k"), "valid": F.col("k"), "changed": F.col("changed"), "credentials_stripped": F.col("stripped"), "normalized_urls": F.col("urls"), "normalized_repeats": F.col("k") - F.col("urls"), "conflicts": F.col("conflicts"), "conflict_rows": F.col("conflict_rows")}
    row = lambda m, v, c: F.struct(m.alias("measure"), v.alias("value"), c.cast("long").alias("rows"))
    ours = sums.select(F.inline(F.array(
        *[row(F.lit(m), F.lit(""), c if m == "labelled" else F.when(valid, c).otherwise(0)) for m, c in named.items()], row(F.lit("rejected"), F.coalesce("reason", F.lit("")), F.when(~valid, F.col("k")))
    ))).where("rows is not null")
    exact = per.groupBy("_raw").agg(F.sum("k").alias("k")).agg(F.count(F.lit(1)).alias("exact_urls"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("exact_repeats"))
    wide = [df.agg(F.count(F.lit(1)).alias("rows")), exact]
    none = df.sparkSession.range(1).select(F.inline(F.array(*[row(F.lit(m), F.lit(""), F.lit(0)) for m in named])))
    out = [none, ours]
    out += [w.unpivot([], w.columns, "measure", "rows").select("measure", F.lit("").alias("value"), "rows") for w in wide]
    out.append(per.groupBy(F.col("_label").alias("value")).agg(F.sum("k").alias("rows")).select(F.lit("label").alias("measure"), "value", "rows"))
    out.append(invalid_labels(df, label, VALID).select(F.lit("invalid_label").alias("measure"), F.when(F.col("value") == "", "<empty>").otherwise(F.col("value")).alias("value"), "rows"))
    out.append(missing(df).where("missing > 0").select(F.lit("missing").alias("measure"), F.col("column").alias("value"), F.col("missing").alias("rows")))
    all_ = reduce(DataFrame.unionByName, out)
    return all_.groupBy("measure", "value").agg(F.sum(F.col("rows").cast("long")).alias("rows"))


def markdown(title: str, columns: Iterable[str], rows: Iterable[Iterable]) -> str:
    """A heading and a table; of a summary that fits the driver, hence no DataFrame."""
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    names = list(columns)
    return "\n".join([f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""])
