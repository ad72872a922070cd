"""Evaluation of binary classifiers over (label 0/1, score). Cumulative counts run over distinct scores, not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import score_bucket, with_place


def _div(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b)


def confusion(df: DataFrame, threshold: Column | float, *by: str) -> DataFrame:
    """n, tp, fp, tn, fn and the rates at a threshold, per group."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, y = F.col("score") >= t, F.col("label")
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 0)).alias("tn"), F.count_if(~hit & (y == 1)).alias("fn"))
    return with_rates(g)


def with_rates(g: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return g.withColumns({"accuracy": _div(tp + tn, tp + fp + tn + fn), "precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn), "f1": _div(2 * tp, 2 * tp + fp + fn), "fpr": _div(fp, fp + tn, None)})


def by_score(df: DataFrame) -> DataFrame:
    """score, p, n (its positives and negatives), tp, fp (at score >= it), all_p, all_n. Sums run within buckets of scores and over the buckets' totals."""
    g = df.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    g = g.withColumn("_bucket", score_bucket(F.col("score")))
    down, above, whole = Window.partitionBy("_bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = g.groupBy("_bucket").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    sums = {"_tp": F.coalesce(F.sum("_p").over(above), F.lit(0)), "_fp": F.coalesce(F.sum("_n").over(above), F.lit(0)), "all_p": F.sum("_p").over(whole), "all_n": F.sum("_n").over(whole)}
    inside = g.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)}).join(totals.select("_bucket", *[c.alias(k) for k, c in sums.items()]), "_bucket")
    return inside.select("score", "p", "n", (F.col("tp") + F.col("_tp")).alias("tp"), (F.col("fp") + F.col("_fp")).alias("fp"), "all_p", "all_n")


def roc_auc(df: DataFrame) -> DataFrame:
    """auc by ranks with ties counted half; null if a class is empty."""
    s = by_score(df)
    won = F.sum(F.col("p") * ((F.col("all_n") - F.col("fp")) + F.col("n") / F.lit(2.0)))
    return s.agg((won / F.nullif(F.max("all_p") * F.max("all_n"), F.lit(0))).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    return by_score(df).agg(F.sum(F.col("p") / F.nullif(F.col("all_p"), F.lit(0)) * (F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))).alias("average_precision"))


def losses(df: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Log-loss and Brier score."""
    p, y = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("score"))), F.col("label")
    return df.agg(F.avg(-F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"), F.avg(F.pow(F.col("score") - y, F.lit(2.0))).alias("brier"))


def sweep(df: DataFrame, low: float = 0.05, step: float = 0.05, count: int = 19) -> DataFrame:
    """Confusion counts at a grid of thresholds: each row meets all of them inside its own task."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(F.lit(low) + i * F.lit(step), 2))
    return confusion(df.withColumn("threshold", F.explode(grid)), F.col("threshold"), "threshold")


def best_f1(df: DataFrame, default: float = 0.5) -> DataFrame:
    """The grid threshold with the highest F1; the first of equals, `default` if none is above 0."""
    best = sweep(df).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b"))
    return best.select(F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(default).alias("threshold"), F.col("b.f1").alias("f1"))


def threshold_at_fpr(df: DataFrame, target: float) -> DataFrame:
    """The cut that catches most within a budget of false positives: highest (recall, -fpr), then the highest cut.

    A cut lies on a score, or just above the highest one, where nothing is flagged; `above` says which.
    """
    s = by_score(df)
    top = s.agg(F.max("score").alias("score"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n")).withColumn("above", F.lit(True))
    cuts = s.select("score", "tp", "fp", "all_p", "all_n").withColumn("above", F.lit(False)).unionByName(top)
    rates = cuts.select("score", "above", "tp", "fp", (F.col("tp") / F.col("all_p")).alias("recall"), (F.col("fp") / F.col("all_n")).alias("fpr")).where(F.col("fpr") <= target)
    best = rates.agg(F.max(F.struct("recall", (-F.col("fpr")).alias("nf"), "above", "score", "tp", "fp")).alias("b"))
    return best.select("b.score", "b.above", "b.recall", (-F.col("b.nf") + F.lit(0.0)).alias("fpr"), "b.tp", "b.fp")


def threshold_on_curve(df: DataFrame, target: float, fallback: float = 1.0) -> DataFrame:
    """The cut on a score that catches most within a rate of false positives, the highest of equals; `fallback` where no score keeps to it or a class is empty."""
    fits = (F.col("fp") <= target * F.col("all_n")) & (F.col("all_n") > 0) & (F.col("all_p") > 0)
    best = by_score(df).where(fits).agg(F.max(F.struct("tp", "score")).alias("b"))
    return best.select(F.coalesce("b.score", F.lit(float(fallback))).alias("threshold"), F.col("b").isNull().alias("fell_back"))


def balanced_accuracy(df: DataFrame, threshold: Column | float, *by: str) -> DataFrame:
    """Mean of the two classes' recalls per group; an empty class counts as 0."""
    g = confusion(df, threshold, *by)
    return g.select(*by, ((F.col("recall") + _div(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))) / 2).alias("balanced_accuracy"))


def control_gap(histories: DataFrame, least: float = 0.15) -> DataFrame:
    """Best F1 with true and with shuffled labels, their difference, and whether it shows a signal. Rows: shuffled, epoch, f1."""
    best = histories.agg(F.max(F.when(~F.col("shuffled"), F.col("f1"))).alias("real_best"), F.max(F.when(F.col("shuffled"), F.col("f1"))).alias("control_best"))
    gap = best.withColumn("gap", F.col("real_best") - F.col("control_best"))
    return gap.withColumn("valid", F.coalesce(F.col("gap") > least, F.lit(False)))


def two_cutoffs(df: DataFrame, max_fpr: float, min_recall: float) -> DataFrame:
    """block_from (most caught within max_fpr) and warn_from (fewest flagged at min_recall); warn falls to block if it lies above it."""
    s = by_score(df).select("score", (F.col("tp") / F.col("all_p")).alias("caught"), (F.col("fp") / F.col("all_n")).alias("flagged"))
    block = F.max(F.when(F.col("flagged") <= max_fpr, F.struct("caught", -F.col("flagged"), "score")))
    warn = F.max(F.when(F.col("caught") >= min_recall, F.struct(-F.col("flagged"), F.col("caught"), "score")))
    b = s.agg(block.alias("b"), warn.alias("w")).select(F.col("b.score").alias("block_from"), F.col("w.score").alias("warn_from"))
    return b.select(F.least("warn_from", "block_from").alias("warn_from"), "block_from")


def best_f1_cut(df: DataFrame) -> DataFrame:
    """The score with the highest F1 of the precision-recall curve."""
    s = by_score(df).withColumn("f1", 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_p")))
    return s.agg(F.max(F.struct("f1", "score")).alias("b")).select("b.score", "b.f1")


def slices(df: DataFrame, names: dict[str, Column], threshold: float) -> DataFrame:
    """Confusion per named slice; slices may overlap."""
    own = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names.items()]))
    return confusion(df.withColumn("slice", F.explode(own)), threshold, "slice")


def calibration(df: DataFrame, key: str, bins: int = 10) -> DataFrame:
    """Mean score and share of positives in bins of equal size, the first ones a row larger where rows are left over. Places come from buckets of the score, so no task sorts all rows."""
    n = df.count()
    size, over = n // bins, n % bins
    place = F.col("_place")
    rest = over + F.ceil((place - over * (size + 1)) / max(size, 1))
    b = with_place(df, "_place", score_bucket(F.col("score")), "score", key)
    b = b.withColumn("bin", F.when(place <= over * (size + 1), F.ceil(place / (size + 1))).otherwise(rest).cast("int"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("positives"))


def temperature(df: DataFrame, low: float = 0.5, high: float = 5.0, steps: int = 91) -> DataFrame:
    """The temperature of a grid with the least log-loss of logits / t, 1.0 if none is better. Input: label, logit."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.round(F.lit(low) + i * F.lit((high - low) / (steps - 1)), 4))
    x = F.col("logit") / F.col("t") * F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    nll = F.when(x < 0, F.log1p(F.exp(x)) - x).otherwise(F.log1p(F.exp(-x)))
    per = df.withColumn("t", F.explode(F.array_distinct(F.concat(grid, F.array(F.lit(1.0)))))).groupBy("t").agg(F.avg(nll).alias("nll"))
    best = per.agg(F.min_by(F.struct("t", "nll"), F.struct("nll", "t")).alias("b"), F.max(F.when(F.col("t") == 1.0, F.col("nll"))).alias("plain"))
    return best.select(F.when(F.col("b.nll") < F.col("plain"), F.col("b.t")).otherwise(1.0).alias("temperature"))


def early_stop(df: DataFrame, patience: int) -> DataFrame:
    """Adds best (so far), stale (epochs since it improved) and stopped to rows (epoch, loss)."""
    past = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("best", F.min("loss").over(past)).withColumn("_new", F.when(F.coalesce(F.col("loss") < F.min("loss").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)), F.col("epoch")))
    d = d.withColumn("stale", F.col("epoch") - F.max("_new").over(past))
    return d.withColumn("stopped", F.max(F.when(F.col("stale") >= patience, 1).otherwise(0)).over(past) == 1).drop("_new")


def errors(df: DataFrame, threshold: float, k: int = 10) -> DataFrame:
    """The k worst false positives and false negatives."""
    kind = F.when((F.col("label") == 0) & (F.col("score") >= threshold), "fp").when((F.col("label") == 1) & (F.col("score") < threshold), "fn")
    far = F.abs(F.col("score") - threshold)
    d = df.withColumn("kind", kind).where("kind is not null")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(far.desc(), "id"))).where(F.col("rank") <= k)
