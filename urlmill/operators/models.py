"""Classifiers over feature columns, calibration of their scores, and how much each column matters to them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import roc_auc
from .ranks import key_bucket, with_hash_place, with_place


def fit_logistic(df: DataFrame, columns: list[str], label: str = "label", reg: float = 0.01) -> PipelineModel:
    """Standardised logistic regression of a 0/1 label; distributed by pyspark.ml."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", regParam=reg)]
    return Pipeline(stages=stages).fit(df)


def fit_boosting(df: DataFrame, columns: list[str], label: str = "label", rounds: int = 100, depth: int = 4, rate: float = 0.05, least: int = 50, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees of a 0/1 label over binned columns, at most 2 ** depth leaves of at least `least` rows each; distributed by pyspark.ml."""
    trees = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=least, seed=seed).setProbabilityCol("_p")
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip"), trees]).fit(df)


def _logit(score: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), score))
    return F.ln(p / (1 - p))


def fit_sigmoid(df: DataFrame, label: str = "label", score: str = "score") -> tuple[float, float]:
    """(slope, intercept) of the sigmoid of a score's logit that fits held-out labels best, with targets drawn in from 0 and 1 as small samples need.

    A target t is two weighted rows, 1 with weight t and 0 with 1 - t, summed per distinct score beforehand.
    """
    n = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if not n.p or not n.n:
        raise ValueError("calibration needs rows of both labels")
    target = F.when(F.col(label) == 1, (n.p + 1.0) / (n.p + 2.0)).otherwise(1.0 / (n.n + 2.0))
    per = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(score).agg(F.sum(target).alias("t"), F.count(F.lit(1)).alias("k"))
    rows = per.select(_logit(F.col(score)).alias("x"), F.inline(F.array(F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("y"), (F.col("k") - F.col("t")).alias("w")))))
    model = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", standardization=False, tol=1e-9, maxIter=200).fit(VectorAssembler(inputCols=["x"], outputCol="_x").transform(rows))
    return float(model.coefficients[0]), float(model.intercept)


def calibrated(df: DataFrame, slope: float, intercept: float, score: str = "score") -> DataFrame:
    """df with the score replaced by its calibrated form."""
    return df.withColumn(score, 1 / (1 + F.exp(-(slope * _logit(F.col(score)) + intercept))))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with score, the probability of label 1."""
    return model.transform(df).select(*df.columns, vector_to_array("_p")[1].alias("score"))


def importance(model: PipelineModel, df: DataFrame, columns: list[str], key: str, label: str = "label", seed: str = "imp") -> DataFrame:
    """(column, loss of AUC) when the values of a column are dealt to rows in another order; largest first."""
    auc = lambda d: roc_auc(predict(model, d).select(F.col(label).alias("label"), "score")).first()["auc"]
    whole, out = auc(df), []
    for c in columns:
        a = with_place(df, "_n", key_bucket(df, key), F.col(key)).drop(c)
        b = with_hash_place(df.select(key, c), "_n", f"{seed}{c}", key).select("_n", c)
        out.append((c, whole - auc(a.join(b, "_n").drop("_n"))))
    return df.sparkSession.createDataFrame(out, "column string, loss double").orderBy(F.desc("loss"))
