"""The baseline model and the client cache."""

import random

from urlmill.operators import evaluation, models, state


def test_logistic_and_importance(spark):
    r = random.Random(1)
    rows = [(i, i % 2, (i % 2) + r.gauss(0, 0.5), r.gauss(0, 1)) for i in range(400)]
    d = spark.createDataFrame(rows, "id int, label int, good double, noise double")
    m = models.fit_logistic(d, ["good", "noise"])
    assert evaluation.roc_auc(models.predict(m, d).select("label", "score")).first().auc > 0.85
    assert models.importance(m, d, ["good", "noise"], "id").first().column == "good"


def test_host_cache(spark):
    rows = [("h", 0, "result", True), ("h", 10, "lookup", None), ("h", 99, "lookup", None), ("h", 100, "lookup", None), ("h", 110, "result", True), ("h", 120, "lookup", None), ("h", 130, "result", False), ("h", 140, "lookup", None), ("g", 5, "lookup", None)]
    d = spark.createDataFrame(rows, "host string, at long, kind string, keep boolean")
    assert {r.host: (r.lookups, r.hits) for r in state.host_cache(d, 100).collect()} == {"h": (5, 3), "g": (1, 0)}
