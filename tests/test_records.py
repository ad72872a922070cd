"""Folds, calibrated models, bounded caches, sinks and blobs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from urlmill.functions import guards
from urlmill.operators import evaluation, folds, inspect, models, state
from urlmill.sources import blobs, readers


def test_folds_keep_groups_whole_and_alike(spark):
    r = random.Random(4)
    rows = [(f"g{g}", int(r.random() < 0.3)) for g in range(300) for _ in range(r.randint(1, 6))] + [(None, 1), (None, 0)]
    d = spark.createDataFrame(rows, "g string, label int")
    got = folds.with_folds(d, "g", "label", "s", 5)
    per = got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("p")).collect()
    assert got.count() == len(rows) and len(per) == 5
    assert max(x.n for x in per) < 1.15 * min(x.n for x in per) and max(x.p for x in per) - min(x.p for x in per) < 0.08
    assert got.select("g", "fold").distinct().count() == 301
    ways = folds.three_way(d, "g", "label", "s")
    assert ways.count() == len(rows) and ways.select("g", "split").distinct().count() == 301
    assert not folds.group_folds(d.where("false"), "g", "label", "s").count()


def test_curve_threshold(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    at = lambda t: tuple(evaluation.threshold_on_curve(d, t).first())
    assert at(0.0) == (0.9, False) and at(0.5) == (0.8, False) and at(-1.0) == (1.0, True)
    assert tuple(evaluation.threshold_on_curve(d.where("label = 1"), 0.5).first()) == (1.0, True)


def test_boosting_learns_what_a_line_cannot(spark):
    r = random.Random(2)
    rows = [(i, *(p := (r.uniform(-1, 1), r.uniform(-1, 1))), int(p[0] * p[1] > 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "id int, a double, b double, label int")
    auc = lambda m: evaluation.roc_auc(models.predict(m, d).select("label", "score")).first().auc
    assert auc(models.fit_logistic(d, ["a", "b"])) < 0.65 < 0.9 < auc(models.fit_boosting(d, ["a", "b"], rounds=8, rate=0.3, least=5))


def test_sigmoid_calibration(spark):
    r = random.Random(3)
    logits = [r.gauss(0, 2) for _ in range(6000)]
    # True logits are half the scored ones, plus 1.
    rows = [(1 / (1 + math.exp(-x)), int(r.random() < 1 / (1 + math.exp(-(0.5 * x + 1))))) for x in logits]
    d = spark.createDataFrame(rows, "score double, label int")
    slope, intercept = models.fit_sigmoid(d)
    assert abs(slope - 0.5) < 0.06 and abs(intercept - 1) < 0.1
    loss = lambda x: evaluation.losses(x).first().log_loss
    assert loss(models.calibrated(d, slope, intercept)) < loss(d)
    with pytest.raises(ValueError):
        models.fit_sigmoid(d.where("label = 1"))


def test_bounded_cache_against_a_plain_one(spark):
    r = random.Random(5)
    rows = [("c", f"h{r.randint(0, 6)}", t, r.choice(["lookup", "result"]), r.random() < 0.8) for t in range(0, 900, 3)]
    held, hits = {}, 0
    for _, host, t, kind, keep in rows:
        if kind == "lookup":
            if host in held and t - held[host] < 60:
                hits += 1
            else:
                held.pop(host, None)
        elif keep:
            held[host] = t
            while len(held) > 4:
                held.pop(min(held, key=held.get))
        else:
            held.pop(host, None)
    d = spark.createDataFrame(rows, "client string, host string, at long, kind string, keep boolean")
    got = state.bounded_cache(d, 60, 4).first()
    assert (got.lookups, got.hits, got.held) == (sum(x[3] == "lookup" for x in rows), hits, len(held))


def test_inspection_and_report(spark):
    d = spark.createDataFrame([("http://a.test/", "0"), ("http://a.test/ ", "1"), ("HTTP://A.test", "1"), (None, "x"), ("", "0")], "url string, label string")
    got = {(r.measure, r.value): r["rows"] for r in inspect.inspect_source(d, "url", "label").collect()}
    assert got[("rows", "")] == 5 and got[("labelled", "")] == 4 and got[("valid", "")] == 3 and got[("rejected", "empty_url")] == 1
    assert got[("exact_urls", "")] == 3 and got[("exact_repeats", "")] == 1 and got[("conflict_rows", "")] == 3 and got[("invalid_label", "x")] == 1 and got[("missing", "url")] == 2
    empty = {(r.measure, r.value): r["rows"] for r in inspect.inspect_source(d.where("false"), "url", "label").collect()}
    assert set(empty.values()) == {0}
    assert inspect.markdown("T", ["a", "b"], [(1200, 0.5), ("x|y", None)]) == "## T\n\n| a | b |\n|---|---|\n| 1,200 | 0.5000 |\n| x\\|y |  |\n"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(i, f"k{i}", i % 2, "x" * i) for i in range(20)], "id int, sha256 string, label_id int, html string")
    for n in (5, 20):
        readers.write_csv_file(d.where(f"id < {n}"), f"{tmp_path}/one.csv", ["sha256", "id"])
        lines = (tmp_path / "one.csv").read_text().splitlines()
        assert lines[0] == "sha256,id" and len(lines) == n + 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["one.csv"]
    readers.write_manifest({"a": d.where("id < 3"), "b": d.where("id = 3")}, f"{tmp_path}/m", "sha256", "label_id")
    m = readers.read_json_lines(spark, f"{tmp_path}/m", "split string, sha256 string, label_id int")
    assert m.groupBy("split").count().orderBy("split").collect() == [("a", 3), ("b", 1)]
    d.repartition(4).write.parquet(f"{tmp_path}/shards")
    files = [str(p) for p in (tmp_path / "shards").glob("*.parquet")]
    some = readers.sample_shards(spark, files, len(files), "sha256", "label_id", 4, "s", ["sha256", "label_id", "html"])
    assert some.groupBy("label_id").count().orderBy("label_id").collect() == [(0, 4), (1, 4)]


def test_cached_sample(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for config, times in (({"k": 1}, 1), ({"k": 1}, 1), ({"k": 2}, 2)):
        assert readers.cached_sample(spark, f"{tmp_path}/c", config, build).count() == 3 and len(made) == times
    assert readers.cached_sample(spark, f"{tmp_path}/c", json.loads('{"k": 2}'), build, ("lost.bin",)).count() == 3 and len(made) == 3


def test_blobs(spark, tmp_path):
    jpeg = b"\xff\xd8\xff"
    blobs.put(spark.createDataFrame([("a", 1, jpeg + b"1"), ("a", 3, jpeg + b"3"), ("b", 1, b"text"), ("c", 1, None)], "key string, at long, content binary"), f"{tmp_path}/b")
    blobs.put(spark.createDataFrame([("a", 2, jpeg + b"2")], "key string, at long, content binary"), f"{tmp_path}/b")
    got = blobs.fetch(spark, f"{tmp_path}/b", spark.createDataFrame([("a",), ("b",)], "key string"))
    assert {r.key: r.content and bytes(r.content) for r in got.collect()} == {"a": jpeg + b"3", "b": None}


def test_bounds_of_ids(spark):
    d = spark.createDataFrame([([],), ([1],), ([1, None],), (list(range(200)),), (list(range(201)),), (None,)], "ids array<int>")
    assert [r[0] for r in d.select(guards.ids_in_bounds(F.col("ids"))).collect()] == [False, True, False, True, False, False]
