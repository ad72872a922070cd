"""Sinks and sources of whole pages and arrays, and the table that takes upserts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from urlmill.sources import html_files, json_arrays
from urlmill.sources.upserts import UpsertTable


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def _objects(r):
    """Objects whose strings hold brackets, quotes, backslashes and characters of several bytes."""
    text = lambda: "".join(r.choice('{}[]",:\\\n é🙂ab') for _ in range(r.choice((0, 3, 40, 900))))
    return [{"id": i, "s": text(), "deep": [{"t": text(), "u": [[], {}]} for _ in range(r.randint(0, 3))], "n": r.choice((None, 1.5))} for i in range(24)]


@pytest.mark.parametrize("few", [json_arrays.FEW, 0])
@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_array_elements_equal_a_plain_parse(spark, tmp_path, small_splits, form, few):
    r, want = random.Random(7), []
    for name in ("a", "b"):
        objects = _objects(r)
        (tmp_path / f"{name}.json").write_text(json.dumps(objects, **form) + ("\n" if name == "a" else ""), encoding="utf-8")
        want += objects
    scan = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert scan.select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 10
    got = [json.loads(x.value) for x in json_arrays.elements(spark, str(tmp_path), few).collect()]
    order = lambda xs: sorted(json.dumps(x, sort_keys=True) for x in xs)
    assert order(got) == order(want)


def test_array_of_one_long_element_and_empty_ones(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(' [ {"s": "' + "}" * 5_000 + '"} ] ')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    rows = json_arrays.read_json_array(spark, str(tmp_path), "s string").collect()
    assert [x.s for x in rows] == ["}" * 5_000]


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "}', '[{"a": 1}, 2, {"a": 3}]'])
def test_array_faults_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="no closed JSON array|no object"):
        json_arrays.elements(spark, str(tmp_path)).collect()


def test_arrays_written_are_arrays(spark, tmp_path):
    d = spark.range(10).select("id", F.lit("}{").alias("s"), F.lit(None).cast("int").alias("n"))
    json_arrays.write_json_arrays(d.repartition(3).union(d.where("false")), str(tmp_path / "o"))
    files = [json.loads(p.read_text()) for p in (tmp_path / "o").glob("part-*")]
    assert len(files) >= 3 and sorted(x["id"] for f in files for x in f) == list(range(10)) and {"id": 3, "s": "}{", "n": None} in sum(files, [])


def test_html_files(spark, tmp_path):
    rows = [("phish", "A.b", "<p>é</p>"), ("phish", "A.b", "<p>é</p>"), ("benign", None, "x"), ("benign", "..", None), ("other", "h", "y"), (None, "h", "y"), ("phish", "h" * 300, "z" * 100_000)]
    d = spark.createDataFrame(rows, "label string, host string, html string").repartition(3)
    for _ in range(2):  # a rerun writes the same files again
        html_files.export_html(d, str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_text(encoding="utf-8") for p in tmp_path.glob("*/*")}
    assert sorted(found.values()) == sorted(["<p>é</p>", "x", "z" * 100_000])
    assert sum(n.startswith("phishing/a_b_") for n in found) == 1 and sum(n.startswith("benign/page_") for n in found) == 1
    assert (tmp_path / "_SUCCESS").exists() and not (tmp_path / "_writing").exists()


def test_html_files_cap_and_failed_tasks(spark, tmp_path):
    d = spark.range(40).select(F.lit("benign").alias("label"), F.lit("h").alias("host"), F.concat(F.lit("page "), "id").alias("html"))
    html_files.export_html(d, str(tmp_path / "a"), per_label=7)
    html_files.export_html(d.repartition(5), str(tmp_path / "b"), per_label=7)
    names = [{p.name for p in (tmp_path / x).glob("benign/*.html")} for x in "ab"]
    assert len(names[0]) == 7 and names[0] == names[1]
    broken = d.withColumn("html", F.when(F.col("html") == "page 30", F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        html_files.export_html(broken, str(tmp_path / "c"))
    assert not (tmp_path / "c" / "_SUCCESS").exists() and not (tmp_path / "c" / "_writing").exists()
    assert all(p.read_text().startswith("page ") for p in (tmp_path / "c").glob("benign/*.html"))


def _state(t):
    return {r[0]: tuple(r[1:]) for r in t.read().collect()}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    r, want = random.Random(3), {}
    t = UpsertTable.create(spark, str(tmp_path / "t"), "k string, n bigint, s string", "k", 5)
    assert not t.read().count()
    for step in range(3):
        batch = [(r.choice((None, *map(str, range(12)))), r.randint(0, 9), r.choice((None, "x", "y"))) for _ in range(10)]
        d = spark.createDataFrame(batch, "k string, n bigint, s string")
        assert t.upsert(d, f"s{step}", order="n", combine={"n": "coalesce(old.n, 0) + new.n"})
        best = {}
        for k, n, s in batch:
            best[k] = max(best.get(k, (-1, "")), (n, s or ""))
        for k, (n, s) in best.items():
            want[k] = (want.get(k, (0, None))[0] + n, s or None)
        assert _state(t) == want
        assert not t.upsert(d, f"s{step}") and _state(t) == want
    assert t.steps() == ["s0", "s1", "s2"]


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    t = UpsertTable.create(spark, str(tmp_path / "t"), "k bigint, n bigint", "k", 8)
    t.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("n")), "all")
    before = t.version()["folders"]
    t.upsert(spark.createDataFrame([(3, 1)], "k bigint, n bigint"), "one")
    after = t.version()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert t.read().count() == 100 and _state(t)[3] == (1,) and t.read(1).where("n = 1").count() == 0
    t.upsert(spark.createDataFrame([], "k bigint, n bigint"), "none")
    assert t.version()["folders"] == after
    assert t.vacuum() == 0 and t.read().count() == 100


def test_migrations_run_once_in_order(spark, tmp_path):
    t = UpsertTable.create(spark, str(tmp_path / "t"), "k bigint", "k", 2)
    t.upsert(spark.range(4).select(F.col("id").alias("k")), "rows")
    steps = {"002": [("b", "string", "'-'"), ("a", "int", "9")], "001": [("a", "int", "7")]}
    assert t.migrate(steps) == ["001", "002"] and t.migrate(steps) == []
    assert _state(t) == {i: (7, "-") for i in range(4)}
    t.upsert(spark.createDataFrame([(2, 5), (9, 6)], "k bigint, a int"), "more")
    assert _state(t) == {0: (7, "-"), 1: (7, "-"), 2: (5, "-"), 3: (7, "-"), 9: (6, "-")}
    assert t.migrate({"003": [("c", "date", "null")]}) == ["003"] and t.read().columns == ["k", "a", "b", "c"]


def test_a_lost_writer_and_two_writers(spark, tmp_path):
    t = UpsertTable.create(spark, str(tmp_path / "t"), "k bigint, n bigint", "k", 2)
    one = spark.createDataFrame([(1, 1)], "k bigint, n bigint")

    class Lost(UpsertTable):
        def _publish(self, content):
            raise RuntimeError("lost before the rename")

    with pytest.raises(RuntimeError):
        Lost(spark, t.path).upsert(one, "a")
    assert not t.read().count() and t.steps() == []
    assert t.upsert(one, "a") and _state(t) == {1: (1,)}
    assert t.vacuum() == 1

    class Late(UpsertTable):
        def _publish(self, content):
            UpsertTable(spark, self.path).upsert(spark.createDataFrame([(1, 2)], "k bigint, n bigint"), "b")
            super()._publish(content)

    with pytest.raises(Exception, match="FileAlreadyExists|already exists"):
        Late(spark, t.path).upsert(spark.createDataFrame([(1, 3)], "k bigint, n bigint"), "c")
    assert _state(t) == {1: (2,)} and t.steps() == ["a", "b"]
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(1, 1)], "k bigint, z int"), "d")
