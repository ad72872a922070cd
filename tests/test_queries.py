"""Every query of the library against its SQL twin."""

import duckdb
import pytest

from tests.conftest import same_rows
from urlmill import registry
from urlmill.plans.common import rounded


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    same_rows(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _both(spark, folder, name, **tables):
    """Rows of a query and of its twin, as they are: no rounding, signs of zeros kept."""
    con = duckdb.connect()
    for k, d in tables.items():
        d.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{k}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {k} AS SELECT * FROM '{folder}/{k}.parquet/*.parquet'")
    return [sorted(map(repr, map(tuple, x))) for x in (registry.QUERIES[name](spark, str(folder)).collect(), con.execute(registry.ORACLES[name]).fetchall())]


def test_correlations_equal_the_twin(spark, tmp_path):
    """Null values on either side, a target that does not vary, a correlation that rounds to a negative zero, and means halfway between two roundings."""
    kind, label = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"
    odd = [(i, "t", None if i % 3 == 0 else "e" * (i % 4), None if i % 7 == 0 else "s" * (i % 5), None if i % 5 == 0 else i * i) for i in range(40)]
    for quality in (lambda i: None if i % 4 == 0 else i % 2, lambda i: 1, lambda i: None):
        got, want = _both(spark, tmp_path, "pearson_vector", documents=spark.createDataFrame(odd, kind), labels=spark.createDataFrame([(i, quality(i), i // 11 % 2) for i in range(40)], label))
        assert got == want
    n = 16_000  # one in 16,000 is 0.0000625
    even = [(i, "t", "en", "s" * (1 + (i < 5)), 10**7 * (i // 2 % 2) + (i == 2)) for i in range(n)]
    got, want = _both(spark, tmp_path, "pearson_vector", documents=spark.createDataFrame(even, kind), labels=spark.createDataFrame([(i, i % 2, int(i in (3, 4, 5))) for i in range(n)], label))
    assert got == want and any("-0.0" in x for x in got)


@pytest.mark.parametrize("digits", [3, 6])
def test_rounding_is_that_of_the_twins(spark, digits):
    values = [s * (k / 16_000 + w) for s in (1.0, -1.0) for w in (0, 2, 37, 2456) for k in range(0, 400)] + [-1e-9, 1e-9, 0.0, None, float("nan")]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    got = {r.i: repr(r.y) for r in d.select("i", rounded("x", digits).alias("y")).collect()}
    want = dict(enumerate(repr(r[0]) for r in duckdb.connect().execute(f"SELECT round(x, {digits}) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [values]).fetchall()))
    assert got == want
