"""Shared pieces of queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:  # noqa: ANN001
    return ", ".join(quoted(v) for v in values)


def parts_sql(source: str, url: str = "url", keep: str = "*") -> str:
    """CTEs u and h: the parts of a URL column as the library has them."""
    p = quoted(PATTERN)
    return f"""
u AS (SELECT {keep}, lower(regexp_extract({url}, {p}, 1)) AS scheme, regexp_extract({url}, {p}, 2) AS authority, regexp_extract({url}, {p}, 3) AS path,
  regexp_extract({url}, {p}, 4) AS query, regexp_extract({url}, {p}, 5) AS fragment FROM {source}),
h AS (SELECT *, regexp_extract(authority, '^(.*)@', 1) AS userinfo, lower(regexp_extract(regexp_extract(authority, '([^@]*)$', 1), '^([^:]*)', 1)) AS host,
  regexp_extract(regexp_extract(authority, '([^@]*)$', 1), '^[^:]*:(.*)$', 1) AS port_text FROM u)"""


def entropy_sql(text: str) -> str:
    one = f"list_distinct(string_split({text}, ''))"
    return f"CASE WHEN length({text}) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_filter({one}, lambda c: c <> ''), lambda c: -((length({text}) - length(replace({text}, c, ''))) / length({text})::DOUBLE) * log2((length({text}) - length(replace({text}, c, ''))) / length({text})::DOUBLE))), 0.0) END"


def count_sql(text: str, piece: str) -> str:
    return f"CAST(length({text}) - length(replace({text}, '{piece}', '')) AS INT)"


def rounded(x: str | Column, digits: int) -> Column:
    """A double rounded as DuckDB's round does, which the twins use: the product with 10^digits goes to the nearest number, halves away from zero, and the sign stays on zero. Spark's round goes by the decimal digits instead."""
    x = F.col(x) if isinstance(x, str) else x
    near = F.round(F.abs(x) * F.lit(10.0**digits), 0) / F.lit(10.0**digits)
    return F.when(near == 0, x * 0.0).when(x < 0, -near).otherwise(near)
