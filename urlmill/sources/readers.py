"""Sources and sinks with fixed schemas."""

from __future__ import annotations

import io
import json
import time
import uuid
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import hash_order, sample, shard_indices
from .json_arrays import read_json_array  # noqa: F401


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header (a byte-order mark is dropped), all columns as strings; fails fast if a required column is missing."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if lost := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed column order; the committer makes the result appear at once."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def write_csv_file(df: DataFrame, path: str, columns: list[str], tries: int = 3) -> None:
    """One CSV file: one task writes it to a folder beside, which is renamed into place; a refused rename is tried again. For tables that one task can write."""
    fs, make = _files(df.sparkSession, path)
    beside = f"{path}.part-{uuid.uuid4().hex}"
    try:
        df.select(*columns).coalesce(1).write.option("header", True).option("lineSep", "\n").csv(beside)
        part = next(s.getPath() for s in fs.listStatus(make(beside)) if s.getPath().getName().startswith("part-"))
        for left in range(tries - 1, -1, -1):
            fs.delete(make(path), False)
            if fs.rename(part, make(path)):
                return
            if not left:
                raise OSError(f"could not rename to {path}")
            time.sleep(0.2)
    finally:
        fs.delete(make(beside), True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept, in as many files as df has partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(splits: dict[str, DataFrame], path: str, *columns: str) -> None:
    """The identities of all splits as JSON lines: split and the given columns."""
    rows = [d.select(F.lit(n).alias("split"), *columns) for n, d in splits.items()]
    write_json_lines(reduce(DataFrame.unionByName, rows), path)


def sample_shards(spark: SparkSession, paths: list[str], wanted: int, key: str, label: str, per_class: int, seed: str, columns: list[str]) -> DataFrame:
    """A balanced sample of evenly spaced shards in two scans: labels and keys alone choose, and only then are the chosen rows read in full."""
    chosen = sample(read_shards(spark, paths, wanted, [key, label]), per_class, seed, key, label).select(key)
    return read_shards(spark, paths, wanted, columns).join(chosen, key, "left_semi")


def read_shards(spark: SparkSession, paths: list[str], wanted: int, columns: list[str]) -> DataFrame:
    """Evenly spaced Parquet shards, read with the given columns only."""
    return spark.read.parquet(*[sorted(paths)[i] for i in shard_indices(len(paths), wanted)]).select(*columns)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """value: trimmed lines that are neither blank nor comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith(comment))


def read_html_folders(spark: SparkSession, root: str) -> DataFrame:
    """path, label (name of the folder), html of root/<label>/*.html."""
    df = spark.read.text(f"{root}/*/*.html", wholetext=True).withColumn("path", F.input_file_name())
    return df.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"), F.col("value").alias("html"))


def quota_sample(rows: DataFrame, seen: DataFrame, least: int, quota: int, seed: str) -> DataFrame:
    """Rows of at least `least` characters, unknown and distinct by hash, up to quota per label."""
    fresh = rows.where(F.length("html") >= least).join(seen.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])
    return sample(fresh, quota, seed, "sha256", "label_id")


def read_popular(spark: SparkSession, data: bytes | str, top: int, least: int = 1) -> DataFrame:
    """domain of the first `top` ranks of a rank,domain list: a CSV path, or the bytes of a ZIP with one CSV. A list shorter than least is refused."""
    if isinstance(data, bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            rows = [x.split(",", 1) for x in z.read(z.namelist()[0]).decode().splitlines() if "," in x]
        df = spark.createDataFrame([(int(r), d) for r, d in rows], "rank int, domain string")
    else:
        df = spark.read.schema("rank int, domain string").csv(data)
    out = df.where(F.col("rank") <= top).select(F.lower(F.trim("domain")).alias("domain")).where("domain <> ''").distinct()
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} domains")
    return out


def cached_sample(spark: SparkSession, folder: str, config: dict, build, needed: tuple[str, ...] = ()) -> DataFrame:  # noqa: ANN001
    """The stored sample if it was made with the same config and all needed files of the folder exist, else a new one. folder: any path that Spark can write to."""
    fs, make = _files(spark, folder)
    note = f"{folder}/config"
    made = all(fs.exists(make(f"{folder}/{f}")) for f in ("rows/_SUCCESS", "config/_SUCCESS", *needed))
    if made and [json.loads(r.value) for r in spark.read.text(note).collect()] == [config]:
        return spark.read.parquet(f"{folder}/rows")
    # The note goes first and comes last, so that a broken run leaves none.
    fs.delete(make(note), True)
    build().write.mode("overwrite").parquet(f"{folder}/rows")
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(note)
    return spark.read.parquet(f"{folder}/rows")


def append(df: DataFrame, path: str) -> None:
    """Append to a log; schemas may grow."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def with_report_id(reports: DataFrame, start: int = 0) -> DataFrame:
    """Reports with ids that depend on their content and time only."""
    return reports.withColumn("report_id", F.conv(F.substring(hash_order("report", F.col("created_at"), F.col("url"), F.col("client"), F.col("reason")), 1, 15), 16, 10).cast("long") + start)
