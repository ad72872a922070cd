"""A keyed table that takes upserts and migrations, as Parquet in key buckets with a ledger of applied steps.

Rows lie in buckets of their key's hash. An upsert joins its rows with the buckets that they touch and writes those alone, in a folder of their own; the others stay where they are. Then one rename publishes a version: a
small file with the folder of every bucket, the columns, and the steps applied so far. Readers see the version before or the one after. A step that the ledger names is not applied again, so a job that failed at any
point is run again as a whole; what an unpublished attempt wrote is read by nobody and goes with `vacuum`. Two writers who start from one version can't both publish: the second gets an error and may run again.

Migrations only add columns. No data are rewritten: a bucket's entry says how many columns its files have, and later ones are read as their defaults.

Scale: an upsert reads and writes buckets, not the table, so its cost follows the batch where keys are near each other and the table where they touch all buckets; `buckets` should keep one near 100 MB to 1 GB. Keys are unique in the
table, and hash evenly; a batch is reduced to one row a key before it is shuffled to the buckets, so a hot key does not fill one. The driver holds the version: one entry a bucket, one name a step.

Defined cases: a null key is a key; rows of one key in a batch are reduced to the one greatest by `order`, then by all columns; an empty batch enters the ledger and changes nothing; further columns of a batch are an error, lacking ones leave
old values (new keys get the default).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _files

BUCKETS = 64


class UpsertTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS) -> UpsertTable:
        """A new table; schema: its columns in DDL, without defaults."""
        columns = [[f.name, f.dataType.simpleString(), "null"] for f in spark.createDataFrame([], schema).schema]
        if key not in [c[0] for c in columns]:
            raise ValueError(f"no column {key}")
        made = cls(spark, path)
        made._publish({"version": 0, "key": key, "buckets": buckets, "columns": columns, "steps": [], "folders": {}})
        return made

    def _versions(self) -> list[int]:
        fs, make = _files(self.spark, self.path)
        at = make(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def version(self, number: int | None = None) -> dict:
        """The content of a version, the newest if none is named."""
        if number is None:
            found = self._versions()
            if not found:
                raise ValueError(f"no table at {self.path}")
            number = found[-1]
        return json.loads(self.spark.read.text(f"{self.path}/versions/{number:010d}", wholetext=True).first().value)

    def _publish(self, content: dict) -> None:
        """Renames a whole file into place; an error if this version is there."""
        fs, make = _files(self.spark, self.path)
        jvm = self.spark._jvm
        beside, final = make(f"{self.path}/writing/{uuid.uuid4().hex}"), make(f"{self.path}/versions/{content['version']:010d}")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        # Unlike a file system's own rename, this one never replaces a file.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, final, how)

    def _rows(self, v: dict, only: set[str] | None = None) -> DataFrame:
        """The rows of all buckets, or some, with `_bucket`."""
        kinds: dict[int, list[str]] = {}
        for bucket, (folder, width) in v["folders"].items():
            if only is None or bucket in only:
                kinds.setdefault(width, []).append(f"{self.path}/{folder}/_bucket={bucket}")
        parts = []
        for width, paths in kinds.items():
            schema = ", ".join(f"`{n}` {t}" for n, t, _ in v["columns"][:width])
            parts.append(self.spark.read.schema(schema).parquet(*paths).selectExpr("*", *[f"CAST({d} AS {t}) AS `{n}`" for n, t, d in v["columns"][width:]]))
        empty = self.spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t, _ in v["columns"]))
        return reduce(DataFrame.unionByName, parts, empty) if not parts else reduce(DataFrame.unionByName, parts)

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of a version, the newest if none is named."""
        return self._rows(self.version(number))

    def steps(self) -> list[str]:
        """The ledger: names of the applied steps in order."""
        return self.version()["steps"]

    def migrate(self, steps: dict[str, list[tuple[str, str, str]]]) -> list[str]:
        """Applies, in order of their names, the steps that the ledger lacks; each adds columns of (name, type, default in SQL), but for those that are there. Returns the names applied."""
        v, done = self.version(), []
        for name in sorted(set(steps) - set(v["steps"])):
            have = {c[0] for c in v["columns"]}
            v = {**v, "version": v["version"] + 1, "columns": v["columns"] + [list(c) for c in steps[name] if c[0] not in have], "steps": [*v["steps"], name]}
            self._publish(v)
            done.append(name)
        return done

    def upsert(self, rows: DataFrame, step: str, order: str | None = None, combine: dict[str, str] | None = None) -> bool:
        """Writes rows over those of equal keys and adds the others; False if the ledger names the step.

        combine: for a column, SQL over the structs old and new (null if there is none), for instance a counter's `coalesce(old.n, 0) + new.n`.
        """
        v = self.version()
        if step in v["steps"]:
            return False
        key, names, combine = v["key"], [c[0] for c in v["columns"]], combine or {}
        if set(rows.columns) - set(names) or key not in rows.columns:
            raise ValueError(f"columns {rows.columns} do not fit {names}")
        given = [c for c in names if c in rows.columns]
        cast = rows.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t, _ in v["columns"] if n in given])
        best = F.max_by(F.struct(*given), F.struct(*([order] if order else []), *given))
        bucket = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(v["buckets"]))
        one = cast.groupBy(F.col(f"`{key}`").alias("_key")).agg(best.alias("new")).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(v["buckets"])))
        touched = {str(r[0]) for r in one.select("_bucket").distinct().collect()}
        folder, found = f"data/{uuid.uuid4().hex}", dict(v["folders"])
        if touched:
            old = self._rows(v, touched).select(bucket.alias("_old_bucket"), F.struct(*names).alias("old"))
            both = old.join(one, F.col(f"old.`{key}`").eqNullSafe(F.col("_key")) & (F.col("_old_bucket") == F.col("_bucket")), "full_outer")
            # A full outer join keeps keys in place; a missing side is a null struct.
            def value(n: str, t: str, default: str):  # noqa: ANN202
                if n in combine:
                    taken = F.when(F.col("new").isNotNull(), F.expr(combine[n])).otherwise(F.col(f"old.`{n}`"))
                elif n in given:
                    taken = F.when(F.col("new").isNotNull(), F.col(f"new.`{n}`")).otherwise(F.col(f"old.`{n}`"))
                else:
                    taken = F.when(F.col("old").isNotNull(), F.col(f"old.`{n}`")).otherwise(F.expr(default))
                return taken.cast(t).alias(n)

            out = both.select(F.coalesce("_bucket", "_old_bucket").alias("_bucket"), *[value(*c) for c in v["columns"]])
            out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            found |= {b: [folder, len(names)] for b in touched}
        self._publish({**v, "version": v["version"] + 1, "steps": [*v["steps"], step], "folders": found})
        return True

    def vacuum(self) -> int:
        """Removes the data that the newest version does not name, and older versions; for times without writers and readers. Returns how many folders went."""
        fs, make = _files(self.spark, self.path)
        v = self.version()
        used, gone = {f.split("/")[1] for f, _ in v["folders"].values()}, 0
        data = make(f"{self.path}/data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
                gone += 1
        for n in self._versions()[:-1]:
            fs.delete(make(f"{self.path}/versions/{n:010d}"), False)
        fs.delete(make(f"{self.path}/writing"), True)
        return gone
