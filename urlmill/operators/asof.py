"""As-of join: the newest entry of a key that is valid at the time of each lookup, without joining a key's lookups with its entries.

Both sides are united and cut into slices of a key's time. Within a slice, rows pass in time order, and the entries that may still answer are kept on a stack: a new entry removes older ones that
expire no later, a lookup removes the newest while it has expired. What a slice leaves is carried to the next ones: of each slice only the entries that outlive it and that no
newer one outlives are left (mostly one), and one pass over those per key says which reach which slice. So a key with a large share of all rows is spread over its slices, and the pass
over what is carried grows with its slices, not with its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

WIDTH = 3_600
CARRIED, ENTRY, LOOKUP = 0, 1, 2


def _push(stack: list[tuple], until: object, payload: object) -> None:
    while stack and stack[-1][0] <= until:
        stack.pop()
    stack.append((until, payload))


def _carried(marks: DataFrame, width: int, kind: StructType) -> DataFrame:
    """What each slice with lookups begins with: rows _k, _slice, _expires, _payload. marks: of lookups (_kind LOOKUP) and surviving entries, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = object(), []
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, at, what, seen, until, payload in zip(*(batch[c].to_pylist() for c in ("_k", "_slice", "_kind", "_at", "_expires", "_payload"))):
                if k != key:
                    key, stack = k, []
                if what == LOOKUP:
                    stack = [x for x in stack if x[0] > at * width]
                    for place, (e, p) in enumerate(stack):
                        for column, v in zip(out, (k, at, place, e, p)):
                            column.append(v)
                else:
                    _push(stack, until, payload)
            names = ["_k", "_slice", "_place", "_expires", "_payload"]
            types = [batch.schema.field("_k").type, pa.int64(), pa.int64(), batch.schema.field("_expires").type, batch.schema.field("_payload").type]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    # A slice's own entries come after what it begins with.
    return marks.repartition("_k").sortWithinPartitions("_k", "_slice", F.desc("_kind"), "_at", "_expires", "_payload").mapInArrow(run, kind)


def as_of(lookups: DataFrame, entries: DataFrame, key: str = "key", width: int = WIDTH, name: str = "payload") -> DataFrame:
    """All lookups (key, at and others) with `name`: the payload of the newest entry (key, fetched_at, expires_at, payload) with fetched_at <= at < expires_at, else null.

    Times are whole seconds. Of entries fetched at once the one that expires last is the newest, then the larger payload. A lookup whose key or time is null finds nothing, an entry with a
    null key or time is none; repeated lookups stay.
    """
    slice_of = lambda c: F.floor(F.col(c) / width)
    rows = F.struct(*[F.col(c) for c in lookups.columns])
    valid = entries.where(F.col(key).isNotNull() & (F.col("fetched_at") < F.col("expires_at")))
    own = valid.select(F.col(key).alias("_k"), slice_of("fetched_at").alias("_slice"), F.lit(ENTRY).alias("_kind"), F.col("fetched_at").cast("long").alias("_at"), F.col("expires_at").cast("long").alias("_expires"), F.col("payload").alias("_payload"))
    asked = lookups.select(F.col(key).alias("_k"), slice_of("at").alias("_slice"), F.lit(LOOKUP).alias("_kind"), F.col("at").cast("long").alias("_at"), rows.alias("_row"))
    asking = asked.where("_k is not null and _at is not null")

    newer = Window.partitionBy("_k", "_slice").orderBy(F.desc("_at"), F.desc("_expires"), F.desc("_payload")).rowsBetween(Window.unboundedPreceding, -1)
    outlive = own.withColumn("_newer", F.max("_expires").over(newer)).where((F.col("_newer").isNull() | (F.col("_newer") < F.col("_expires"))) & (F.col("_expires") > (F.col("_slice") + 1) * width)).drop("_newer")
    marks = outlive.unionByName(asking.select("_k", "_slice", "_kind").distinct(), allowMissingColumns=True)
    kinds = {f.name: f for f in own.schema.fields}
    carried = _carried(marks, width, StructType([kinds["_k"], kinds["_slice"], StructField("_place", kinds["_slice"].dataType), kinds["_expires"], kinds["_payload"]]))

    parts = own.withColumn("_place", F.col("_at")).unionByName(asking.withColumn("_place", F.col("_at")), allowMissingColumns=True)
    parts = parts.unionByName(carried.withColumn("_kind", F.lit(CARRIED)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_key, stack = object(), []
        for batch in batches:
            found: list = []
            payloads = batch["_payload"]
            for i, (k, s, what, at, until) in enumerate(zip(*(batch[c].to_pylist() for c in ("_k", "_slice", "_kind", "_at", "_expires")))):
                if (k, s) != at_key:
                    at_key, stack = (k, s), []
                if what == LOOKUP:
                    while stack and stack[-1][0] <= at:
                        stack.pop()
                    found.append(stack[-1][1] if stack else None)
                else:
                    _push(stack, until, payloads[i].as_py())
            mine = pa.compute.equal(batch["_kind"], LOOKUP)
            yield pa.RecordBatch.from_arrays([batch["_row"].filter(mine), pa.array(found, payloads.type)], names=["_row", "_payload"])

    # Within a slice: what is carried, oldest first, then by time, entries before lookups.
    dealt = parts.repartition("_k", "_slice").sortWithinPartitions("_k", "_slice", F.col("_kind") > CARRIED, "_place", "_kind", "_expires", "_payload")
    answered = dealt.mapInArrow(run, StructType([parts.schema["_row"], kinds["_payload"]]))
    rest = asked.where("_k is null or _at is null").select("_row", F.lit(None).cast(kinds["_payload"].dataType).alias("_payload"))
    return answered.unionByName(rest).select("_row.*", F.col("_payload").alias(name))
