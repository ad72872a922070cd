"""Large JSON arrays of objects, one array a file, read by as many tasks as Spark cuts the file into.

A file is scanned as text with `}` as line end, so Spark splits it by bytes on any file system, and an element can end only where a piece ends. A split does not know whether it starts within a string or how deep
it is. A first scan counts for each split what it would add to the depth in both cases, and whether it has an odd number of quotes; running sums over the splits (one small row each) give every split its true
start. A second scan cuts the elements; those that lie in several splits are put together from their pieces.

Defined cases: an empty file and an empty array have no elements; an array that is not closed, and elements that are no objects, are errors; null fields stay null; an element whose fields have other types gives nulls
there, as from_json does. A file without objects in it is one piece. Elements must fit into a task's memory, arrays need not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of splits (one for each split) that are broadcast; beyond, pieces are joined to them by a shuffle.
FEW = 200_000
#: Characters of elements in one batch.
BATCH = 8_000_000
_QUOTE = re.compile(r'(?<!\\)(?:\\\\)*"')
_SPLIT = ["path", "start", "size"]


def _depths(piece: str) -> tuple[int, int, int]:
    """(quotes, what the even stretches between quotes add to the depth, what the odd ones add)."""
    parts = _QUOTE.split(piece)
    add = [sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts[i::2]) for i in (0, 1)]
    return len(parts) - 1, add[0], add[1]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(path, start, size, *further columns, piece) row by row; the scan takes the closing bracket of each piece away, and the one added after a file's end leaves its depth at -1."""
    for b in batches:
        for *key, value in b.itertuples(index=False, name=None):
            yield (*key, (value or "") + "}")


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each split: whether it has an odd number of quotes, and its depths if it starts outside and inside of a string."""
    key, odd, add = None, 0, [0, 0]
    rows = []
    for path, start, size, piece in _pieces(batches):
        if key != (path, start, size):
            rows.append((*key, odd, *add)) if key else None
            key, odd, add = (path, start, size), 0, [0, 0]
        quotes, even, uneven = _depths(piece)
        add[odd] += even
        add[1 - odd] += uneven
        odd ^= quotes & 1
    if key:
        rows.append((*key, odd, *add))
    yield pd.DataFrame(rows, columns=[*_SPLIT, "odd", "outside", "inside"])


def _element(text: str, path: str) -> str:
    found = text.lstrip(" \t\r\n,[")
    if found[:1] != "{":
        raise ValueError(f"{path}: an element of the array is no object")
    return found


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements, and the pieces of those that other splits share: kind `element`, `head` (ends here), `tail` (starts here) or `middle`."""
    key, odd, depth, held, ended = None, 0, 0, [], False
    rows, size = [], 0

    def rest():  # noqa: ANN202
        return [(key[0], key[1], "tail" if ended else "middle", "".join(held))] if held and depth > 0 else []

    for path, start, length, sound, state, at, piece in _pieces(batches):
        if sound is None or sound != sound or not sound:
            raise ValueError(f"{path} is no closed JSON array, or the session's split size changed between two scans")
        if key != (path, start, length):
            rows += rest()
            key, odd, depth, held, ended = (path, start, length), int(state), int(at), [], False
        quotes, even, uneven = _depths(piece)
        depth += uneven if odd else even
        odd ^= quotes & 1
        held.append(piece)
        if depth == 1 and not odd:
            text, held = "".join(held), []
            rows.append((path, start, "element", _element(text, path)) if ended else (path, start, "head", text))
            ended, size = True, size + len(text)
            if size > BATCH:
                yield pd.DataFrame(rows, columns=["path", "start", "kind", "text"])
                rows, size = [], 0
    yield pd.DataFrame(rows + (rest() if key else []), columns=["path", "start", "kind", "text"])


def _joined(texts: Column, path: Column) -> Column:
    found = F.regexp_replace(texts, r"^[ \t\r\n,\[]+", "")
    return F.when(F.startswith(found, F.lit("{")), found).otherwise(F.raise_error(F.concat(path, F.lit(": an element of the array is no object"))))


def elements(spark: SparkSession, path: str, few: int = FEW) -> DataFrame:
    """(path, value): the text of every element of the arrays in path."""
    scan = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("size"), "value")
    measured = scan.mapInPandas(_measure, "path string, start bigint, size bigint, odd int, outside bigint, inside bigint")
    w = Window.partitionBy("path").orderBy("start")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    s = measured.withColumn("state", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).withColumn("adds", F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside")))
    s = s.withColumn("at", F.coalesce(F.sum("adds").over(before), F.lit(0))).withColumn("sound", (F.sum("odd").over(whole) % 2 == 0) & (F.sum("adds").over(whole) == -1))
    s = s.select(*_SPLIT, "sound", "state", "at")
    order = [*_SPLIT, "sound", "state", "at", "value"]
    if s.limit(few + 1).count() <= few:
        pieces = scan.join(F.broadcast(s), _SPLIT, "left").select(*order)
    else:
        numbered = scan.withColumn("_n", F.monotonically_increasing_id())
        pieces = numbered.join(s, _SPLIT, "left").repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "_n").select(*order)
    cut = pieces.mapInPandas(_cut, "path string, start bigint, kind string, text string")
    # Heads end an element, so the number of heads before a piece of a split tells which element it belongs to.
    parts = cut.where("kind <> 'element'").withColumn("last", (F.col("kind") == "tail").cast("int"))
    order = Window.partitionBy("path").orderBy("start", "last")
    parts = parts.withColumn("n", F.coalesce(F.sum((F.col("kind") == "head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "last", "text"))), lambda x: x["text"]), "")
    shared = parts.groupBy("path", "n").agg(texts.alias("text"))
    return cut.where("kind = 'element'").select("path", F.col("text").alias("value")).unionByName(shared.select("path", _joined(F.col("text"), F.col("path")).alias("value")))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the arrays in path, as columns of the schema."""
    return elements(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def _bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The objects of a partition as lines of one array; the last line waits for the end."""
    held = "["
    first = True
    for b in batches:
        lines = []
        for (value,) in b.itertuples(index=False, name=None):
            lines.append(held if first else held + ",")
            held, first = value, False
        yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["[]"] if first else [held, "]"]})


def write_json_arrays(df: DataFrame, path: str, line: str = "\n") -> None:
    """One JSON array a file, in as many files as df has partitions, nulls kept; line: what stands between the objects beside the comma."""
    objects = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    objects.mapInPandas(_bracketed, "value string").write.mode("overwrite").option("lineSep", line).text(path)
