"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every contract, as the inside of a regex class.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own: a private one
    if all runs in one process (tests), else one in the warehouse, which machines share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_urlmill"
    if "dir" not in _OWN:
        keep = tempfile.TemporaryDirectory(prefix="urlmill-")
        atexit.register(keep.cleanup)
        _OWN["dir"] = f"file://{keep.name}"
    return _OWN["dir"]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> int:
    """How many partitions a shuffle of this session makes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hash of each word (bytes); forgets all of them at a bound, so memory stays constant."""

    BOUND = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words of a contract: bytes.split() separates at exactly \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BASE = 0x2545F4914F6CDD1D


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word grams of word hashes w, in order; one of the whole sequence if it is shorter."""
    if not len(w):
        return w
    k = min(k, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = h * U(BASE) + w[i : len(w) - k + 1 + i]
    return mix(h + U(k))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def tidy() -> None:
    """Gives memory that a task no longer uses back to the system, as its process may idle beside other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def join_back(rows: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """rows joined with what was aggregated from them by the same keys.

    The keys (long) are joined by their complements: the aggregate is then dealt out anew, and where one key has a large share of all rows, AQE can split the join,
    which it can't where the join stands on the aggregate's own shuffle.
    """
    names = [unused(f"_key{i}", rows) for i in range(len(keys))]
    left = rows.withColumns({n: F.bitwise_not(k) for n, k in zip(names, keys)})
    right = found.select(*[F.bitwise_not(k).alias(n) for n, k in zip(names, keys)], *[c for c in found.columns if c not in keys])
    return left.join(right, names).drop(*names)


def unused(name: str, df: DataFrame) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
