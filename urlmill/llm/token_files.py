"""Operator 5: token ids as Arrow files of equal-length sequences.

Format (Arrow IPC file format, one pair of files a part, parts in ascending doc_id order):
  part-NNNNNN.arrow        input_ids fixed_size_list<uint16 or uint32>[length], mask fixed_size_list<bool>[length]; every record batch
                           but the last has `rows` sequences, so sequence j is row j % rows of batch j // rows, and a memory map of the
                           file gives it without a copy. The ids of a part's documents follow each other, each with the end id; only
                           the last sequence of a part is padded (mask false, id 0).
  part-NNNNNN.index.arrow  doc_id, start (within the part), n_tokens, in the order of the ids.
ids are uint16 where the vocabulary allows it, uint32 otherwise; readers see whole numbers.

Scale: documents are range-partitioned by doc_id, and a task writes and later reads one part, batch by batch; the driver sees one row a
part (its token count), from which the parts' starts follow. A task writes under a name of its own attempt and renames it at the end,
so a retry after a lost executor leaves whole files only. Files go to the shared folder through pyarrow's file systems.

The pre-tokenizer drops white space, so ids of a text are those of its white-space-separated words in turn; each distinct word is encoded
by the tokenizers library once, and a bounded cache remembers it (tests compare with whole-text encoding).

Defined cases: a null or blank text has the end id alone; rows with equal doc_ids follow each other in the order of their texts; a null doc_id comes first; an
empty table gives no part and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, spread, table

END_ID, LENGTH, ROWS = 2, 2048, 32
#: Documents that are encoded together
TAKE = 2500


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of letters with other signs behind: the pre-tokenizer cuts it there, unless an apostrophe follows.
LETTERS = re.compile(r"([^\W\d_]+)([^\w\s']*)")


class Encoder:
    """Little-endian ids of texts, by distinct words of a batch. Words are remembered in two generations of at most BOUND words each; a word
    of the older one that is met again moves to the younger one. Runs of letters, in lower case as the normalizer has them, go to the
    library's model at once; what the normalizer or pre-tokenizer may change goes through the whole tokenizer."""

    BOUND = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.young, self.old, self.heads, self.tails = Tokenizer.from_file(path), {}, {}, {}, {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.last = np.zeros(1 << (8 * self.dtype.itemsize if self.dtype.itemsize < 4 else 24), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in plain]
        self.alphabet = {x: chr(256 + i) for i, x in enumerate(rest)}

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters: 4096 of them at a time as one text; the last piece of each carries the end-of-word sign."""
        runs = [r if r.isascii() else r.encode().decode("latin-1").translate(self.alphabet) for r in runs]
        out: list[bytes] = []
        for part in self.model.encode_batch_fast([" ".join(runs[x : x + 4096]) for x in range(0, len(runs), 4096)], add_special_tokens=False):
            ids = np.array(part.ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip([0, *ends[:-1]], ends)]
        return out

    def _learn(self, new: list[bytes]) -> None:
        if len(self.heads) + len(self.tails) > self.BOUND:
            self.heads, self.tails = {}, {}
        match, cut = LETTERS.fullmatch, []
        for w in new:
            word = w.decode()
            m = match(word)
            # What stands behind a run of letters is cut off where the pre-tokenizer certainly does so.
            if m and (word.isascii() or (m[1].isalpha() and is_normalized("NFC", word) and "Σ" not in word and "İ" not in word)):
                cut.append((m[1].lower(), m[2]))
            else:
                cut.append(("", word))
        heads, tails = self.heads, self.tails
        unknown = list({a for a, _ in cut}.difference(heads, ("",)))
        heads.update(zip(unknown, self._runs(unknown)))
        unknown = list({b for _, b in cut}.difference(tails))
        for part in range(0, len(unknown), 8192):
            got = self.tokenizer.encode_batch_fast(unknown[part : part + 8192], add_special_tokens=False)
            tails.update((r, array(self.dtype.char, e.ids).tobytes()) for r, e in zip(unknown[part : part + 8192], got))
        heads[""] = b""
        self.young.update([(w, heads[a] + tails[b]) for w, (a, b) in zip(new, cut)])

    def __call__(self, texts: pa.Array) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.young) > self.BOUND:
            self.young, self.old = {}, self.young
        new = [w for w in distinct if w not in self.young]
        known = [w for w in new if w in self.old]
        self.young.update((w, self.old[w]) for w in known)
        self._learn([w for w in new if w not in self.young])
        ids = pa.array([self.young[w] for w in distinct], pa.large_binary()).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        if not len(ids):
            return [b""] * len(texts)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[ids.offset :][ends].tolist()
        whole = memoryview(data)
        return [bytes(whole[a:b]) for a, b in zip(at[:-1], at[1:])]


@cache
def encoder(path: str) -> Encoder:
    """One encoder a process, so that tasks after the first know most words."""
    return Encoder(path)


class PartWriter:
    """Writes one part; ids come in any pieces."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, length: int, rows: int):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.names = [f"{path}/part-{part:06d}{x}.arrow" for x in ("", ".index")]
        self.drafts = [f"{n}.{uuid.uuid4().hex}" for n in self.names]
        self.dtype, self.length, self.rows, self.total, self.kept = dtype, length, rows, 0, bytearray()
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.whole = pa.array(np.ones(length * rows, bool))
        self.streams = [self.fs.open_output_stream(d) for d in self.drafts]
        self.out = pa.ipc.new_file(self.streams[0], self.schema)
        self.index = pa.ipc.new_file(self.streams[1], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))

    def _flush(self, ids: np.ndarray, real: int) -> None:
        mask = self.whole if real == len(self.whole) else pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, doc_ids: list, ids: list[bytes]) -> None:
        sizes = np.array([len(x) // self.dtype.itemsize for x in ids], np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])))
        self.total += int(sizes.sum())
        full = self.length * self.rows * self.dtype.itemsize
        for x in ids:
            self.kept += x
            while len(self.kept) >= full:
                self._flush(np.frombuffer(bytes(self.kept[:full]), self.dtype), self.length * self.rows)
                del self.kept[:full]

    def close(self) -> None:
        if self.kept:
            ids = np.frombuffer(bytes(self.kept), self.dtype)
            self._flush(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.dtype)]), len(ids))
        for x in (self.out, self.index, *self.streams):
            x.close()
        for draft, name in zip(self.drafts, self.names):
            self.fs.move(draft, name)


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS) -> list[tuple[int, int]]:
    """Write the ids of all texts to folder; (part, number of ids) of each part, in order."""
    where, name = pafs.FileSystem.from_uri(folder)
    where.create_dir(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, writer = TaskContext.get().partitionId(), encoder(path), None
        for batch in batches:
            for a in range(0, batch.num_rows, TAKE):
                some = batch.slice(a, TAKE)
                writer = writer or PartWriter(folder, part, encode.dtype, length, rows)
                end = np.array([end_id], encode.dtype).tobytes()
                writer.add(some["doc_id"].to_pylist(), [x + end for x in encode(some["text"])])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([writer.total], pa.int64())], names=["part", "n"])

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(spread(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted((r["part"], r["n"]) for r in dealt.mapInArrow(run, "part int, n long").collect())


def read(spark: SparkSession, folder: str, parts: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    starts = np.cumsum([0, *[n for _, n in parts]])
    given = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(parts, starts)], "part int, base long")

    def one(fs, name: str, part: int, base: int) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(f"{name}/part-{part:06d}.arrow") as f, fs.open_input_file(f"{name}/part-{part:06d}.index.arrow") as g:
            ids, index = pa.ipc.open_file(f), pa.ipc.open_file(g)
            held, at, k = np.empty(0, np.uint32), 0, 0  # ids from place `at` on; next batch k
            for b in range(index.num_record_batches):
                docs, crcs = index.get_batch(b), []
                for n in docs["n_tokens"].to_pylist():
                    crc = 0
                    while n:
                        if at == len(held):
                            batch, at = ids.get_batch(k), 0
                            mask = batch["mask"].values.to_numpy(zero_copy_only=False)
                            held, k = batch["input_ids"].values.to_numpy()[mask].astype("<u4"), k + 1
                        piece = held[at : at + n]
                        crc, n, at = zlib.crc32(piece.tobytes(), crc), n - len(piece), at + len(piece)
                    crcs.append(crc)
                yield pa.RecordBatch.from_arrays([docs["doc_id"], pa.array(docs["start"].to_numpy() + base), docs["n_tokens"], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, base in zip(batch["part"].to_pylist(), batch["base"].to_pylist()):
                yield from one(fs, name, part, base)

    return given.repartition(max(1, len(parts)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence(folder: str, part: int, j: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence j of a part and its mask: one batch is mapped, nothing else is read; the ids are a view of the file."""
    fs, name = pafs.FileSystem.from_uri(folder)
    source = pa.memory_map(f"{name}/part-{part:06d}.arrow") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{name}/part-{part:06d}.arrow")
    batch = pa.ipc.open_file(source).get_batch(j // rows)
    return batch["input_ids"][j % rows].values.to_numpy(), batch["mask"][j % rows].values.to_numpy(zero_copy_only=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(spark, folder, write(table(spark, sf_dir, "documents"), folder, tokenizer_path()))
