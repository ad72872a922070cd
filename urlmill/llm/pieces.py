"""Operator 2: SentencePiece encoding and decoding by shared-prefix Viterbi.

Method: a text is marked (space becomes U+2581, one more in front) and falls into words at the places that no piece of the model spans. The
distinct words are sorted - the depth-first order of their trie - and the forward state of each prefix is computed once: a word
keeps the states of the prefix it shares with the word before it. States are
  unigram  the best score of the prefix and the piece that ends it (Viterbi over the sum of piece scores);
  bpe      the piece that ends the prefix, where a transition from piece a to piece b scores zero if the model's merges keep a and b
           apart, and minus infinity if they don't. Exactly one path is finite, and it is the sequence of merges' outcome, so ids equal those of
           the model's own encoder (tests compare them). Whether merges keep a pair apart follows from the two pieces' merge trees alone:
           a merge across the border must come before the merges that consume its parts.
Runs of several spaces, whose pieces tie in score, are left to the library. Characters without a piece become their UTF-8 bytes' pieces. Decoding joins the pieces, bytes first, and takes the marks back.

Scale: one scan without a shuffle; a task sorts the new words of CHUNK documents at a time and remembers words in two bounded generations.

Defined cases: a null or empty text has no ids and decodes to the empty text; a text that holds U+2581 itself decodes it as a space, as the library does;
repeated rows are treated alike; other columns are kept by `encode`; empty table: empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

MARK = "▁"
CHUNK, BOUND, PAIRS = 1000, 120_000, 120_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    """Pieces and scores of a model file, and the forward pass over sorted words."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        self.kind, self.unk = kind, p.unk_id()
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes = {int(names[i][1:-1], 16): i for i in range(len(names)) if p.is_byte(i)}
        special = {i for i in range(len(names)) if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        self.id = {n: i for i, n in enumerate(names) if i not in special}
        self.score = {n: p.get_score(i) for n, i in self.id.items()}
        self.spelled = [bytes([int(n[1:-1], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else " ⁇ ".encode() if p.is_unknown(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.longest = max(map(len, self.id))
        # A word ends where no piece goes on: before a mark, around characters that are in no piece of several, and - unless
        # some piece joins them - between letters and other signs.
        inner = {c for n in self.id if len(n) > 1 for c in n} - {MARK}
        if any(MARK in n.lstrip(MARK) for n in self.id):
            raise ValueError("pieces of this model span words")
        mixed = any(x.isalpha() != y.isalpha() for n in self.id for x, y in zip(n.lstrip(MARK), n.lstrip(MARK)[1:]))
        kinds = [inner] if mixed else [{c for c in inner if c.isalpha()}, {c for c in inner if not c.isalpha()}]
        classes = ["".join(re.escape(c) for c in sorted(k)) for k in kinds if k]
        self.words = re.compile("|".join([*(f"{MARK}*[{c}]+" for c in classes), f"{MARK}+", f"[^{''.join(classes)}{MARK}]"]))
        self.tails = {n[i:] for n in self.id for i in range(len(n))}
        self.units: dict[str, bytes] = {}
        self.spines: dict[str, tuple[tuple, tuple]] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.floor = min(self.score.values()) - 10.0
        # Pieces of runs of marks tie in score, so their merges depend on the place in the run; the library encodes words with such runs.
        count: dict[float, int] = {}
        for n in self.score:
            count[self.score[n]] = count.get(self.score[n], 0) + (len(n) > 1)
        if kind == "bpe" and any(count[self.score[n]] > 1 and n.strip(MARK) for n in self.id if len(n) > 1):
            raise ValueError("pieces of this model tie in score")
        self.library = p

    # -- bpe

    def _merge(self, piece: str) -> list:
        """The merge trees that a string ends in; a tree is (string, left, right)."""
        parts: list = [(c, None, None) for c in piece]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i][0] + parts[i + 1][0])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], parts[at], parts[at + 1])]
        return parts

    def _spine(self, piece: str) -> tuple[tuple, tuple] | None:
        """(string, made at, consumed at) along the left and the right border of a piece's merge tree; None if merges never make it."""
        if piece not in self.spines:
            trees, out = self._merge(piece), None
            if len(trees) == 1:
                both = []
                for side in (1, 2):
                    node, used, row = trees[0], float("inf"), []
                    while node:
                        made = -self.score[node[0]] if node[1] else float("-inf")
                        row.append((node[0], made, used))
                        node, used = node[side], made
                    both.append(tuple(row))
                out = tuple(both)
            self.spines[piece] = out
        return self.spines[piece]

    def _apart(self, a: str, b: str) -> bool:
        """Whether the merges keep two neighbouring pieces apart."""
        left, right = self._spine(a), self._spine(b)
        if left is None or right is None:
            return False
        for x, mx, ux in left[1]:
            for y, my, uy in right[0]:
                s = self.score.get(x + y)
                if s is not None and max(mx, my) < -s < ux and -s <= uy:
                    return False
        return True

    def _steps_bpe(self, word: str, state: list) -> None:
        """Appends to state the piece that ends each prefix of word that is not there yet."""
        ids, apart, tails = self.id, self.apart, self.tails
        if len(apart) > PAIRS:
            apart.clear()
        for i in range(len(state), len(word) + 1):
            # From the shortest piece on; no longer one ends here once the text is no piece's tail.
            for k in range(i - 1, -1, -1):
                piece = word[k:i]
                if piece in ids or k == i - 1:
                    if k:
                        key = (state[k], piece)
                        fits = apart.get(key)
                        if fits is None:
                            fits = apart[key] = self._apart(*key)
                    else:
                        fits = self._spine(piece) is not None
                    if fits:
                        state.append(piece)
                        break
                elif piece not in tails:
                    raise AssertionError("no piece ends here")

    # -- unigram

    def _steps_unigram(self, word: str, state: list) -> None:
        """Appends to state the best (score, last piece) of each prefix of word that is not there yet."""
        for i in range(len(state), len(word) + 1):
            best = None
            for k in range(max(0, i - self.longest), i):
                piece = word[k:i]
                s = self.score.get(piece, self.floor if k == i - 1 else None)
                if s is not None and (best is None or state[k][0] + s > best[0]):
                    best = (state[k][0] + s, piece)
            state.append(best)

    # -- words

    def _ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unk]

    def forward(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of sorted words; states of a shared prefix are kept."""
        bpe, known = self.kind == "bpe", self.id
        steps, state, last = (self._steps_bpe if bpe else self._steps_unigram), ["" if bpe else (0.0, "")], ""
        for word in words:
            if bpe and MARK * 2 in word:
                yield word, self.library.encode(word[1:].replace(MARK, " "), num_threads=1)
                continue
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :]
            steps(word, state)
            path, i = [], len(word)
            while i:
                piece = state[i] if bpe else state[i][1]
                path.append(piece)
                i -= len(piece)
            path.reverse()
            try:
                yield word, [known[piece] for piece in path]
            except KeyError:
                yield word, [x for piece in path for x in self._ids(piece)]
            last = word

    def _learn(self, tokens: list[str]) -> None:
        """Remembers the ids of texts between spaces."""
        if len(self.units) > BOUND:
            self.units = {}
        units, cut = self.units, [self.words.findall(MARK + t) for t in tokens]
        units.update((w, array("i", x).tobytes()) for w, x in self.forward(sorted(set().union(*cut).difference(units))))
        self.young.update([(t, b"".join([units[w] for w in ws])) for t, ws in zip(tokens, cut)])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Two spaces in a row, or one at an end, make runs of marks: such texts are cut by the pattern, the others between spaces.
        runs = pc.match_substring_regex(texts, f"^ | $|  |{MARK}").to_pylist()
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.young) > BOUND:
            self.young, self.old = {}, self.young
        new = [w for w in distinct if w not in self.young]
        self.young.update((w, self.old[w]) for w in new if w in self.old)
        self._learn([w for w in new if w not in self.young])
        ids = pa.array([self.young[w] for w in distinct], pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist() if len(ids) else [0]
        whole = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] else b""
        out = [bytes(whole[a:b]) for a, b in zip(at[:-1], at[1:])]
        for i, odd in enumerate(runs):
            if odd:
                ws = self.words.findall(MARK + texts[i].as_py().replace(" ", MARK))
                own = {w: array("i", x).tobytes() for w, x in self.forward(sorted(set(ws)))}
                out[i] = b"".join(map(own.__getitem__, ws))
            elif not len(texts[i].as_py()):
                out[i] = b""
        return out

    def forget(self) -> None:
        """Drops the words: most of a task's words are its own, and an idle process should be small."""
        self.young, self.old, self.units = {}, {}, {}

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


@cache
def model(path: str, kind: str = "bpe") -> Model:
    """One model a process, so that tasks after the first know its pieces and their merges."""
    return Model(path, kind)


def encode(docs: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """docs with ids (array of int), n_tokens and decoded, the text that the ids give back; these replace columns of the same names."""
    path = path or model_path()
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                got = m.encode(batch["text"])
                lists = [array("i", g) for g in got]
                ends = [0]
                for x in lists:
                    ends.append(ends[-1] + len(x))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(got))]))
                decoded = pa.array([m.decode(x) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), ids, pa.array([len(x) for x in lists], pa.int64()), decoded], names=[*kept, "ids", "n_tokens", "decoded"])
        m.forget()
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema.fields)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{fields}, ids array<int>, n_tokens long, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "n_tokens", "ids", "decoded = coalesce(text, '') AS exact")


