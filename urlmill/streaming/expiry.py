"""Streams with state that expires: caches with a lifetime, rate limits, idle gaps, frame decoding.

State is kept per key, a few numbers each, with an event-time timeout at the second from which they can change nothing any more: when the watermark has
passed it, the state is removed, so keys that fall silent cost nothing. A call costs Spark some milliseconds, however few rows it has; where keys are many and small, `buckets` lets one call fold all keys of a
hash bucket, each with a state and an end of its own. Choose so many that the rows of a bucket and a micro-batch fit a task, and keep the number for the life of a checkpoint; keys are then numbers other than NaN, or strings. State and rows come and go in Arrow batches (applyInPandasWithState). Rows of a key are folded in time order within a micro-batch; rows older than the watermark, which
begins at the epoch, are dropped, as everywhere in Structured Streaming. The batch forms in urlmill.operators.state give the same rows.
"""

from __future__ import annotations

import math
import re
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHARACTERS, BYTES = 128_000, 512_000


def _places(x: np.ndarray) -> np.ndarray:
    """What np.lexsort takes for a column: nulls last."""
    if x.dtype != object:
        return x
    codes = pd.factorize(x, sort=True)[0]
    return np.where(codes < 0, len(x), codes)


def _in_order(batches: Iterator[pd.DataFrame], order: list[str], row: type, key: str | None = None) -> Iterator[tuple]:
    """A group's rows, sorted by `order`, with the fields of `row`; each after its key, if one is named. Columns are taken as arrays: on a small group a concat, sort_values and itertuples of pandas take 1.4 ms."""
    frames = list(batches)
    columns = {c: frames[0][c].to_numpy() if len(frames) == 1 else pd.concat([f[c] for f in frames]).to_numpy() for c in dict.fromkeys([*row._fields, *filter(None, [key])])}
    at = np.lexsort([_places(columns[c]) for c in reversed(order)])
    rows = map(row._make, zip(*[columns[c][at].tolist() for c in row._fields]))
    return rows if key is None else zip(columns[key][at].tolist(), rows)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """events with the time `_at` of their watermark."""
    return events.withColumn("_at", F.timestamp_seconds("at")).withWatermark("_at", late)


def _folded(events: DataFrame, key: str, late: str, kind: str, order: list[str], step: Callable, until: Callable, out: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Folds each key's rows (`at` in seconds): step(state or None, row) gives the next state (None: none) and an output tuple or None; until(state) is the last second at which the state matters."""
    kind_of_row = namedtuple("Row", order)

    def end(state: tuple) -> int:
        return (math.floor(until(state)) + 1) * 1000

    def fold(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, found = (tuple(held.get) if held.exists else None), []
        for row in _in_order(batches, order, kind_of_row):
            state, one = step(state, row)
            if one is not None:
                found.append(one)
        if state is not None:
            held.update(state)
            held.setTimeoutTimestamp(max(end(state), held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        if found:
            yield pd.DataFrame({key: [k[0]] * len(found)} | dict(zip(out, map(list, zip(*found)))))

    def fold_bucket(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        names, *fields = held.get if held.exists else ([],)
        states, found = dict(zip(names, zip(*fields))), []
        if not held.hasTimedOut:
            for name, row in _in_order(batches, order, kind_of_row, key):
                name = None if k[0] < 0 else name
                states[name], one = step(states.get(name), row)
                if one is not None:
                    found.append((name, *one))
        now = held.getCurrentWatermarkMs()
        states = {n: s for n, s in states.items() if s is not None and end(s) >= now}
        if states:
            held.update((list(states), *map(list, zip(*states.values()))))
            held.setTimeoutTimestamp(max(min(map(end, states.values())), now + 1))
        elif held.exists:
            held.remove()
        if found:
            yield pd.DataFrame(dict(zip([key, *out], map(list, zip(*found)))))

    known = events.schema[key].dataType.simpleString()
    timed = _timed(events.select(*dict.fromkeys([key, "at", *order])), late)
    result = f"{key} {known}, " + ", ".join(f"{k} {v}" for k, v in out.items())
    if buckets is None:
        return timed.groupBy(key).applyInPandasWithState(fold, result, kind, "append", GroupStateTimeout.EventTimeTimeout)
    # Null keys are a bucket of their own, as pandas makes numbers beside them floats.
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    kinds = ", ".join(f"{f} array<{t}>" for f, t in [("names", known), *(x.split(" ", 1) for x in kind.split(", "))])
    return timed.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(fold_bucket, result, kinds, "append", GroupStateTimeout.EventTimeTimeout)


def ttl_cache(events: DataFrame, key: str = "key", strict: bool = True, late: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """(key, at, hit) of lookups (key, at, ttl: seconds, of the entry that a miss loads). Alive while age <= ttl (strict) or age < ttl; hits do not renew."""

    def step(state: tuple | None, row) -> tuple:  # noqa: ANN001
        at = float(row.at)
        hit = state is not None and (at - state[0] <= state[1] if strict else at - state[0] < state[1])
        return (state if hit else (at, float(row.ttl))), (row.at, hit)

    at = events.schema["at"].dataType.simpleString()
    return _folded(events, key, late, "written double, ttl double", ["at", "ttl"], step, lambda s: s[0] + s[1], {"at": at, "hit": "boolean"}, buckets)


def host_cache(events: DataFrame, ttl: int = 21_600, key: str = "host", late: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """(host, at, hit) of the lookups among rows (host, at, kind: 'lookup' or 'result', keep): results that may be kept replace the entry, others remove it."""

    def step(state: tuple | None, row) -> tuple:  # noqa: ANN001
        if row.kind != "lookup":
            return ((float(row.at),) if row.keep else None), None
        hit = state is not None and row.at - state[0] < ttl
        return (state if hit else None), (row.at, hit)

    at = events.schema["at"].dataType.simpleString()
    return _folded(events, key, late, "written double", ["at", "kind", "keep"], step, lambda s: s[0] + ttl, {"at": at, "hit": "boolean"}, buckets)


def rate_limit(events: DataFrame, limit: int = 5, seconds: int = 900, key: str = "client", late: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """(client, at, outcome) of attempts (client, at, ok): refused, failed or ok. Refused attempts are not recorded, a success clears the record."""

    def step(state: tuple | None, row) -> tuple:  # noqa: ANN001
        recent = [x for x in (state[0] if state else []) if row.at - x < seconds]
        outcome = "refused" if len(recent) >= limit else "ok" if row.ok else "failed"
        recent = [] if outcome == "ok" else recent + [float(row.at)] * (outcome == "failed")
        return ((recent,) if recent else None), (row.at, outcome)

    at = events.schema["at"].dataType.simpleString()
    return _folded(events, key, late, "recent array<double>", ["at", "ok"], step, lambda s: max(s[0]) + seconds, {"at": at, "outcome": "string"}, buckets)


def idle_gaps(events: DataFrame, idle: int = 10, forget: int = 3_600, key: str = "scan_id", late: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """(scan_id, idle_from, idle_to, keepalives): gaps of `idle` seconds or more between a scan's events (scan_id, at, terminal), with as many keepalives as fit; a scan ends with a terminal event or
    after `forget` silent seconds, and begins anew with the next one."""

    def step(state: tuple | None, row) -> tuple:  # noqa: ANN001
        gap = row.at - state[0] if state else 0
        found = (int(state[0]), int(row.at), int(gap // idle)) if idle <= gap <= forget else None
        return (None if row.terminal else (float(row.at),)), found

    return _folded(events, key, late, "seen double", ["at", "terminal"], step, lambda s: s[0] + forget, {"idle_from": "long", "idle_to": "long", "keepalives": "long"}, buckets)


# ---- frames

_START = (b"", 0, 0, False)


def next_frames(state: tuple, chunk: bytes, last: bool, characters: int = CHARACTERS, size: int = BYTES) -> tuple[tuple, list[tuple]]:
    """The state after one more chunk of a stream of server-sent events, and the frames (n, event, data, error) that it completes.

    state: the unfinished tail, frames so far, bytes so far, whether the stream is over. A stream is over with its frame `done` or `error`, or with an error: its tail
    exceeds `characters`, all of it `size` bytes, or it ends without such a frame. What comes later is ignored.
    """
    tail, n, seen, over = state
    out: list[tuple] = []
    if over:
        return state, out
    tail, seen = tail + (chunk or b""), seen + len(chunk or b"")
    if seen > size or (len(tail) > characters and len(tail.decode("utf-8", "ignore")) > characters):
        return (b"", n + 1, seen, True), [(n, None, None, "too large")]
    *frames, tail = re.split(rb"\r?\n\r?\n", tail)
    if last and tail.strip():
        frames, tail = [*frames, tail], b""
    for frame in frames:
        lines = re.split(r"\r?\n", frame.decode("utf-8", "replace"))
        event = next((x[6:].strip() for x in lines if x.startswith("event:")), None)
        data = "\n".join(x[5:].lstrip() for x in lines if x.startswith("data:"))
        if data and not over:
            out.append((n, event, data, None))
            n, over = n + 1, event in ("done", "error")
    if last and not over:
        out.append((n, None, None, "interrupted"))
        n, over = n + 1, True
    return (b"" if over else tail, n, seen, over), out


FRAME = "n long, event string, data string, error string"


def frames(chunks: DataFrame, characters: int = CHARACTERS, size: int = BYTES, silent: int = 3_600, late: str = "1 hour") -> DataFrame:
    """(stream_id, n, event, data, error) of a stream of chunks (stream_id, seq, chunk: binary, last, at: seconds), cut anywhere. The state of a stream, its unfinished tail, goes when it has
    been silent for `silent` seconds; chunks that come later begin a stream anew."""

    kind_of_row = namedtuple("Row", ["seq", "chunk", "last", "at"])

    def decode(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, out = _START, []
        if held.exists:
            tail, *more = held.get
            state = (bytes(tail), *more)
        for row in _in_order(batches, ["seq"], kind_of_row):
            state, found = next_frames(state, row.chunk, bool(row.last), characters, size)
            out += [(*k, *x) for x in found]
            at = row.at
        held.update(state)
        held.setTimeoutTimestamp(max((math.floor(at) + silent + 1) * 1000, held.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "n", "event", "data", "error"])

    known = chunks.schema["stream_id"].dataType.simpleString()
    rows = _timed(chunks.select("stream_id", "seq", "chunk", "last", "at"), late)
    return rows.groupBy("stream_id").applyInPandasWithState(decode, f"stream_id {known}, {FRAME}", "tail binary, n long, seen long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def frames_batch(chunks: DataFrame, characters: int = CHARACTERS, size: int = BYTES) -> DataFrame:
    """As `frames`, for a table: rows of a stream pass in order through one task, which holds its unfinished tail only."""
    known = chunks.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), _START
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.stream_id != key:
                    key, state = row.stream_id, _START
                state, found = next_frames(state, row.chunk, bool(row.last), characters, size)
                out += [(key, *x) for x in found]
            yield pd.DataFrame(out, columns=["stream_id", "n", "event", "data", "error"])

    rows = chunks.select("stream_id", "seq", "chunk", "last").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return rows.mapInPandas(run, f"stream_id {known}, {FRAME}")
