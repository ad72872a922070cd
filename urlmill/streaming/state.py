"""Streaming forms of the stateful operators: state is kept per key, rows arrive once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ttl_cache(events: DataFrame, ttl: float, key: str = "key", strict: bool = True) -> DataFrame:
    """(key, at, hit) for every lookup (key, at in seconds); hits do not renew. State: the time of the last load."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("at")
        written = state.get[0] if state.exists else None
        hits = []
        for t in rows["at"]:
            alive = written is not None and (t - written <= ttl if strict else t - written < ttl)
            written = written if alive else t
            hits.append(alive)
        state.update((float(written),))
        yield pd.DataFrame({"key": k[0], "at": rows["at"].to_numpy(), "hit": hits})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, at double, hit boolean", "written double", "append", GroupStateTimeout.NoTimeout)


def rate_limit(events: DataFrame, limit: int = 5, seconds: int = 900, key: str = "client") -> DataFrame:
    """(client, at, outcome) for every attempt (client, at in seconds, ok): refused, failed or ok. State: the recent failures."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("at")
        recent = list(state.get[0]) if state.exists else []
        out = []
        for t, ok in zip(rows["at"], rows["ok"]):
            recent = [x for x in recent if t - x < seconds]
            if len(recent) >= limit:
                out.append("refused")
            elif ok:
                recent = []
                out.append("ok")
            else:
                recent.append(float(t))
                out.append("failed")
        state.update((recent,))
        yield pd.DataFrame({"client": k[0], "at": rows["at"].to_numpy(), "outcome": out})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"client {kind}, at double, outcome string", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", size: str = "15 minutes", *by: str) -> DataFrame:
    """Counts per event-time window; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n"))


def progress(events: DataFrame) -> DataFrame:
    """The latest status per scan and stage, for complete or update mode."""
    return events.groupBy("scan_id", "stage").agg(F.max_by("status", "seq").alias("status"), F.min("seq").alias("first_seq"))


def distinct_within(events: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
