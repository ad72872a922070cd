"""Connected components of a graph of links: tasks contract the links they hold, alternating with large-star and small-star steps between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_back, materialize, tidy

ROUNDS, HELD = 60, 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of links: (root, node) of every node that is not a root, and (root, root) of roots on their own. Roots are the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low, hooked = np.minimum(top[x], top[y]), top.copy()
        np.minimum.at(hooked, top[x], low)
        np.minimum.at(hooked, top[y], low)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        if (hooked == top).all():
            break
        top = hooked
    shown = (top != np.arange(len(ids))) | (np.bincount(top, minlength=len(ids)) == 1)
    return ids[top[shown]], ids[shown]


def contracted(links: DataFrame, count: int) -> DataFrame:
    """The `count` links (a, b) of a written table as stars of what each task holds, at most HELD links of it at a time; components and nodes stay the same.
    As many tasks as HELD asks for, whatever the number of files: the more links meet in a task, the more of them it drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return forest(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))

        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for x in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[x : x + 100_000]), pa.array(b[x : x + 100_000])], names=["a", "b"])

        for batch in batches:
            held.append((batch["a"].to_numpy(zero_copy_only=False), batch["b"].to_numpy(zero_copy_only=False)))
            count += batch.num_rows
            if count > HELD:
                a, b = stars()
                # Stars that still fill half the room make way for the links to come.
                if 2 * len(a) > HELD:
                    yield from out(a, b)
                    held, count = [], 0
                else:
                    held, count = [(a, b)], len(a)
        if count:
            yield from out(*stars())
        tidy()

    return links.coalesce(max(1, -(-count // HELD))).mapInArrow(run, "a long, b long")


def _print(state: DataFrame) -> tuple:
    """A fingerprint of a set of links."""
    return tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every node of links (a, b: long); component is the smallest node that links reach.

    A node's smallest neighbour is a map-side-combined minimum that is joined back (a join that AQE splits where it is skewed), so no task holds
    the neighbours of one node. Before each round, tasks contract the links of about HELD rows each. Each round is written to the shared folder; their number grows with the
    logarithm of the longest chain. Links with a null or equal end only name their nodes.
    """
    pairs = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    edges = materialize(contracted(pairs, pairs.count()), tag)
    nodes = edges.select("a").union(edges.select("b")).distinct()
    state = edges.where("a < b")
    seen = _print(state)
    for _ in range(ROUNDS):
        # large star: a node's larger neighbours link to its smallest neighbour (or itself)
        both = state.union(state.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_back(both.where("v > u"), low, "u").where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # small star: a node and its smaller neighbours link to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        # A node's link to the smallest names the node, each other link the neighbour: one row a link.
        named = F.when(F.col("a") != F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = join_back(large, low, "b").select(F.col("m").alias("a"), named.alias("b")).distinct()
        small = materialize(small, tag)
        state = materialize(contracted(small, small.count()), tag)
        now = _print(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    # now every link is (component, node)
    found = state.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = nodes.withColumnRenamed("a", "node").join(found, "node", "left")
    return roots.select("node", F.coalesce("component", "node").alias("component"))
