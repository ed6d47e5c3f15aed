"""Connected components as DataFrame jobs, and helpers for groups inside tasks.

``connected_components`` alternates the large-star and small-star steps: every
step is two aggregates and a join, each round is written to the shared scratch
folder (so lineage stays short and a lost executor costs a task), and no node's
neighbours are ever gathered in one place: a star with a third of all nodes is a
skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs.  (node, component) of every node that has an edge to another; component: its least node."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch(e, "edges")
    before = None
    while (state := _state(e)) != before and state[0]:
        before = state
        both = e.union(e.select("v", "u"))
        # the aggregates are written, too: next to one, adaptive execution could not split the other side of a join
        least = scratch(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("c")).where("v > u")
        large = scratch(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        drop_scratch(least)
        least = scratch(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), "least")
        joined = large.join(least, F.col("u") == F.col("c")).where("v <> m")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("c", "m"))
        after = scratch(small.distinct(), "small-star")
        for old in (e, large, least):
            drop_scratch(old)
        e = after
    # every node is now the point of one star; its centre is the component's least node
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of a partition sorted by ``keys``, cut so that no group is in two of them."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        changed = np.zeros(len(f), bool)
        for k in keys:
            v = f[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(changed)[-1]) if changed.any() else 0
        if held and any(held[-1][k].iloc[-1] != f[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if last:
            done = f.iloc[:last]
            yield pd.concat([*held, done], ignore_index=True) if held else done
            held = []
        held.append(f.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def bounds(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Starts of the groups of a sorted frame, and its length."""
    changed = np.ones(len(f), bool)
    if len(f):
        changed[1:] = False
        for k in keys:
            v = f[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(changed), len(f))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member (a number from 0 to n-1) of each number's component under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while True:
            further = new[new]
            if np.array_equal(further, new):
                break
            new = further
        if np.array_equal(new, root):
            return root
        root = new
