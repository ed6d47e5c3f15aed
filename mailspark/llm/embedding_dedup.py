"""Embedding near-duplicates: sign hashing in several tables, exact cosine, components.

Equal vectors are counted once and stand for their copies.  Each distinct vector
falls into one bucket of every table by the signs of its products with random
hyperplanes; the number of planes follows the number of vectors (about
``BUCKET`` of unrelated ones share a bucket) and the number of tables follows from
the recall wanted at the threshold.  Inside a bucket all cosines are computed in
double precision.  A pair counts in the first table that brings it together, so
links are counted once without ever writing pairs: a bucket returns each member's
number of links and one edge to the least member linked with it.

A bucket of more than ``BLOCK`` vectors is cut into blocks, and each two blocks
meet in a task of their own; nothing is dropped.

Defined results: a vector that is null, zero or holds null or non-finite numbers,
and one whose id is null, links with nothing and is kept; vectors of different
lengths are never linked; repeated rows are vectors of their own; an empty table
gives an empty result; labels and further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .components import bounds, connected_components, forest, whole_groups

THRESHOLD, RECALL = 0.95, 0.98
BUCKET, BLOCK, SEED = 64, 1024, 99

KEYS = ["t", "bucket", "i", "j"]


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Planes per table and tables: a pair at the threshold meets in some table with probability ``recall``."""
    planes = min(40, max(4, math.ceil(math.log2(max(n, 2) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def unit(v) -> np.ndarray | None:
    """A vector scaled to length 1, in double precision; None if it cannot be."""
    if v is None:
        return None
    x = np.asarray(v, dtype=float)  # None becomes nan
    most = np.abs(x).max(initial=0.0)
    if not len(x) or not np.isfinite(x).all() or most == 0:
        return None
    x = x / most
    return x / math.sqrt(float(x @ x))


def _content(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """128-bit hash of each usable vector's numbers."""
    for f in frames:
        halves = []
        for i, v in zip(f["vec_id"], f["embedding"]):
            if pd.isna(i) or unit(v) is None:
                halves.append((None, None))
            else:
                h = xxhash.xxh3_128_intdigest((np.asarray(v, float) + 0.0).tobytes())  # + 0.0: -0.0 is 0.0
                halves.append(((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63))
        out = pd.DataFrame(halves, columns=["h1", "h2"], dtype="Int64")
        out.insert(0, "vec_id", f["vec_id"].astype("Int64").to_numpy())
        out["embedding"] = f["embedding"].to_numpy()
        yield out


def _signed(planes: int, tables: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normals: dict[int, np.ndarray] = {}
        for f in frames:
            sigs = []
            for v in f["embedding"]:
                x = unit(v)
                if len(x) not in normals:
                    rng = np.random.Generator(np.random.PCG64([SEED, len(x)]))
                    normals[len(x)] = rng.standard_normal((tables * planes, len(x)))
                signs = (normals[len(x)] @ x >= 0).reshape(tables, planes)
                # the length is part of the bucket: vectors of other lengths never meet
                sigs.append((signs @ (1 << np.arange(planes, dtype=np.int64))) + (len(x) << 40))
            yield f.assign(sigs=sigs)

    return run


def _linked(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, KEYS):
            f = f.reset_index(drop=True)
            at = bounds(f, KEYS)
            ids, copies, part = f["rep"].to_numpy(), f["copies"].to_numpy(), f["part"].to_numpy()
            out = []
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo < 2:
                    continue
                t, i, j = int(f["t"].iloc[lo]), int(f["i"].iloc[lo]), int(f["j"].iloc[lo])
                x = np.stack([unit(v) for v in f["embedding"].iloc[lo:hi]])
                close = np.triu(x @ x.T >= threshold, 1)
                if i != j:  # two blocks: only pairs across
                    close &= part[lo:hi, None] != part[None, lo:hi]
                a, b = np.nonzero(close)
                if t and len(a):
                    earlier = np.stack([s[:t] for s in f["sigs"].iloc[lo:hi]])
                    new = ~(earlier[a] == earlier[b]).any(axis=1)
                    a, b = a[new], b[new]
                if not len(a):
                    continue
                c = copies[lo:hi]
                links = np.bincount(a, c[b], hi - lo) + np.bincount(b, c[a], hi - lo)
                who = np.flatnonzero(links)
                order = np.argsort(ids[lo:hi], kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(hi - lo)
                peer = ids[lo:hi][order[forest(hi - lo, rank[a], rank[b])[rank]]]
                out.append(pd.DataFrame({"rep": ids[lo:hi][who], "links": links[who].astype(np.int64), "peer": peer[who]}))
            if out:
                yield pd.concat(out)

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    base = scratch(
        vectors.select("vec_id", "embedding").mapInPandas(_content, f"vec_id long, h1 long, h2 long, embedding {kind}"), "vectors"
    )
    usable = base.where("h1 is not null")
    reps = scratch(
        usable.groupBy("h1", "h2").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
        ),
        "distinct-vectors",
    )
    planes, tables = tables_for(reps.count(), threshold, recall)
    signed = scratch(
        reps.select("rep", "copies", "embedding").mapInPandas(
            _signed(planes, tables), f"rep long, copies long, embedding {kind}, sigs array<long>"
        ),
        "signed-vectors",
    )
    narrow = signed.select(F.posexplode("sigs").alias("t", "bucket"))
    large = narrow.groupBy("t", "bucket").count().where(F.col("count") > block)
    # a table of its own, so that adaptive execution can split a large bucket's side of the join
    large = scratch(large.select("t", "bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-buckets")
    members = signed.select("*", F.posexplode("sigs").alias("t", "bucket")).join(large, ["t", "bucket"], "left")
    members = members.withColumn("part", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    met = members.withColumn("o", other).select(
        "t", "bucket", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "rep", "copies", "sigs", "embedding"
    )
    found = scratch(
        met.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(_linked(threshold), "rep long, links long, peer long"),
        "links",
    )
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    of_rep = (
        reps.select("h1", "h2", "rep", "copies")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(component.withColumnRenamed("node", "rep"), "rep", "left")
    )
    out = base.select("vec_id", "h1", "h2").join(of_rep, ["h1", "h2"], "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
