"""SimHash near-duplicates found by the generalised pigeonhole principle.

Texts become 64-bit fingerprints; equal fingerprints are one node from then on.
If the bits are cut into m parts and part i gets a threshold t_i >= -1 with
sum(t_i) = k - m + 1, then two fingerprints that differ in k bits at most differ in
t_i bits at most in some part i (a threshold of -1 is never met: the part is not
indexed).  So:

1. bits that vary together over the corpus are put into one part (a 64 x 64 count
   over all fingerprints), which leaves the parts nearly independent;
2. for m = 2, 3, ... a dynamic programme shares out the thresholds with the least
   cost: index rows plus candidates, estimated on ``SAMPLE`` fingerprints;
3. each fingerprint is written once for every way to mask t_i bits of part i, and
   those under one key are candidates of each other;
4. a key with more than ``BLOCK`` fingerprints is replaced by k + 1 finer keys (the
   principle applied to its free bits), again and again: fingerprints are distinct,
   so this ends, and no task ever holds a large group;
5. inside a key all pairs are verified by their exact distance, and only the edges
   of a spanning forest are written, not the pairs;
6. connected components are computed as distributed jobs.

The sample and the estimates only choose among plans that all find every link.

Defined results: texts without words have the fingerprint zero and are linked like
any other; a null text is an empty one; a null doc_id is never a component's id
unless the component has no other; repeated rows share a component; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, drop_scratch, scratch
from .components import bounds, connected_components, forest, whole_groups

BITS, SHINGLE, DISTANCE, HASH_SEED = 64, 3, 3, 42
#: Most fingerprints under one key; more are split.
BLOCK = 1024
#: Fingerprints on which the costs of plans are estimated.
SAMPLE = 20_000
#: Seconds, about, of an index row and of a candidate.
ROW_COST, PAIR_COST = 2e-6, 1e-8
SMALL = 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in more than half of the shingles' hashes; signed, as Spark's long."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), HASH_SEED)]
    else:
        flat = b" ".join(parts)
        ends = (np.fromiter(map(len, parts), np.int64, len(parts)) + 1).cumsum() - 1
        starts = np.concatenate([[0], ends[: -shingle] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], HASH_SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames):
            fp = [fingerprint(t if isinstance(t, str) else None, shingle) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "th": f["th"], "fp": fp})

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("th")).mapInPandas(run, "doc_id long, th long, fp long")


def _bit_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both = np.zeros((BITS, BITS))
    for f in frames:
        b = _bits(f["fp"].to_numpy(np.int64)).astype(np.float32)
        both += b.T @ b
    i, j = np.nonzero(both)
    yield pd.DataFrame({"i": i, "j": j, "n": both[i, j].astype(np.int64)})


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlation(both: np.ndarray, n: int) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width; each grows by the bit most correlated with it."""
    left, parts = list(range(len(corr))), []
    for k in range(m):
        width = math.ceil(len(left) / (m - k))
        part = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: corr[b, part].sum()))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def mask_of(bits) -> int:
    out = 0
    for b in bits:
        out |= 1 << b
    return out


def part_masks(part: list[int], t: int) -> list[int]:
    """The bits to compare exactly, for every choice of t masked bits of a part; none for t = -1."""
    if t < 0:
        return []
    whole = mask_of(part)
    return [whole & ~mask_of(c) for c in itertools.combinations(part, t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pairs_under(sample: np.ndarray, masks: list[int]) -> float:
    """Pairs of the sample that share a key."""
    total = 0.0
    for m in masks:
        c = np.unique(sample & np.uint64(m), return_counts=True)[1].astype(float)
        total += float((c * (c - 1) / 2).sum())
    return total


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the least summed cost whose sum is ``total``: dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for of_part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in of_part.items():
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best.get(total, (math.inf, []))


def plan(both: np.ndarray, n: int, sample: np.ndarray, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of the least estimated cost."""
    corr = correlation(both, n)
    grown = (n / max(len(sample), 1)) ** 2
    options = []
    for m in range(2, distance + 4):
        parts = group_bits(corr, m)
        top = min(distance, 1)  # a part's threshold: 1 at most, more masks cost more than more parts
        costs = []
        for p in parts:
            of_part = {-1: 0.0}
            for t in range(top + 1):
                masks = part_masks(p, t)
                of_part[t] = n * len(masks) * ROW_COST + pairs_under(sample, masks) * grown * PAIR_COST
            costs.append(of_part)
        cost, thresholds = allocate(costs, distance - m + 1)
        if thresholds:
            options.append((cost, m, parts, thresholds))
    _, _, parts, thresholds = min(options, key=lambda o: o[:2])
    return parts, thresholds


def finer(mask: int, distance: int = DISTANCE) -> list[int]:
    """k + 1 masks that each compare one share of the free bits as well."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | mask_of(free[i :: distance + 1]) for i in range(distance + 1)]


def _verify(distance: int):
    keys = ["mask", "value"]

    def edges_of(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        ids, flat = np.unique(np.concatenate([fp[a], fp[b]]), return_inverse=True)
        root = forest(len(ids), flat[: len(a)], flat[len(a) :])
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[own].view(np.int64), "b": ids[root[own]].view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, keys):
            # bits are counted on unsigned numbers: of a signed one, numpy counts those of its absolute value
            fp, at = f["fp"].to_numpy(np.int64).view(np.uint64), bounds(f, keys)
            sizes = np.diff(at)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = np.repeat(sizes <= SMALL, sizes)
            firsts, seconds = [], []
            for d in range(1, min(SMALL, int(sizes.max()))):
                i = np.flatnonzero((group[:-d] == group[d:]) & small[d:])
                if not len(i):
                    break
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
                firsts.append(i)
                seconds.append(i + d)
            if firsts and sum(map(len, firsts)):
                yield edges_of(fp, np.concatenate(firsts), np.concatenate(seconds))
            for g in np.flatnonzero(sizes > SMALL):
                own = fp[at[g] : at[g + 1]]
                a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= distance, 1))
                if len(a):
                    yield edges_of(own, a, b)

    return run


def links(spark: SparkSession, distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """distinct: (fp).  Edges (a, b) whose components are those of all links."""
    n = distinct.count()
    both = np.zeros((BITS, BITS))
    for r in distinct.select("fp").mapInPandas(_bit_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = r["n"]
    every = max(1, n // SAMPLE)
    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(every)) == 0).select("fp").toPandas()["fp"]
    parts, thresholds = plan(both, n, sample.to_numpy(np.int64).view(np.uint64), distance)
    masks = [m for p, t in zip(parts, thresholds) for m in part_masks(p, t)]
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    while True:
        rows = scratch(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "simhash-keys")
        large = scratch(rows.groupBy("mask", "value").count().where(F.col("count") > block).select("mask", "value"), "simhash-large")
        some = large.select("mask").distinct().collect()  # at most a few masks to the power of the round
        cold = rows.join(large, ["mask", "value"], "left_anti") if some else rows
        verified = scratch(
            cold.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInPandas(_verify(distance), "a long, b long"),
            "simhash-links",
        )
        found = verified if found is None else found.unionByName(verified)
        if not some:
            drop_scratch(rows)
            return found
        next_masks = spark.createDataFrame(
            [(r["mask"], _signed(m)) for r in some for m in finer(r["mask"] % (1 << 64), distance)], "mask long, finer long"
        )
        rows = rows.join(large, ["mask", "value"], "left_semi").join(next_masks, "mask").select("fp", F.col("finer").alias("mask"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id, component, th) of every row of (doc_id, text).

    component: the component's least fingerprint; th: hash of the row's id and text, for joining back.
    """
    spark = docs.sparkSession
    marked = scratch(fingerprints(docs, shingle), "fingerprints")
    distinct = scratch(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    component = connected_components(links(spark, distinct, distance, block))
    joined = distinct.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = joined.select("fp", "component").join(least, "component")
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component", "th"
    )


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One document of each component, the one with the least doc_id; the columns of ``docs``."""
    chosen = (
        near_duplicates(docs, **settings)
        .groupBy("component")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("c"))
        .select(F.col("c.doc_id").alias("_d"), F.col("c.th").alias("_t"))
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("th"))
    rows = rows.join(chosen, (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    return rows.dropDuplicates(["th", "doc_id"]).select("row.*")  # rows that agree in id and text are one
