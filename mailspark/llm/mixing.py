"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target in words.  A document of it is taken
``floor(target / source_size)`` times for certain, and once more with the
remaining fraction as its inclusion probability.  The flight phase moves the
fractional probabilities of three documents at a time along the null space of
the two balancing constraints (number of documents, number of words), until each
of a block's documents but two at most is settled at 0 or 1.  Blocks hold about
``BLOCK`` documents of one source, whatever share of the corpus the source has;
what they leave open meets in the next round's blocks, so that no task ever
holds more than a block.

Larger documents are moved first, so the open ones are small and the words taken
land close to the target.  In a source's last block ``HELD`` open documents of all
sizes wait for the landing, which takes the outcome nearest to what is due; until
then each inclusion probability stays what it was.  Draws are seeded by source, round and block: reruns agree.

Defined results: a null text has size 0 and is taken 0 words; a null source is a
source of its own and stands last; repeated rows are separate documents; an
empty table gives an empty result; a source without words has the target 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_sums
from .common import drop_scratch, scratch, text_or_empty, words

#: Documents of a block, about.
BLOCK = 4096
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: The table of sources (not of documents) is planned on the driver; more than this raises.
MAX_SOURCES = 1_000_000
#: A probability this close to 0 or 1 is settled.
EPS = 1e-9
#: Open documents that wait for the landing of a source.
HELD = 12
#: Copies of one row that ``take`` writes at once.
CHUNK = 64


def targets(sizes: Sequence[float], weights: Sequence[float] = WEIGHTS, most: float = MAX_REPEAT) -> list[float]:
    """Words of each source: all words shared by weight (repeating), at most ``most``
    times a source's own; what is above goes to the others by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[i] for i in free)
        over = {i for i in free if rest * w[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = rest * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= over
        rest = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def flight(size: np.ndarray, prob: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Settle probabilities at 0 or 1, keeping their sum and the sum of prob * size; two at most stay open."""
    p = prob.astype(float).tolist()
    s = size.astype(float).tolist()
    active: list[int] = []
    turn = 0
    for k in range(len(p)):
        if p[k] <= EPS or p[k] >= 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        active.append(k)
        while len(active) == 3 or (len(active) == 2 and s[active[0]] == s[active[1]]):
            if len(active) == 2:
                u = (1.0, -1.0)
            else:
                a, b, c = (s[i] for i in active)
                u = (c - b, a - c, b - a)
                if a == b == c:
                    u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u) if v)
            down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u) if v)
            step = up if draws[turn] * (up + down) < down else -down
            turn += 1
            for i, v in zip(active, u):
                p[i] += step * v
                if p[i] <= EPS or p[i] >= 1 - EPS:
                    p[i] = float(round(p[i]))
            active = [i for i in active if 0 < p[i] < 1]
    return np.array(p)


def held_back(prob: np.ndarray, n: int = HELD) -> np.ndarray:
    """Which open documents (sorted by size) wait for the landing: ``n`` spread evenly, so that they are of all sizes."""
    at = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    out = np.zeros(len(prob), bool)
    out[at[np.unique(np.linspace(0, len(at) - 1, min(n, len(at))).astype(int))]] = True
    return out


def landing(size: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Settle the last open ones (``HELD`` + 2 at most) at the outcome whose words, then documents, are nearest to what is due."""
    p = prob.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    outcomes = np.arange(2 ** len(at))[:, None] >> np.arange(len(at)) & 1
    off_words = np.abs(outcomes @ size[at] - (p[at] * size[at]).sum())
    off_docs = np.abs(outcomes.sum(axis=1) - p[at].sum())
    p[at] = outcomes[np.lexsort((off_docs, off_words))[0]]
    return p


def _mover(turn: int, last_of: int):
    return lambda f: _moved(f, turn, last_of)


def _moved(f: pd.DataFrame, turn: int, last_of: int) -> pd.DataFrame:
    f = f.sort_values(["size", "doc_id", "no_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    seed = xxhash.xxh64_intdigest(f"{turn}|{f['source'].iloc[0]!r}|{f['block'].iloc[0]}", 9)
    size = f["size"].to_numpy(float)
    draws = np.random.Generator(np.random.PCG64(seed)).random(3 * len(f) + 3)
    prob, last = f["prob"].to_numpy(float, copy=True), f["blocks"].iloc[0] <= last_of
    moving = ~held_back(prob) if last else np.ones(len(f), bool)
    prob[moving] = flight(size[moving], prob[moving], draws)
    f["prob"] = landing(size, prob) if last else prob
    return f


def _numbered(sizes: DataFrame, chunk: int) -> DataFrame:
    """The rows with ``nth``, which tells apart those that agree in all columns (null ids, repeated rows) and so
    spreads them over the blocks.  They are counted, then written out again ``chunk`` rows a time by many tasks."""
    columns = sizes.columns
    chunks = (
        sizes.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {chunk}"))))
        .repartition("chunk", *columns)
    )
    first = F.col("chunk") * chunk
    return chunks.select(*columns, F.explode(F.sequence(first, F.least(first + (chunk - 1), F.col("n") - 1))).alias("nth"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: float = MAX_REPEAT,
    block: int = BLOCK,
    fan_in: int = 1024,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    spark = docs.sparkSession
    sizes = scratch(
        docs.select("doc_id", "source", F.size(words(text_or_empty())).cast("long").alias("size")), "mix-sizes"
    )
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = []
    for r, target in zip(rows, targets([r["size"] for r in rows], weights, most)):
        rate = min(float(most), target / r["size"]) if r["size"] else 0.0
        base = min(int(most), math.floor(rate + EPS))
        plan.append((r["source"], int(r["size"]), float(target), base, max(0.0, rate - base), math.ceil(r["n"] / block)))
    of_source = spark.createDataFrame(
        plan, "source string, source_size long, target double, base int, prob double, blocks long"
    )
    state = (
        _numbered(sizes, block)
        .join(of_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        # pandas would turn ids with nulls among them into floats
        .withColumn("no_id", F.col("doc_id").isNull())
        .withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "nth"), F.col("blocks")))
        .drop("nth")
    )
    settled, turn, last_of = [], 0, 1
    most_blocks = max((p[5] for p in plan), default=1)
    while True:
        moved = scratch(
            state.groupBy("source", "block").applyInPandas(_mover(turn, last_of), state.schema),
            f"mix-round{turn}",
        )
        settled.append(moved.where("prob = 0 or prob = 1"))
        if last_of >= most_blocks:
            break
        turn, last_of = turn + 1, last_of * fan_in
        state = moved.where("prob > 0 and prob < 1").withColumn("block", F.floor(F.col("block") / fan_in))
    drop_scratch(sizes)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = (F.col("base") + F.col("prob")).cast("long")
    return out.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def take(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    What is due to an id, source and size is shared out in the order of hashes of the whole rows, by running
    sums over ranges.  Equal rows (columns that hold maps aside) are one row that is written as often as they
    are taken together, ``CHUNK`` times at once.
    """
    said = [x for f in docs.schema if "map<" not in f.dataType.simpleString() for x in (F.col(f.name), F.col(f.name).isNull())]
    size = F.size(words(text_or_empty())).cast("long")
    hashes = [F.xxhash64(*said).alias("a"), F.xxhash64(F.lit("row"), *said).alias("b")]
    keys = ["doc_id", "source", "size"]
    kinds = docs.select("doc_id", "source", size.alias("size"), *hashes).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    kinds = running_sums(kinds, keys, ["a", "b"], {"upto": F.col("n")})
    due = mix(docs, **settings).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("due"))
    due = due.where("due > 0").toDF("_d", "_s", "_z", "rows", "due")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    more = F.expr("due % rows") - (F.col("upto") - F.col("n"))  # rows from here on that are taken once more
    copies = F.col("n") * F.expr("due div rows") + F.greatest(F.lit(0), F.least(F.col("n"), more))
    chunks = (
        kinds.join(due, on)
        .select("a", "b", copies.alias("copies"))
        .where("copies > 0")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))))
        .select("a", "b", F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK).cast("int").alias("copies"))
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), *hashes).dropDuplicates(["a", "b"])
    return rows.join(chunks, ["a", "b"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
