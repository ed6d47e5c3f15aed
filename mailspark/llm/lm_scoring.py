"""Language-model scoring: prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes, learned from the
training documents (A-Z lower-cased, each closed by an end symbol).  A symbol is
coded at the longest known context that has seen it, with probability (2c - 1) / 2n;
every context on the way down is escaped from with probability q / 2n (q distinct
symbols among n), and the symbols it has seen are excluded below.  A symbol seen in a context is also
seen in every shorter one, so exclusion needs just two sums per context, and code
lengths are computed for all distinct (context, symbol) grams of a batch at once.

All grams of all documents are counted (a native aggregate adds up what tasks
count), and every node of the trie is used, whatever the corpus.  The distinct grams
lie in key order, last context byte first, so that each context of any length is one
stretch of them.  They are cut into bins of about ``BIN`` grams at quantiles.  A bin's
task builds the trie of its own contexts and scores its grams; contexts that a cut
goes through (at most one of each order for each cut, the empty one and those of one byte)
are summed over all bins first and broadcast.  A hot context is thus cut like any other.

Documents look their grams up in a broadcast cache of the ``CACHED`` most frequent
at most; all others are joined with the table of scores.

Beside it stands a word-unigram score.  Words up to a frequency rank are looked up
in a broadcast table of ``FREQUENT`` words at most; the rest is joined, so every
word's exact count is used.

Defined results: a null or empty text is its end symbol (end token) alone; repeated
rows count as often as they stand there; a null doc_id is neither held out nor
learned from; without training documents every byte symbol has the same
probability; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_scratch, scratch
from .components import whole_groups

ORDER = 5
#: Symbols are the bytes and the end of a text, in 9 bits each.
END, WIDTH = 256, 9
SYMBOL = (1 << WIDTH) - 1
FREQUENT = 100_000
#: Distinct grams of a bin, about, and scores that are broadcast at most.
BIN, CACHED = 250_000, 1_000_000
#: Bytes that are worked on at once, and distinct grams or words a task holds before it emits them.
CHUNK, HELD = 2 << 20, 4_000_000


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram (``order`` symbols of context and the symbol) at each place of each text, its end
    symbol included, and where each text's grams start.  Before a text stand end symbols."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = sizes.cumsum() - sizes
    flow = np.full(int(sizes.sum()), END, np.int64)
    raw = np.frombuffer(b"\0".join(texts), np.uint8)
    flow[: len(raw)] = raw
    ends = starts + sizes - 1
    flow[ends] = END
    out = flow.copy()
    for back in range(1, order + 1):
        earlier = np.full(len(flow), END, np.int64)
        earlier[back:] = flow[:-back] if back < len(flow) else flow[:0]
        for k in range(back):  # places whose context reaches before their text
            at = starts + k
            earlier[at[at <= ends]] = END
        out |= earlier << (WIDTH * back)
    return out, starts


def _chunks(frames: Iterator[pd.DataFrame], *columns: str):
    """Lists of lower-cased texts of about CHUNK bytes, with the rows they came from."""
    for f in batches(frames, CHUNK):
        yield f, [t.encode().lower() if isinstance(t, str) else b"" for t in f["text"]]


def by_context(gram: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram with its context turned round, the last symbol on top; turns it back, too."""
    out = gram & SYMBOL
    for i in range(1, order + 1):
        out |= (gram >> (WIDTH * i) & SYMBOL) << (WIDTH * (order + 1 - i))
    return out


def _summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of g and the sum of n for each."""
    by = np.argsort(g, kind="stable")
    g, n = g[by], n[by]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(n, first) if len(g) else n


def gram_counts(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """(key, n, m) of all documents' grams, turned by ``by_context``; n: times in training documents, m: in all."""

    def rows(g: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": by_context(g >> 1, order), "n": n * (g & 1), "m": n})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for f, texts in _chunks(frames):
            g, starts = grams(texts, order)
            learned = np.repeat(f["learned"].to_numpy(bool), np.diff(np.append(starts, len(g))))
            parts.append(np.unique(g << 1 | learned, return_counts=True))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [_summed(*(np.concatenate(x) for x in zip(*parts)))]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield rows(*parts[0])
                    parts, held = [], 0
        if parts:
            yield rows(*_summed(*(np.concatenate(x) for x in zip(*parts))))

    counted = docs.select("text", F.coalesce(train, F.lit(False)).alias("learned")).mapInPandas(run, "key long, n long, m long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Trie:
    """Sorted grams of every order with the sums that coding needs."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]):
        """nodes: for each order from 0 on, sorted grams and their counts; every gram's suffixes are there too."""
        self.orders = []
        for o, (g, c) in enumerate(nodes):
            context, first = np.unique(g >> WIDTH, return_index=True)
            n = np.add.reduceat(c, first) if len(g) else c
            q = np.diff(np.append(first, len(g)))
            below = np.zeros(len(context), np.int64)
            if o and len(g):
                lower, counts = nodes[o - 1]
                suffix = g & ((1 << (WIDTH * o)) - 1)
                below = np.add.reduceat(counts[np.searchsorted(lower, suffix)], first)
            self.orders.append((g, c, context, n, q, below))

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        out = np.zeros(len(gram))
        at = np.arange(len(gram))
        less_n = np.zeros(len(gram), np.int64)  # of the context escaped from last: what it has seen, counted here
        less_q = np.zeros(len(gram), np.int64)
        for o in range(len(self.orders) - 1, -1, -1):
            g, c, context, n, q, below = self.orders[o]
            if not len(g) or not len(at):
                continue
            sub = gram[at] & ((1 << (WIDTH * (o + 1))) - 1)
            k = np.minimum(np.searchsorted(context, sub >> WIDTH), len(context) - 1)
            known = context[k] == sub >> WIDTH
            total, distinct = n[k] - less_n[at], q[k] - less_q[at]
            j = np.minimum(np.searchsorted(g, sub), len(g) - 1)
            hit = known & (g[j] == sub)
            out[at[hit]] += np.log10((c[j[hit]] - 0.5) / total[hit])
            miss = known & ~hit
            some = miss & (distinct > 0)  # with nothing new here, the escape is certain
            out[at[some]] += np.log10(0.5 * distinct[some] / total[some])
            less_n[at[miss]], less_q[at[miss]] = below[k[miss]], q[k[miss]]
            at = at[~hit]
        seen = len(self.orders[0][0]) if self.orders else 0
        out[at] -= math.log10(max(1, END + 1 - seen))
        return out


def _of_order(gram: np.ndarray, o: int) -> np.ndarray:
    return gram & ((1 << (WIDTH * (o + 1))) - 1)


def _cut_contexts(cuts: np.ndarray, order: int) -> list[np.ndarray | None]:
    """For each order the contexts that may lie in several bins, as in a gram of that order; None: all."""
    first = by_context(cuts, order)
    return [None if o < 2 else np.unique(_of_order(first, o) >> WIDTH) for o in range(order + 1)]


def _split_nodes(counts: DataFrame, cut: list[np.ndarray | None], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted nodes of each order in contexts that may lie in several bins, with their counts.

    They come to the driver: 257 * 258 of orders 0 and 1 at most, and 257 of each further order for each cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            g, n = by_context(f["key"].to_numpy(np.int64), order), f["n"].to_numpy(np.int64)
            for o in range(order + 1):
                x = _of_order(g, o)
                here = np.ones(len(x), bool) if cut[o] is None else np.isin(x >> WIDTH, cut[o])
                x, c = _summed(x[here], n[here])
                yield pd.DataFrame({"o": np.full(len(x), o, np.int32), "node": x, "n": c})

    nodes = counts.where("n > 0").select("key", "n").mapInPandas(run, "o int, node long, n long")
    o, node, n = _collected(nodes.groupBy("o", "node").agg(F.sum("n").alias("n")), o=np.int32, node=np.int64, n=np.int64)
    return [_summed(node[o == k], n[o == k]) for k in range(order + 1)]


def _collected(rows: DataFrame, **columns) -> list[np.ndarray]:
    """The columns of a table that is small enough for the driver, sent as packed arrays of these types."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({c: [f[c].to_numpy(t).tobytes()] for c, t in columns.items()})

    got = rows.select(*columns).mapInPandas(packed, ", ".join(f"{c} binary" for c in columns)).collect()
    return [np.frombuffer(b"".join(bytes(r[c]) for r in got), t) for c, t in columns.items()]


def gram_scores(counts: DataFrame, order: int = ORDER, max_nodes: int | None = None, bin_rows: int = BIN) -> DataFrame:
    """(key, m, score) of all rows of ``gram_counts``; score: log10 probability of the gram's symbol after its context.

    max_nodes: ask for a smaller model, without nodes below the least count that so many nodes reach."""
    spark = counts.sparkSession
    least = _least_count(_all_nodes(counts, order), max_nodes) if max_nodes is not None else 0
    n = counts.count()
    bins = max(1, -(-n // bin_rows), min(-(-n // 1024), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / bins for i in range(1, bins)]
    cuts = counts.agg(F.percentile_approx("key", shares, 20 * bins).alias("k")).first()["k"] if shares else []
    cuts = np.unique(np.array(cuts, np.int64))
    cut = _cut_contexts(cuts, order)
    held = spark.sparkContext.broadcast((cut, _split_nodes(counts, cut, order)))

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(bin=np.searchsorted(cuts, f["key"].to_numpy(np.int64), side="right").astype(np.int32))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, split = held.value
        for f in whole_groups(frames, ["bin"]):
            g, n = by_context(f["key"].to_numpy(np.int64), order), f["n"].to_numpy(np.int64)
            nodes = []
            for o in range(order + 1):
                x, c = split[o]
                if cut[o] is not None:
                    own = _of_order(g, o)
                    here = (n > 0) & ~np.isin(own >> WIDTH, cut[o])
                    x, c = _summed(np.concatenate([x, own[here]]), np.concatenate([c, n[here]]))
                nodes.append((x[c >= least], c[c >= least]))
            yield pd.DataFrame({"key": f["key"], "m": f["m"], "score": Trie(nodes).log10(g)})

    rows = counts.mapInPandas(dealt, "key long, n long, m long, bin int")
    return rows.repartitionById(bins, F.col("bin")).sortWithinPartitions("bin").mapInPandas(run, "key long, m long, score double")


def _all_nodes(counts: DataFrame, order: int) -> DataFrame:
    """(n) of all nodes of all orders."""
    learned, out = counts.where("n > 0"), None
    for o in range(order + 1):
        context = F.shiftright("key", WIDTH * (order + 1 - o))
        nodes = learned.groupBy(context, F.col("key").bitwiseAND(SYMBOL)).agg(F.sum("n").alias("n")).select("n")
        out = nodes if out is None else out.unionAll(nodes)
    return out


def _least_count(counted: DataFrame, most: int) -> float:
    """The least count (a step of an eighth of a power of two) that ``most`` rows at most reach."""
    step = F.floor(F.log2("n") * 8).cast("int")
    hist = sorted((r["s"], r["k"]) for r in counted.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect())
    left = sum(k for _, k in hist)
    for s, k in hist:
        if left <= most:
            return 2 ** (s / 8) - 1e-9
        left -= k
    return math.inf


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all training documents; words are lower-cased bytes as text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for _, texts in _chunks(frames):
            for t in texts:
                held.update(t.split())
            if len(held) > HELD // 8:
                yield _frame(held)
                held = Counter()
        yield _frame(held)

    def _frame(held: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": list(held.keys()), "n": np.fromiter(held.values(), np.int64, len(held))})

    return train.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


SCORED = (
    "row long, doc_id long, n_words long, known long, logs double, score double, tail array<binary>, times array<long>, "
    "rest array<long>, rest_times array<long>"
)


def score_documents(
    docs: DataFrame,
    train: Column,
    held_out: Column,
    order: int = ORDER,
    max_nodes: int | None = None,
    frequent: int = FREQUENT,
    cached: int = CACHED,
    bin_rows: int = BIN,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of (doc_id, text).

    train: which rows to learn from.  max_nodes: as in ``gram_scores``; all nodes unless it is given.
    """
    spark = docs.sparkSession
    chosen = docs.where(train).select("text")
    counts = scratch(gram_counts(docs, train, order), "grams")
    scores = scratch(gram_scores(counts, order, max_nodes, bin_rows), "gram-scores")
    drop_scratch(counts)
    least_seen = _least_count(scores.select(F.col("m").alias("n")), cached)
    kept, value = _collected(scores.where(F.col("m") >= least_seen), key=np.int64, score=np.float64)  # ``cached`` rows at most
    kept = by_context(kept, order)
    by = np.argsort(kept)
    held = spark.sparkContext.broadcast((kept[by], value[by]))
    words = scratch(word_counts(chosen), "word-counts")
    ends = chosen.count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, vocabulary = total["n"] + ends, total["v"] + (1 if ends else 0)
    least = _least_count(words, frequent)
    common = words.where(F.col("n") >= least).toPandas()  # ``frequent`` rows at most
    lookup = spark.sparkContext.broadcast(
        {bytes(w): (int(n), math.log10(n + 0.1)) for w, n in zip(common["word"], common["n"])}
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (kept, value), known_words = held.value, lookup.value
        row = TaskContext.get().partitionId() << 40
        for f, texts in _chunks(frames):
            g, starts = grams(texts, order)
            distinct, place = np.unique(g, return_inverse=True)
            logs10, there = np.zeros(len(distinct)), np.zeros(len(distinct), bool)
            if len(kept):
                at = np.minimum(np.searchsorted(kept, distinct), len(kept) - 1)
                there = kept[at] == distinct
                logs10[there] = value[at[there]]
            away = ~there[place]
            rest, rest_times = [], []
            for x, y, some in zip(starts, np.append(starts[1:], len(g)), np.logical_or.reduceat(away, starts)):
                k, c = np.unique(by_context(g[x:y][away[x:y]], order), return_counts=True) if some else ([], [])
                rest.append(k)
                rest_times.append(c)
            out = {
                "row": np.arange(row, row + len(f)),
                "doc_id": f["doc_id"].astype("Int64").to_numpy(),
                "score": np.add.reduceat(logs10[place], starts),
            }
            row += len(f)
            n_words, known, logs, tails, times = [], [], [], [], []
            for t in texts:
                own = Counter(t.split())
                n, s, tail = 0, 0.0, []
                for w, k in own.items():
                    if e := known_words.get(w):
                        n += k
                        s += k * e[1]
                    else:
                        tail.append(w)
                n_words.append(own.total())
                known.append(n)
                logs.append(s)
                tails.append(tail)
                times.append([own[w] for w in tail])
            yield pd.DataFrame(out | {"n_words": n_words, "known": known, "logs": logs, "tail": tails, "times": times, "rest": rest, "rest_times": rest_times})

    names = [c.split()[0] for c in SCORED.split(", ")]
    scored = docs.select("doc_id", "text").mapInPandas(lambda frames: (f[names] for f in run(frames)), SCORED)
    scored = scratch(scored, "scored")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", "x.tail", "x.times")
    n = F.coalesce("n", F.lit(0))
    tail = (
        tail.join(words.where(F.col("n") < least), F.col("tail") == F.col("word"), "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(n + 0.1)).alias("tail_logs"),
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        )
    )
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("key"), "x.rest_times")
    rest = (
        rest.join(scores.where(F.col("m") < least_seen).select("key", F.col("score").alias("each")), "key")
        .groupBy("row")
        .agg(F.sum(F.col("rest_times") * F.col("each")).alias("rest_score"))
    )
    denominator = math.log10(tokens + 0.1 * (vocabulary + 1))
    n_tokens = F.col("n_words") + 1
    logs = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) + F.lit(math.log10(ends + 0.1))
    return scored.drop("tail", "times", "rest", "rest_times").join(tail, "row", "left").join(rest, "row", "left").select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (logs - n_tokens * F.lit(denominator)).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )
