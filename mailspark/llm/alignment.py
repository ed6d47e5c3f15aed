"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers write the same bytes, so a byte offset where tokens of both end cuts a
text into two parts that can be aligned apart.  An interval of tokens is searched for
such an offset near its middle: the ends of the one tokenizer, from the middle outwards,
are bisected among the other's.  Both halves are treated alike; an interval without a
cut inside is a leaf, a group of tokens of both that stand for the same bytes.  All open
intervals of a batch of documents are halved at the same time, so the number of steps
follows the longest text's logarithm and its longest group.

Two tokens of a group are linked.  How many documents link a pair of ids is counted over
the corpus, and every document is given the sum of its links' counts and how many of
them are the best of their first id.  Tasks keep each document's distinct pairs with
their multiplicity (a long group's pairs come from its distinct ids, never as a list of
occurrences; the others are gathered ``PAIRS`` at a time), count pairs per batch first, and look up the
most frequent pairs, at most ``TABLE`` of them, in a table that is broadcast.  All other
pairs, each in few documents, meet their counts in a join.

Defined results: a null or empty text, or one whose tokens' bytes differ from the text
with a space before it, has no tokens: zeros and an empty string.  Repeated rows are
documents of their own and count as often as they stand there; rows without an id are
kept; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_scratch, giving_back, scratch
from .tokens import ByteTokens, PieceTokens, loaded, spread

#: Pairs of ids whose counts are broadcast, at most: 16 bytes each.
TABLE = 1_000_000
#: Characters of text that a task handles at once, and pairs that it holds at once.
BATCH, PAIRS = 1 << 20, 1 << 19

ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "groups string, pairs binary, times binary"
)


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Tokens of a whose end is an end of b, ascending: the last of each interval [lo, hi), which is given, and all found inside."""
    found = [hi[hi > lo] - 1]
    lo, hi = lo.copy(), hi - 1  # where a cut may still be: before the last token's end
    while (open_ := hi > lo).any():
        lo, hi = lo[open_], hi[open_]
        cut = _near_middle(a_ends, b_ends, lo, hi)
        split = cut >= 0
        lo, hi, cut = lo[split], hi[split], cut[split]
        found.append(cut)
        lo = np.stack([lo, cut + 1], 1).ravel()
        hi = np.stack([cut, hi], 1).ravel()
    return np.sort(np.concatenate(found))


def _near_middle(a_ends, b_ends, lo, hi) -> np.ndarray:
    """For each interval, the token of a nearest its middle whose end is an end of b; -1 if there is none."""
    cut = np.full(len(lo), -1)
    todo, middle, step = np.arange(len(lo)), (lo + hi - 1) // 2, 0
    while len(todo):
        for at in (middle[todo] - step, middle[todo] + step) if step else (middle[todo],):
            inside = (at >= lo[todo]) & (at < hi[todo]) & (cut[todo] < 0)
            ends = a_ends[at[inside]]
            place = np.minimum(np.searchsorted(b_ends, ends), len(b_ends) - 1)
            hit = todo[inside][b_ends[place] == ends]
            cut[hit] = at[inside][b_ends[place] == ends]
        step += 1
        todo = todo[(cut[todo] < 0) & ((middle[todo] - step >= lo[todo]) | (middle[todo] + step < hi[todo]))]
    return cut


class Words:
    """Decimal numbers with what follows them, as rows of bytes."""

    ENDS = (",", "|", ";", "")

    def __init__(self, n: int):
        text = np.array([f"{i}{e}" for i in range(n) for e in self.ENDS], "S")
        self.bytes = text.view(np.uint8).reshape(len(text), -1)
        self.lengths = (self.bytes > 0).sum(1)

    def join(self, symbols: np.ndarray) -> tuple[bytes, np.ndarray]:
        lengths = self.lengths[symbols]
        rows = self.bytes[symbols]
        return rows[np.arange(rows.shape[1]) < lengths[:, None]].tobytes(), np.cumsum(lengths)


_WORDS: dict[int, Words] = {}


def words_of(n: int) -> Words:
    if n not in _WORDS:
        _WORDS[n] = Words(n)
    return _WORDS[n]


class Aligned:
    """Groups of a batch of texts: tokens of both tokenizers, of all texts one after another."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray, a_at: np.ndarray, b_at: np.ndarray):
        """a, b: ids; a_lengths, b_lengths: bytes of each token; a_at, b_at: n + 1 places of the texts, none of them empty."""
        self.a, self.b, self.a_at, self.b_at = a.astype(np.int64), b.astype(np.int64), a_at, b_at
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        cuts = shared_ends(a_ends, b_ends, a_at[:-1], a_at[1:])
        self.a_end = cuts + 1
        self.b_end = np.searchsorted(b_ends, a_ends[cuts]) + 1 if len(cuts) else cuts
        self.n_a, self.n_b = np.diff(self.a_end, prepend=0), np.diff(self.b_end, prepend=0)
        self.doc = np.searchsorted(a_at[1:], self.a_end)

    def texts(self, words: Words) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        group = np.arange(len(self.a_end))
        of_a, of_b = np.repeat(group, self.n_a), np.repeat(group, self.n_b)
        i, j = np.arange(len(self.a)), np.arange(len(self.b))
        symbols = np.empty(len(i) + len(j), np.int64)
        symbols[i + (self.b_end - self.n_b)[of_a]] = self.a * 4 + (i + 1 == self.a_end[of_a])
        last = np.zeros(len(j), np.int64)
        last[self.b_end - 1] = 2
        last[self.b_at[1:] - 1] = 3
        symbols[j + self.a_end[of_b]] = self.b * 4 + last
        raw, ends = words.join(symbols)
        start = 0
        for end in ends[(self.a_at + self.b_at)[1:] - 1].tolist() if len(symbols) else ():
            yield raw[start:end]
            start = end

    def links(self, n_b_ids: int, limit: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text << 32 | a * n_b_ids + b), ascending, and how many links each stands for."""
        size = self.n_a * self.n_b
        big = size > limit // 32
        parts = [self._large(g, n_b_ids, limit) for g in np.flatnonzero(big).tolist()]
        small = np.flatnonzero(~big)
        block = np.cumsum(size[small]) // limit
        for g in np.split(small, np.flatnonzero(np.diff(block)) + 1):
            i = spread((self.a_end - self.n_a)[g], self.n_a[g])
            per = np.repeat(self.n_b[g], self.n_a[g])
            j = spread(np.repeat((self.b_end - self.n_b)[g], self.n_a[g]), per)
            text = np.repeat(np.repeat(self.doc[g], self.n_a[g]), per)
            parts.append(np.unique((text << 32) + np.repeat(self.a[i], per) * n_b_ids + self.b[j], return_counts=True))
        return added(parts)

    def _large(self, g: int, n_b_ids: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        a, a_times = np.unique(self.a[self.a_end[g] - self.n_a[g] : self.a_end[g]], return_counts=True)
        b, b_times = np.unique(self.b[self.b_end[g] - self.n_b[g] : self.b_end[g]], return_counts=True)
        keys = ((self.doc[g] << 32) + a * n_b_ids)[:, None] + b  # distinct ids of one text's group
        return keys.ravel(), (a_times[:, None] * b_times).ravel()


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of several lists of (keys, numbers), with the sums of their numbers."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(numbers, first) if len(first) else numbers


def same_bytes(ids: np.ndarray, at: np.ndarray, spelled: list[bytes], texts: list[str]) -> list[bool]:
    ids, at = ids.tolist(), at.tolist()
    return [b"".join([spelled[i] for i in ids[p:q]]) == t.encode() for t, p, q in zip(texts, at, at[1:])]


def aligned(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, with_groups: bool = False) -> DataFrame:
    """The groups and distinct linked pairs of every document (see ``ALIGNED``); ``groups`` only on request."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = loaded(ByteTokens, byte_tokenizer, True), loaded(PieceTokens, piece_tokenizer)
        a_bytes, b_bytes = first.bytes_of(), second.bytes_of()
        a_size, b_size = np.array(list(map(len, a_bytes))), np.array(list(map(len, b_bytes)))
        words, row = words_of(max(len(a_bytes), len(b_bytes))), TaskContext.get().partitionId() << 40
        for f in batches(frames, BATCH):
            texts = [" " + t if isinstance(t, str) else " " for t in f["text"]]
            array = pa.array(texts, pa.large_string())
            (a, a_at), (b, b_at) = first.ids(array), second.ids(array)
            good = np.array([len(t) > 1 for t in texts])
            good &= same_bytes(a, a_at, a_bytes, texts)
            good &= same_bytes(b, b_at, b_bytes, texts)
            a, a_at = _only(a, a_at, good)
            b, b_at = _only(b, b_at, good)
            groups = Aligned(a, b, a_size[a], b_size[b], a_at, b_at)
            keys, times = groups.links(len(b_bytes))
            place = np.searchsorted(keys, np.arange(len(a_at)) << 32).tolist()
            pairs, times = (keys & 0xFFFFFFFF).astype("<u4"), times.astype("<u8")
            n_groups = np.bincount(groups.doc, minlength=len(a_at) - 1)
            n_links = np.bincount(groups.doc, groups.n_a * groups.n_b, minlength=len(a_at) - 1).astype(np.int64)
            rows, said = [], groups.texts(words)
            k = 0
            for doc_id, ok in zip(f["doc_id"].tolist(), good.tolist()):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if ok:
                    text, p, q = next(said), place[k], place[k + 1]
                    counts = (a_at[k + 1] - a_at[k], b_at[k + 1] - b_at[k], n_groups[k], n_links[k])
                    sha = hashlib.sha256(text).hexdigest()
                    rows.append((row, doc_id, *counts, sha, text.decode() if with_groups else None, pairs[p:q].tobytes(), times[p:q].tobytes()))
                    k += 1
                else:
                    rows.append((row, doc_id, 0, 0, 0, 0, "", "" if with_groups else None, b"", b""))
                row += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(giving_back(run), ALIGNED)


def _only(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and places of the texts that ``good`` marks."""
    lengths = np.diff(at)[good]
    if not good.all():
        ids = ids[spread(at[:-1][good], lengths)]
    return ids, np.concatenate([[0], np.cumsum(lengths)])


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): in how many documents a pair of ids is linked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, BATCH, "pairs"):
            pair, n = np.unique(np.frombuffer(b"".join(f["pairs"]), "<u4"), return_counts=True)
            yield pd.DataFrame({"pair": pair.astype(np.int64), "n": n})

    return found.select("pairs").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> int:
    """The least count that ``most`` pairs at most reach, of powers of two."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()  # 63 rows at most
    least, total = 62, 0
    for power, n in sizes:
        total += n
        if total > most:
            break
        least = power
    return 1 << least


def align(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, table: int = TABLE, with_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, on request)."""
    spark, n_b_ids = docs.sparkSession, len(loaded(PieceTokens, piece_tokenizer).pieces)
    found = scratch(aligned(docs, byte_tokenizer, piece_tokenizer, with_groups), "aligned")
    counts = scratch(pair_counts(found).withColumn("a", F.floor(F.col("pair") / n_b_ids)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of the vocabulary at most
    judged = counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    judged = scratch(judged, "pair-judged")
    least = frequent(counts, table)
    known = judged.where(F.col("n") >= least).toPandas().sort_values("pair")  # ``table`` rows at most
    shared = spark.sparkContext.broadcast(
        (known["pair"].to_numpy("u4"), known["n"].to_numpy(np.int64), known["best"].to_numpy(np.int8))
    )

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counted, is_best = shared.value
        for f in batches(frames, BATCH, "pairs"):
            pairs = np.frombuffer(b"".join(f["pairs"]), "<u4")
            times = np.frombuffer(b"".join(f["times"]), "<u8").astype(np.int64)
            sizes = f["pairs"].str.len().to_numpy(np.int64) // 4
            of_row = np.repeat(np.arange(len(f)), sizes)
            place = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            row = f["row"].to_numpy()
            sums = [np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)]
            for total, value in zip(sums, (counted, is_best)):
                np.add.at(total, of_row[hit], times[hit] * value[place[hit]])
            done = pd.DataFrame({"row": row, "count_sum": sums[0], "n_best": sums[1]})
            open_ = pd.DataFrame({"row": row[of_row[~hit]], "pair": pairs[~hit].astype(np.int64), "times": times[~hit]})
            yield pd.concat([done.assign(pair=pd.NA, times=0), open_.assign(count_sum=0, n_best=0)])[
                ["row", "pair", "times", "count_sum", "n_best"]
            ].astype({"pair": "Int64"})

    looked = found.select("row", "pairs", "times").mapInPandas(
        look_up, "row long, pair long, times long, count_sum long, n_best long"
    )
    looked = scratch(looked, "looked-up")
    rest = looked.where("pair IS NOT NULL").join(judged.where(F.col("n") < least), "pair")
    rest = rest.select("row", (F.col("times") * F.col("n")).alias("count_sum"), (F.col("times") * F.col("best")).alias("n_best"))
    sums = looked.where("pair IS NULL").select("row", "count_sum", "n_best").union(rest)
    sums = sums.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    drop_scratch(counts)
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    return found.drop("pairs", "times").join(sums, "row").select(*kept)
