"""Line deduplication: a segment-partition join on edit distance.

Two lines are linked if they are equal, or if both have ``MIN_BYTES`` bytes or more
and differ in ``DISTANCE`` edits of bytes at most (insertions, deletions,
substitutions).  Classes are the components of the links; the first line of a class
(by doc_id, then place) stays.

1. A line that is cut into ``DISTANCE + 1`` segments keeps one of them through any
   such edits.  Each distinct line is written under its own segments (hashed with
   its length and the segment's number) and under the substrings at which a segment
   of a line up to ``DISTANCE`` bytes shorter can stand, given how many edits can lie
   to its left and right.
2. Lines that meet under a key are candidates if their parity signatures (one bit for
   each class of bytes) differ in ``2 * DISTANCE`` bits at most, which every pair
   within the distance does.  Keys that are frequent already inside single tasks are
   split by a part of the signature (the pigeonhole principle again), so a phrase
   that ever so many lines share does not gather in one task.  A key that is not split
   occurs fewer than ``LOCAL`` times a task, however many tasks there are, or comes after
   the ``MAX_HOT`` most frequent ones and so holds a millionth of all rows at most.  Under
   any key, rows that several tasks wrote of one line count once, and a group of over
   ``CHUNK`` rows is parted by further signature bits until none is larger that can be.
3. Only lines that are candidates have their text sent: a bitmap of fixed size
   (``FILTER_BITS``) tells most of the others apart.
4. A banded bit-parallel automaton verifies all pairs of a batch at once: for each
   number of errors one word with a bit for each diagonal of the band.
5. Connected components run as distributed jobs.

A line is a stretch between line feeds without the white space (0x20, 0x09-0x0D)
at its ends.  Defined results: lines without a word belong to no class and stay; a
null text has no lines; repeated rows repeat each other's lines; a null doc_id
comes after all others; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, giving_back, scratch
from .components import bounds, connected_components, whole_groups

DISTANCE, MIN_BYTES = 2, 20
SPACE_BYTES = b" \t\n\x0b\f\r"
#: Bits of the map of candidate lines: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
#: A key is split before its rows are sent if the tasks in which it occurs LOCAL times or more hold it HOT times; MAX_HOT keys at most.
LOCAL, HOT, MAX_HOT = 16, 256, 1_000_000
#: Distinct lines whose keys a task remembers to have written.
SEEN = 1_000_000
CHUNK, SMALL = 1024, 32
SIDE = np.int64(-(2**63))

_CLASS = np.array([1 << (b * 37 % 63) for b in range(256)], np.int64)


# -- lines and their keys -------------------------------------------------------


def lines_of(text) -> Iterator[tuple[int, bytes]]:
    """(number, line) of the lines that have a word."""
    if isinstance(text, str):
        for n, x in enumerate(text.encode().split(b"\n")):
            if x := x.strip(SPACE_BYTES):
                yield n, x


def segments(size: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of k + 1 segments of nearly equal size; the later ones are longer."""
    short, longer = divmod(size, k + 1)
    sizes = [short + (i > k - longer) for i in range(k + 1)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(k + 1)]


def key_plan(size: int, k: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, seed, is a probe) of all keys of a line of this size."""
    out = [(p, p + n, (size << 3) + i, False) for i, (p, n) in enumerate(segments(size, k))]
    for less in range(k + 1):
        for i, (p, n) in enumerate(segments(size - less, k)):
            # i edits at most to the left of segment i and k - i to the right of it, or an earlier one would be intact
            low, high = max(0, p - i, p + less - (k - i)), min(size - n, p + i, p + less + (k - i))
            out += [(s, s + n, ((size - less) << 3) + i, True) for s in range(low, high + 1)]
    return out


def signatures(lines: list[bytes]) -> np.ndarray:
    """63 parity bits of each line: whether the bytes of a class occur an odd number of times."""
    sizes = np.array([len(x) for x in lines])
    return np.bitwise_xor.reduceat(_CLASS[np.frombuffer(b"".join(lines), np.uint8)], sizes.cumsum() - sizes)


def _halves(lines: list[bytes]) -> np.ndarray:
    """128-bit hashes of lines, as two rows of numbers."""
    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), ">u8").astype(np.uint64)
    return (h ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, 2).T


def _find_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = TaskContext.get().partitionId() << 40
    for f in batches(frames):
        found = [list(lines_of(text)) for text in f["text"]]
        each = [len(x) for x in found]
        lines = [x for xs in found for _, x in xs]
        if not lines:
            continue
        a, b = _halves(lines)
        yield pd.DataFrame(
            {
                "line": np.arange(number, number + len(lines)),
                "doc_id": f["doc_id"].astype("Int64").repeat(each).array,
                "th": np.repeat(f["th"].to_numpy(np.int64), each),
                "line_no": np.array([n for xs in found for n, _ in xs], np.int32),
                "a": a,
                "b": b,
            }
        )
        number += len(lines)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), modulo 2^64."""
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return out.cumprod()


#: Substrings are hashed all at once: a number for each byte times the powers of an odd base are summed up modulo 2^64, and the
#: difference of two sums is brought down to the substring's own place.  Equal hashes make candidates only, as equal keys do.
_BASE, _BLOCK = 0x9E3779B97F4A7C15, 1 << 16
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 2**64), _BLOCK)


def _line_keys(lines: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the line, is a probe) of all keys of ``key_plan`` of each line."""
    sizes = np.array([len(x) for x in lines])
    starts = sizes.cumsum() - sizes
    text = np.frombuffer(b"".join(lines), np.uint8)
    blocks = -(-len(text) // _BLOCK) + 1
    up, down = (_powers(pow(x, _BLOCK, 2**64), blocks) for x in (_BASE, pow(_BASE, -1, 2**64)))
    sums = np.zeros(len(text) + 1, np.uint64)
    for n, at in enumerate(range(0, len(text), _BLOCK)):
        part = _BYTE[text[at : at + _BLOCK]]
        sums[at + 1 : at + 1 + len(part)] = part * _UP[: len(part)] * up[n]
    np.cumsum(sums, out=sums)
    keys, rows, probes = [], [], []
    for less in range(k + 1):
        short, longer = np.divmod(sizes - less, k + 1)
        for i in range(k + 1):
            n, p = short + (i > k - longer), i * short + np.maximum(0, i - (k + 1 - longer))
            for d in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                row = np.flatnonzero((n >= 0) & (p + d >= 0) & (p + d + n <= sizes))
                at = (starts + p + d)[row]
                h = (sums[at + n[row]] - sums[at]) * _DOWN[at % _BLOCK] * down[at // _BLOCK]
                key = _mixed(h.view(np.int64), ((sizes[row] - less) << 3) + i)
                for probe in (False, True) if less == d == 0 else (True,):
                    keys.append(key)
                    rows.append(row)
                    probes.append(np.full(len(row), probe))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(probes)


def _keys(frames: Iterator[pd.DataFrame], k: int, min_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, line hash, signature with the side as its top bit) of the distinct lines of batches."""
    seen: set[bytes] = set()
    digest = xxhash.xxh3_128_digest
    for f in batches(frames, 4 << 20):
        lines = []
        for text in f["text"]:
            for _, x in lines_of(text):
                if len(x) < min_bytes or (h := digest(x)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h)
                lines.append(x)
        if lines:
            key, row, probe = _line_keys(lines, k)
            sig = signatures(lines)[row]
            yield key, _halves(lines)[0][row], np.where(probe, sig | SIDE, sig)


def _frequent(k: int, min_bytes: int, local: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for key, _, _ in _keys(frames, k, min_bytes):
            parts.append(np.unique(key, return_counts=True))
            if sum(len(p[0]) for p in parts) > 4_000_000:
                parts = [_summed(parts)]
                if len(parts[0][0]) > 2_000_000:
                    yield _counts(parts[0], local)
                    parts = []
        if parts:
            yield _counts(_summed(parts), local)

    return run


def _summed(parts):
    key, n = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(key)
    key, n = key[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _counts(part, local: int) -> pd.DataFrame:
    return pd.DataFrame({"key": part[0], "n": part[1]})[part[1] >= local]


def signature_parts(k: int) -> list[tuple[int, int]]:
    """(shift, mask) of 2k + 1 parts of a signature: one of them is equal if 2k bits at most differ."""
    return [(p, (1 << n) - 1) for p, n in segments(63, 2 * k)]


def _mixed(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = key.view(np.uint64) ^ (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(27))).view(np.int64)


def _keyed(k: int, min_bytes: int, hot):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = hot.value
        for key, line, sig in _keys(frames, k, min_bytes):
            split = np.isin(key, often) if len(often) else np.zeros(len(key), bool)
            yield pd.DataFrame({"key": key[~split], "a": line[~split], "sig": sig[~split]})
            if split.any():
                key, line, sig = key[split], line[split], sig[split]
                for n, (shift, mask) in enumerate(signature_parts(k)):
                    part = ((sig >> shift) & mask) * 16 + n + 1
                    yield pd.DataFrame({"key": _mixed(key, part), "a": line, "sig": sig})

    return run


# -- candidates -------------------------------------------------------------------


def _close(sig: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """An own segment meets a probe, and the signatures allow it."""
    differ = (sig ^ other).view(np.uint64)
    return (differ >> np.uint64(63) == 1) & (np.bitwise_count(differ & np.uint64(2**63 - 1)) <= 2 * k)


def _once(a: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a group: each task that holds a line writes its keys."""
    by = np.lexsort((sig, a))
    a, sig = a[by], sig[by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (sig[1:] != sig[:-1])])
    return a[new], sig[new]


def parted(a: np.ndarray, sig: np.ndarray, k: int, most: int = CHUNK, free: np.ndarray | None = None):
    """Parts of a group such that two rows whose signatures differ in 2k bits at most lie in one of them together.

    Of 2k + 1 stretches of the ``free`` bits (all at first) one is equal then, so a group of over ``most`` rows is
    cut by each stretch in turn, and a part that is still large by the bits that are left."""
    free = np.arange(63) if free is None else free
    if (sig < 0).all() or (sig >= 0).all():
        return  # own segments meet probes only
    if len(a) <= most or len(free) <= 2 * k:
        yield a, sig
        return
    for p, n in segments(len(free), 2 * k):
        bits = sig & np.bitwise_or.reduce(np.int64(1) << free[p : p + n])
        by = np.argsort(bits, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(bits[by]) != 0, [True]]))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            if y - x > 1:
                yield from parted(a[by[x:y]], sig[by[x:y]], k, most, np.delete(free, np.s_[p : p + n]))


def _meet(k: int):
    def pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pd.DataFrame({"a1": p[:, 0], "a2": p[:, 1]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["key"]):
            a, sig, at = f["a"].to_numpy(np.int64), f["sig"].to_numpy(np.int64), bounds(f, ["key"])
            sizes = np.diff(at)
            # most groups are one line that meets itself
            several = np.minimum.reduceat(a, at[:-1]) != np.maximum.reduceat(a, at[:-1])
            small = several & (sizes <= SMALL)
            rows = np.flatnonzero(np.repeat(small, sizes))
            group, own, s = np.repeat(np.arange(len(sizes)), sizes)[rows], a[rows], sig[rows]
            for d in range(1, SMALL):
                i = np.flatnonzero(group[:-d] == group[d:])
                if not len(i):
                    break
                i = i[(own[i] != own[i + d]) & _close(s[i], s[i + d], k)]
                if len(i):
                    yield pairs(own[i], own[i + d])
            for g in np.flatnonzero(several & (sizes > SMALL)):
                for own, s in parted(*_once(a[at[g] : at[g + 1]], sig[at[g] : at[g + 1]]), k):
                    mine, theirs = np.flatnonzero(s >= 0), np.flatnonzero(s < 0)  # own segments, probes
                    for x in range(0, len(mine), CHUNK):
                        for y in range(0, len(theirs), CHUNK):
                            m, t = mine[x : x + CHUNK], theirs[y : y + CHUNK]
                            i, j = np.nonzero(_close(s[m][:, None], s[t][None, :], k) & (own[m][:, None] != own[t][None, :]))
                            if len(i):
                                yield pairs(own[m][i], own[t][j])

    return run


# -- verification -------------------------------------------------------------------


def within(x: list[bytes], y: list[bytes], k: int) -> np.ndarray:
    """Whether each pair's edit distance is k at most.

    State e of a pair is a word whose bit d + k is set if, after j bytes of y, j + d bytes of x can
    be reached with e errors at most.  A byte of y keeps the diagonals on which it matches; an error
    either substitutes (same diagonal), inserts (one lower) or deletes (one higher)."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    out = np.zeros(len(x), bool)
    order = np.argsort(ny, kind="stable")
    order = order[np.abs(nx - ny)[order] <= k]
    for at in range(0, len(order), 512):
        rows = order[at : at + 512]
        width = int(max(nx[rows].max(), ny[rows].max()))
        left = np.full((len(rows), width + 2 * k + 1), 256, np.int16)  # k places before and behind match nothing
        right = np.full((len(rows), width), 257, np.int16)
        for n, r in enumerate(rows.tolist()):
            left[n, k : k + nx[r]] = np.frombuffer(x[r], np.uint8)
            right[n, : ny[r]] = np.frombuffer(y[r], np.uint8)
        left, right = left.T.copy(), right.T.copy()
        full = (1 << (2 * k + 1)) - 1
        state = [np.full(len(rows), ((1 << (e + 1)) - 1) << k, np.int64) for e in range(k + 1)]
        last = ny[rows]
        done = np.zeros(len(rows), bool)
        for j in range(int(last.max())):
            match = np.zeros(len(rows), np.int64)
            for d in range(2 * k + 1):
                match |= (left[j + d] == right[j]).astype(np.int64) << d
            new = [state[0] & match]
            for e in range(1, k + 1):
                new.append(((state[e] & match) | state[e - 1] | (state[e - 1] >> 1) | (new[e - 1] << 1)) & full)
            state = new
            if (end := last == j + 1).any():
                done |= end & ((state[k] >> (nx[rows] - ny[rows] + k)) & 1).astype(bool)
            if j % 32 == 31 and not state[k][last > j + 1].any():
                break  # all others are beyond the distance
        out[rows] = done
    return out


def _verify(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, 4 << 20, "text1"):
            ok = within([bytes(x) for x in f["text1"]], [bytes(x) for x in f["text2"]], k)
            yield f.loc[ok, ["a", "b"]]

    return run


def _texts_of(filter_bits: int, k: int, min_bytes: int, wanted):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        bits = wanted.value
        for f in batches(frames):
            lines = [x for text in f["text"] for _, x in lines_of(text) if len(x) >= min_bytes]
            if not lines:
                continue
            a, b = _halves(lines)
            p = a % filter_bits
            hit = np.flatnonzero(bits[p >> 3] >> (p & 7) & 1)
            rows = []
            for i, x, y in zip(hit.tolist(), a[hit].tolist(), b[hit].tolist()):
                if y not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(y)
                    rows.append((x, y, lines[i]))
            yield pd.DataFrame(rows, columns=["a", "b", "text"])

    return run


def _bitmap(values: DataFrame, size: int) -> np.ndarray:
    """A map of ``size`` bits in which those of a column v are set; comes to the driver as size / 8 bytes at most."""
    p = F.pmod("v", F.lit(size)) + 1  # Spark counts positions from 1 on
    rows = values.groupBy(F.bitmap_bucket_number(p).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits"))
    out = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["n"] - 1) * 4096
        out[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


# -- the job ------------------------------------------------------------------------


def line_classes(docs: DataFrame, k: int = DISTANCE, min_bytes: int = MIN_BYTES, hot: int = HOT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, th, line_no, class_doc_id, class_line_no, kept) of every line with a word of (doc_id, text).

    th: hash of the row's id and text, for joining back.
    """
    spark = docs.sparkSession
    text = docs.select("text")
    lines = scratch(
        docs.select("doc_id", F.xxhash64("doc_id", "text").alias("th"), "text").mapInPandas(
            _find_lines, "line long, doc_id long, th long, line_no int, a long, b long"
        ),
        "lines",
    )
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line", "line_no")
    distinct = scratch(
        lines.groupBy("a", "b").agg(F.min("line").alias("node"), F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-lines"
    )
    frequent = (
        text.mapInPandas(giving_back(_frequent(k, min_bytes, min(LOCAL, hot))), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= hot)
    )
    keys = np.sort(frequent.orderBy(F.desc("n")).limit(MAX_HOT).select("key").toPandas()["key"].to_numpy(np.int64))
    keyed = text.mapInPandas(giving_back(_keyed(k, min_bytes, spark.sparkContext.broadcast(keys))), "key long, a long, sig long")
    candidates = scratch(
        keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_meet(k), "a1 long, a2 long").distinct(), "line-candidates"
    )
    wanted = _bitmap(candidates.select(F.col("a1").alias("v")).union(candidates.select("a2")), filter_bits)
    held = spark.sparkContext.broadcast(wanted)
    texts = text.mapInPandas(giving_back(_texts_of(filter_bits, k, min_bytes, held)), "a long, b long, text binary").dropDuplicates(["a", "b"])
    texts = scratch(texts.join(distinct.select("a", "b", "node"), ["a", "b"]).select("a", "node", "text"), "candidate-lines")
    pairs = (
        candidates.join(texts.toDF("a1", "a", "text1"), "a1")
        .join(texts.toDF("a2", "b", "text2"), "a2")
        .select("a", "text1", "b", "text2")
    )
    links = scratch(pairs.mapInPandas(_verify(k), "a long, b long"), "line-links")
    component = connected_components(links).withColumnRenamed("component", "class")
    classed = distinct.join(component, "node", "left").withColumn("class", F.coalesce("class", "node")).select("a", "b", "class", "first")
    first = classed.groupBy("class").agg(F.min("first").alias("top"))
    of_line = classed.select("a", "b", "class").join(first, "class").select("a", "b", "top")
    return lines.join(of_line, ["a", "b"]).select(
        "doc_id",
        "th",
        "line_no",
        F.col("top.doc_id").alias("class_doc_id"),
        F.col("top.line_no").alias("class_line_no"),
        (F.col("line") == F.col("top.line")).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """The documents with later lines of each class removed, with the columns of ``docs``.

    Lines without a word stay.  A document all of whose lines are repeats goes, as do rows that
    repeat an id and text; a document that had no line with a word stays as it is.
    """
    gone = (
        line_classes(docs, **settings)
        .groupBy("doc_id", "th", "line_no")
        .agg(F.max("kept").alias("kept"))
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias("gone"), F.max("kept").alias("some"))
        .select("th", F.col("doc_id").alias("_d"), "gone", "some")
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("_th"))
    rows = rows.dropDuplicates(["_th", "doc_id"])  # each task keeps one of its copies before any is sent
    joined = rows.join(gone, (F.col("_th") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").where("some is null or some")
    some_gone = F.size(F.coalesce("gone", F.array().cast("array<int>"))) > 0
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(some_gone, left).otherwise(F.col("row.text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
