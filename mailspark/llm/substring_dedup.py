"""Exact substring deduplication by blockwise suffix sorting with a difference cover.

Every byte covered by a ``LENGTH``-byte string (a window) that also starts anywhere
else in the corpus is removed.  Sorting all suffixes of a corpus in one order is no
job for a cluster; windows that are equal only have to meet.  So:

1. Each window belongs to the bucket of its least hashed ``GRAM``-byte gram
   (leftmost of equals).  Equal windows have the same bucket, and the neighbouring
   windows of one bucket travel as one row, a run; a text has about one run for
   each 85 bytes.
2. Runs whose bucket occurs once in the corpus cannot repeat and go no further.
   Equal runs (by content hash within their bucket) repeat as a whole, so they are
   marked without sorting, and one of them stands for all.
3. Buckets with different runs are sorted, a block of whole buckets at a time.
   Suffixes are ordered by their first 8 bytes; long ties are resolved by ranks of
   the places that a difference cover modulo 7 selects (3 of 7), which were sorted
   beforehand to a depth beyond the window.  Any two suffixes reach two covered
   places by a common step of 6 bytes at most, so merging the 7 residue classes
   takes comparisons of ranks only.  Neighbours in the order that agree in
   ``LENGTH`` bytes are repeats.  A task holds one block.
4. A bucket with more than ``VARIANTS`` different runs (a very frequent phrase in
   ever new surroundings) is compared window by window by 128-bit hashes in a
   native aggregate instead, so that no task holds it.
5. The marks go back to their texts, which are read whole and cut once.

Equal texts are one text in steps 1 to 4, known by two 64-bit hashes (``d``, ``th``),
so copies add neither runs nor marks; a text that several rows have is marked whole.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes keep
every byte; repeated rows are repeats of each other; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_scratch, scratch, text_or_empty
from .components import bounds, whole_groups

LENGTH, GRAM = 200, 32
#: Windows of a text that are hashed at once, and bytes of one batch.
SEGMENT, BATCH = 1 << 19, 1 << 20
#: Bytes of a sorting block, and most runs of a bucket that is sorted.
BLOCK, VARIANTS = 2 << 20, 4096
#: A difference cover modulo 7: every residue is a difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)

RUNS = "bucket long, content long, d long, th long, start long, windows int"


# -- runs ---------------------------------------------------------------------


class Hasher:
    """Rolling hashes of all grams of a byte array: differences of a prefix sum, scaled back by inverse powers."""

    def __init__(self, size: int):
        base = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
        self.up = self._powers(base, size)
        self.down = self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def __call__(self, t: np.ndarray, gram: int) -> np.ndarray:
        total = np.zeros(len(t) + 1, np.uint64)
        np.cumsum((t.astype(np.uint64) + np.uint64(1)) * self.up[: len(t)], out=total[1:], dtype=np.uint64)
        h = (total[gram:] - total[:-gram]) * self.down[: len(t) - gram + 1]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def least_of_each(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def runs_of(pieces: list[bytes], hasher: Hasher, length: int = LENGTH, gram: int = GRAM):
    """(piece number, start, windows, bucket) of all runs of the pieces."""
    t = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = sizes.cumsum()
    h = hasher(t, gram)
    low = np.uint64((1 << 21) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    least = least_of_each((h & ~low) | place, length - gram + 1)
    anchor = (least & low).astype(np.int64)
    ok = np.ones(len(anchor), bool)
    for e in ends[:-1].tolist():
        ok[max(0, e - length + 1) : e] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    first = np.flatnonzero(np.concatenate([[True], anchor[at[1:]] != anchor[at[:-1]]]))
    start = at[first]
    piece = np.searchsorted(ends, start, side="right")
    return piece, start - (ends - sizes)[piece], np.diff(np.append(first, len(at))), h[anchor[start]]


def _find_runs(length: int, gram: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(2 * SEGMENT + BATCH)

        def found(pieces, owners):
            piece, start, windows, bucket = runs_of(pieces, hasher, length, gram)
            content = [
                xxhash.xxh3_64_intdigest(memoryview(pieces[p])[s : s + w + length - 1])
                for p, s, w in zip(piece.tolist(), start.tolist(), windows.tolist())
            ]
            own = np.array(owners, np.int64).reshape(-1, 3)[piece]
            return pd.DataFrame(
                {
                    "bucket": bucket.view(np.int64),
                    "content": np.array(content, np.uint64).view(np.int64),
                    "d": own[:, 0],
                    "th": own[:, 1],
                    "start": own[:, 2] + start,
                    "windows": windows.astype(np.int32),
                }
            )

        for f in _texts(frames):
            pieces, owners, held = [], [], 0
            for d, th, text in zip(f["d"].tolist(), f["th"].tolist(), f["text"]):
                raw = text.encode()
                for at in range(0, len(raw) - length + 1, SEGMENT):
                    pieces.append(raw[at : at + SEGMENT + length - 1])
                    owners.append((d, th, at))
                    held += len(pieces[-1])
                    if held >= BATCH:
                        yield found(pieces, owners)
                        pieces, owners, held = [], [], 0
            if pieces:
                yield found(pieces, owners)

    return run


# -- sorting ------------------------------------------------------------------


def cover_steps() -> np.ndarray:
    """step[r, s]: the least step that takes places of residues r and s both into the cover."""
    return np.array(
        [
            [next(x for x in range(PERIOD) if (r + x) % PERIOD in COVER and (s + x) % PERIOD in COVER) for s in range(PERIOD)]
            for r in range(PERIOD)
        ]
    )


STEPS = cover_steps()


def words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, in byte order (t has 8 bytes more than places)."""
    out = np.zeros(len(t) - 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | t[k : k + len(out)]
    return out


def dense(x: np.ndarray) -> np.ndarray:
    """Rank of each element among the distinct ones."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def cover_ranks(word: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at the covered places (-1 elsewhere).  Steps are multiples of the period, so
    doubling stays inside the cover; it ends as soon as all suffixes are told apart."""
    places = np.flatnonzero(np.isin(np.arange(len(word)) % PERIOD, COVER))
    rank = np.full(len(word), -1, np.int64)
    rank[places] = own = dense(word[places])
    step = PERIOD
    while own.max(initial=-1) < len(places) - 1:
        further = places + step
        left = len(word) - places  # a suffix that ends before the step comes first, the shorter the earlier
        after = np.where(left > step, rank[np.minimum(further, len(word) - 1)] + step + 1, left)
        rank[places] = own = dense((own << 32) | after)
        step *= 2
    return rank


def sorted_suffixes(word: np.ndarray, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``places`` in the order of their suffixes: first 8 bytes, then cover ranks, residue classes merged by counting."""
    head = dense(word[places])
    classes = []
    for r in range(PERIOD):
        own = np.flatnonzero(places % PERIOD == r)
        own = own[np.argsort((head[own] << 32) | rank[places[own] + STEPS[r, r]], kind="stable")]
        classes.append(own)
    order = np.empty(len(places), np.int64)
    for r, own in enumerate(classes):
        index = np.arange(len(own))
        for s, other in enumerate(classes):
            if s != r and len(own) and len(other):
                step = STEPS[r, s]
                mine = (head[own] << 32) | rank[places[own] + step]
                theirs = (head[other] << 32) | rank[places[other] + step]
                index = index + np.searchsorted(theirs, mine, side="right" if s < r else "left")
        order[index] = places[own]
    return order


def repeated_windows(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content, which of its windows also start anywhere else in the contents."""
    sizes = np.array([len(c) for c in contents], np.int64)
    base = sizes.cumsum() - sizes
    t = np.frombuffer(b"".join(contents) + bytes(length + 64), np.uint8)
    word = words_at(t)
    count = np.maximum(sizes - length + 1, 0)
    places = np.repeat(base - (count.cumsum() - count), count) + np.arange(count.sum())
    repeated = np.zeros(len(word), bool)
    # only places whose first 8 bytes are not unique can repeat
    _, place, times = np.unique(word[places], return_inverse=True, return_counts=True)
    tied = places[times[place] > 1]
    if len(tied):
        order = sorted_suffixes(word, tied, cover_ranks(word))
        a, b = order[:-1], order[1:]
        same = np.arange(len(a))
        for at in [*range(0, length - 7, 8), length - 8]:
            same = same[word[a[same] + at] == word[b[same] + at]]
        repeated[a[same]] = repeated[b[same]] = True
    return [repeated[s : s + n] for s, n in zip(base.tolist(), count.tolist())]


def _sort_blocks(length: int, block: int):
    def solved(f: pd.DataFrame) -> pd.DataFrame:
        rows = []
        flags = repeated_windows(f["bytes"].tolist(), length)
        for d, th, start, settled, flag in zip(f["d"].tolist(), f["th"].tolist(), f["start"].tolist(), f["settled"].tolist(), flags):
            if not settled:  # runs that occur twice as a whole are marked already
                edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
                rows += [(d, th, start + a, b - a + length - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return pd.DataFrame(rows, columns=["d", "th", "at", "size"], dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["bucket"]):
            at = bounds(f, ["bucket"])
            total = np.concatenate([[0], f["bytes"].str.len().to_numpy().cumsum()])[at]
            number = total[:-1] // block  # whole buckets, about ``block`` bytes together
            cut = at[np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi - lo > 1:
                    yield solved(f.iloc[lo:hi])

    return run


# -- the job ------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, th, doc_id, text): two hashes that stand for the text in the tables of runs and marks."""
    text = text_or_empty()
    return docs.select(
        F.xxhash64(text).alias("d"), F.xxhash64(F.lit("text"), text).alias("th"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")
    )


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches without the copies inside them."""
    return (f.drop_duplicates(["d", "th"]) for f in batches(frames))


def _slices(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _texts(frames):
            rows = []
            for d, th, text, wanted in zip(f["d"].tolist(), f["th"].tolist(), f["text"], f["wanted"]):
                raw = text.encode()
                rows += [
                    (x["bucket"], d, th, x["start"], x["settled"], x["large"], raw[x["start"] : x["start"] + x["windows"] + length - 1])
                    for x in wanted
                ]
            yield pd.DataFrame(rows, columns=["bucket", "d", "th", "start", "settled", "large", "bytes"])

    return run


def _windows(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, th, start, settled, raw in zip(f["d"].tolist(), f["th"].tolist(), f["start"].tolist(), f["settled"].tolist(), f["bytes"]):
                view = memoryview(bytes(raw))
                n = len(view) - length + 1
                h = b"".join(xxhash.xxh3_128_digest(view[k : k + length]) for k in range(n))
                h = np.frombuffer(h, ">i8").reshape(-1, 2).astype(np.int64)
                yield pd.DataFrame(
                    {"w1": h[:, 0], "w2": h[:, 1], "d": d, "th": th, "at": np.arange(start, start + n), "settled": settled}
                )

    return run


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, variants: int = VARIANTS, block: int = BLOCK) -> DataFrame:
    """(d, th, at, size): stretches of bytes to remove; they may overlap."""
    keyed = _keyed(docs)
    n_bytes = F.octet_length("text").cast("long")
    texts = keyed.where(n_bytes >= length).groupBy("d", "th", n_bytes.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    copied = texts.where("n > 1").select("d", "th", F.lit(0).cast("long").alias("at"), "size")
    found = keyed.where(n_bytes >= length).select("d", "th", "text").mapInPandas(_find_runs(length, gram), RUNS)
    runs = scratch(found.distinct(), "runs")  # copies in other batches
    # tables of their own, so that adaptive execution can split a frequent bucket's side of the joins
    often = scratch(runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "met-buckets")
    met = scratch(runs.join(often, "bucket", "left_semi"), "met-runs")
    drop_scratch(runs)
    drop_scratch(often)
    kinds = scratch(
        met.groupBy("bucket", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "th", "start", "windows")).alias("one")
        ),
        "run-kinds",
    )
    whole = met.join(kinds.where("n > 1").select("bucket", "content"), ["bucket", "content"], "left_semi")
    whole = whole.select("d", "th", F.col("start").alias("at"), (F.col("windows") + (length - 1)).cast("long").alias("size"))
    several = scratch(kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "sorted-buckets")
    wanted = (
        kinds.join(several, "bucket")
        .select("one.*", F.struct("bucket", "one.start", "one.windows", (F.col("n") > 1).alias("settled"), (F.col("kinds") > variants).alias("large")).alias("x"))
        .groupBy("d", "th")
        .agg(F.collect_list("x").alias("wanted"))  # runs of one text
    )
    slices = "bucket long, d long, th long, start long, settled boolean, large boolean, bytes binary"
    sliced = scratch(
        keyed.select("d", "th", "text")
        .join(wanted, ["d", "th"])
        .mapInPandas(_slices(length), slices)
        .distinct(),
        "slices",
    )
    from_blocks = (
        sliced.where("not large")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(_sort_blocks(length, block), "d long, th long, at long, size long")
    )
    windows = sliced.where("large").mapInPandas(_windows(length), "w1 long, w2 long, d long, th long, at long, settled boolean")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    from_windows = windows.where("not settled").join(twice, ["w1", "w2"], "left_semi")
    from_windows = from_windows.select("d", "th", "at", F.lit(length).cast("long").alias("size"))
    return copied.unionByName(whole).unionByName(from_blocks).unionByName(from_windows)


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches(frames):
        rows = []
        for doc_id, text, at, size in zip(f["doc_id"].astype("Int64"), f["text"], f["at"], f["size"]):
            raw = text.encode()
            starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if at is not None and len(at):
                edge = np.zeros(len(raw) + 1, np.int64)
                at, size = np.asarray(at, np.int64), np.asarray(size, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                covered = edge.cumsum()[:-1] > 0
                change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                starts, ends = change[::2], change[1::2]
            kept = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)]))
            rows.append((doc_id, len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept, starts, ends))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, variants: int = VARIANTS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, starts, ends) of every row of (doc_id, text)."""
    of_text = marks(docs, length, gram, variants, block).groupBy("d", "th").agg(F.collect_list(F.struct("at", "size")).alias("m"))
    joined = _keyed(docs).join(of_text, ["d", "th"], "left").select("doc_id", "text", "m.at", "m.size")
    return joined.mapInPandas(
        _cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>",
    )
