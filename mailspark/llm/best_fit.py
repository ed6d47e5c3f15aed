"""Best-fit packing with large items matched first.

Documents are pieces of ``capacity`` tokens at most; only a longer document is cut,
its first piece taking what is left over.  A sequence holds at most two pieces of more
than a third of the capacity: these are matched greedily, each, from the longest down,
with the longest other one that fits beside it.  The smaller pieces follow, from the
longest down, each into the fullest sequence that still has room; a new one is opened
only where none has.

Lengths are whole numbers up to the capacity, so equal lengths are interchangeable and
the packing depends on the number of pieces of every length alone.  The plan is made
from that table (``capacity`` rows, however many documents): whole runs of equal
sequences are matched and filled at once.  It is a list of segments: pieces of one
length, by their running number, go to consecutive sequences.  Running numbers come
from a count per task and length, so equal lengths, a third of all rows perhaps, are
never gathered, and each piece finds its place by a binary search among the segments.

Defined results: a null or empty text is its end token alone; repeated rows and rows
without an id are packed as often as they stand there; an empty table gives an empty
result; further columns are not read.  Sequences are numbered from 0; within one,
pieces lie without gaps from offset 0.  Which of several pieces of one length takes
which place follows the order in which tasks read them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, giving_back, scratch
from .tokens import ByteTokens, documents_ids, loaded

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, th int, nth long"


class Plan:
    """Segments (length, first number, count, first sequence, pieces a sequence, offset) of a packing."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        #: room left -> runs (first sequence, how many) of sequences with that room
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []  # rooms that have runs, ascending
        self._match_large()
        self._fit_small()

    def _put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.segments.append((length, self.used[length], count, first, each, offset))
        self.used[length] += count
        self.left[length] -= count

    def _open(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def _room(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.runs:
                self.runs[room] = []
                insort(self.rooms, room)
            self.runs[room].append((first, n))

    def _match_large(self) -> None:
        large = sorted(s for s, n in self.left.items() if n and 3 * s > self.capacity)
        while large:
            x = large[-1]
            # the longest that fits beside x: of x's own length if there are two of it
            at = bisect_left(large, min(x, self.capacity - x) + 1) - 1
            if at >= 0 and large[at] == x and self.left[x] == 1:
                at -= 1
            n = self.left[x]
            if at < 0:
                first = self._open(n)
                self._put(x, n, first, 1, 0)
                self._room(self.capacity - x, first, n)
            elif (y := large[at]) == x:
                n //= 2
                first = self._open(n)
                self._put(x, 2 * n, first, 2, 0)
                self._room(self.capacity - 2 * x, first, n)
            else:
                n = min(n, self.left[y])
                first = self._open(n)
                self._put(x, n, first, 1, 0)
                self._put(y, n, first, 1, x)
                self._room(self.capacity - x - y, first, n)
                if not self.left[y]:
                    large.pop(at)
            if not self.left[x]:
                large.pop()

    def _fit_small(self) -> None:
        for s in sorted((s for s, n in self.left.items() if n and 3 * s <= self.capacity), reverse=True):
            while n := self.left[s]:
                at = bisect_left(self.rooms, s)
                if at == len(self.rooms):
                    per = self.capacity // s
                    self._room(self.capacity, self._open(-(-n // per)), -(-n // per))
                    continue
                room = self.rooms[at]
                first, many = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room]
                    self.rooms.pop(at)
                per = min(room // s, n)  # the fullest that fits takes pieces until none fits
                many_now = min(many, n // per)
                self._put(s, many_now * per, first, per, self.capacity - room)
                self._room(room, first + many_now, many - many_now)
                self._room(room - per * s, first, many_now)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending keys (length, first number) of the segments, and the segments in that order."""
        rows = np.array(sorted(self.segments), np.int64).reshape(-1, 6)
        return (rows[:, 0] << 40) + rows[:, 1], rows


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pack_best_fit(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents of (doc_id, text);
    with ``with_ids`` also the pieces' ids as little-endian unsigned 32-bit numbers (see ``sequences``)."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, task = loaded(ByteTokens, tokenizer), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for f in batches(frames, 4 << 20):
            rows = []
            for doc_id, ids in documents_ids(tokens, f, end_id):
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + length].tobytes()
                    rows.append((doc_id, k, start, length, zlib.crc32(raw), raw if with_ids else None, task, int(met[length])))
                    met[length] += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    found = scratch(docs.select("doc_id", "text").mapInPandas(giving_back(pieces), PIECES), "best-fit-pieces")
    counts = scratch(found.groupBy("length", "th").agg(F.count(F.lit(1)).alias("n")), "best-fit-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    keys, segments = Plan(totals, capacity).tables()

    by_task = Window.partitionBy("length").orderBy("th").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "th", F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("before"))
    numbered = found.join(before, ["length", "th"]).withColumn("number", F.col("before") + F.col("nth"))

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            number = f.pop("number").to_numpy()
            at = np.searchsorted(keys, (f["length"].to_numpy() << 40) + number, side="right") - 1
            length, start, _, first, each, offset = segments[at].T
            f["sequence_id"] = first + (number - start) // each
            f["offset"] = offset + (number - start) % each * length
            yield f

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = dict(found.dtypes) | {"piece": "int", "sequence_id": "long", "offset": "long"}
    schema = ", ".join(f"{c} {types[c]}" for c in [*kept, "sequence_id", "offset"])
    return numbered.select(*kept, "number").mapInPandas(places, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids, starts): the packed sequences themselves, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))  # a capacity of tokens at most
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select(
            "sequence_id",
            "n_tokens",
            F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
            F.col("parts.doc_id").alias("doc_ids"),
            F.col("parts.start").alias("starts"),
        )
    )
