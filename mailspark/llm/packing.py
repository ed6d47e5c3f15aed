"""Packing by order-preserving dynamic programming.

The documents of a task, in the table's order, form one stream of tokens, which
is cut into windows of ``length`` tokens at most.  A cut may stand at the end of
a document (free), at the end of a sentence (a small penalty) or, where neither
occurs for an eighth of a window, inside a sentence (a larger penalty).  The best
cuts minimise padding plus penalties: with f(j) the least cost of a stream cut at
j, f(j) = penalty(j) + length - j + min over i in [j - length, j) of f(i) + i,
and a monotone queue holds that minimum, so each place costs constant time.

The stream is solved in stretches of about ``STRETCH`` tokens: the windows that
are complete are written, the open end is carried into the next stretch, so a
task's memory is bounded by a stretch and one document.  A task's last window is
the only one that more tokens could have filled.  No row is shuffled.

Defined results: a null or empty text is its end token alone; a document longer
than a window is cut; repeated rows are packed as often as they stand there; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batches, giving_back
from .tokens import ByteTokens, documents_ids, loaded

LENGTH = 2048
END_ID = 1
STRETCH = 1 << 18
SENTENCE_PENALTY, INSIDE_PENALTY = 4.0, 48.0

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
)


def sentence_ends(tokens: ByteTokens) -> np.ndarray:
    """For each id: whether its bytes end a sentence or a line."""
    return np.array([b.endswith((b".", b"!", b"?", b"\n")) for b in tokens.bytes_of()])


def cut_places(ends: np.ndarray, sentence: np.ndarray, total: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending, the last is ``total``) and penalties of possible cuts; ends, sentence: places of those kinds."""
    known = np.unique(np.concatenate([ends, sentence, [total]]))
    gaps = np.diff(np.concatenate([[0], known]))
    step = max(1, length // 8)
    inside = [np.arange(known[k] - gaps[k] + step, known[k], step) for k in np.flatnonzero(gaps > step)]
    places = np.unique(np.concatenate([known, *inside])) if inside else known
    penalty = np.full(len(places), INSIDE_PENALTY)
    penalty[np.isin(places, sentence)] = SENTENCE_PENALTY
    penalty[np.isin(places, ends)] = 0.0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cuts of the least total cost; the last place is one of them."""
    at = [0, *places.tolist()]
    cost, before = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (f(i) + i, place number), least first
    for n, pen in enumerate(penalty.tolist(), 1):
        j = at[n]
        while at[queue[0][1]] < j - length:
            queue.popleft()
        value, i = queue[0]
        cost[n], before[n] = pen + length - j + value, i
        key = cost[n] + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, n))
    cuts, n = [], len(at) - 1
    while n:
        cuts.append(at[n])
        n = before[n]
    return cuts[::-1]



class Stretch:
    """Documents (or their remaining tokens) that are not yet written."""

    def __init__(self):
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, its whole length, ids before, ids
        self.tokens = 0

    def add(self, doc_id, whole: int, start: int, ids: np.ndarray) -> None:
        if len(ids):
            self.docs.append((doc_id, whole, start, ids))
            self.tokens += len(ids)


def _pieces(stretch: Stretch, sentence: np.ndarray, first: int, last: bool, length: int):
    """Rows of the complete windows, what stays open, and how many windows were written."""
    sizes = np.array([len(d[3]) for d in stretch.docs])
    ends = sizes.cumsum()
    flow = np.concatenate([d[3] for d in stretch.docs])
    # the end token closes a document; an end of sentence is a cut inside one
    inside = np.flatnonzero(sentence[np.minimum(flow, len(sentence) - 1)]) + 1
    cuts = best_cuts(*cut_places(ends, inside, len(flow), length), length)
    if not last and len(cuts) > 1:
        cuts = cuts[:-1]  # the last window could still take more
    bounds = np.array([0, *cuts])
    edges = np.unique(np.concatenate([bounds, ends[ends < bounds[-1]]]))
    rows, starts = [], ends - sizes
    doc_of = np.searchsorted(ends, edges[:-1], side="right")
    window_of = np.searchsorted(bounds, edges[:-1], side="right") - 1
    for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc_of.tolist(), window_of.tolist()):
        doc_id, whole, start, ids = stretch.docs[d]
        crc = zlib.crc32(flow[a:b].tobytes())
        rows.append((doc_id, start + a - int(starts[d]), b - a, crc, whole, first + w, a - int(bounds[w]), int(bounds[w + 1] - bounds[w])))
    rest = Stretch()
    for (doc_id, whole, start, ids), s, e in zip(stretch.docs, starts.tolist(), ends.tolist()):
        if e > bounds[-1]:
            skip = max(0, int(bounds[-1]) - s)
            rest.add(doc_id, whole, start + skip, ids[skip:])
    return rows, rest, len(cuts)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, stretch_tokens: int = STRETCH) -> DataFrame:
    """Pieces (see ``SCHEMA``) of all documents of (doc_id, text), in the table's order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = loaded(ByteTokens, tokenizer)
        sentence = sentence_ends(tokens)
        first = TaskContext.get().partitionId() << 40
        open_ = Stretch()
        for f in batches(frames, 4 << 20):
            for doc_id, ids in documents_ids(tokens, f, end_id):
                open_.add(doc_id, len(ids), 0, ids)
                if open_.tokens >= stretch_tokens:
                    rows, open_, n = _pieces(open_, sentence, first, False, length)
                    first += n
                    yield _frame(rows)
        if open_.tokens:
            yield _frame(_pieces(open_, sentence, first, True, length)[0])

    return docs.select("doc_id", "text").mapInPandas(giving_back(run), SCHEMA)


def _frame(rows) -> pd.DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out
