"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

1. Every word and every word shape (``Xx``, ``x$$$``, ``x=`` for a word that
   repeats the one before) has a fixed sparse ternary index vector.  One pass over
   all documents sums the index vectors of each unit's contexts (its neighbours and
   its shape); the sums of all tasks are added by a native, mergeable aggregate.
   Units share ``BUCKETS`` hash buckets, so the vectors have a fixed size.
2. A document is pooled as the mean of its words' vectors (frequent words weigh
   less) beside the mean of its shapes' vectors.
3. A two-layer network learns on the driver from the pooled vectors of
   ``TRAIN_ROWS`` labelled documents at most (those with the least hash); a fifth of
   them sets the temperature that calibrates the probabilities.
4. All documents are scored where they stand: no shuffle.

Ids, sources, languages and labels are no inputs of a score.  Defined results: a
null or empty text is pooled as zeros and scored like any other; repeated label
rows are averaged; without labels of both kinds the score is the share of label 1
(0.5 if there are none); a null doc_id is not held out and not learned from;
repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, giving_back

BUCKETS, DIM, NONZERO = 1 << 15, 32, 2
FEATURES = 2 * DIM + 1
TRAIN_ROWS = 8000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 128, 5e-3, 1e-4, 20240607
#: Words whose units a task remembers.
CACHE = 100_000
#: Tokens, and characters of text, that are worked on at once.
CHUNK, TEXT = 100_000, 2 << 20

_KIND = bytes(
    ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("d") if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"([xXd])\1+|(.)\2{2,}")


def shape(word: bytes) -> bytes:
    """``Hello,`` is ``Xx,``; runs of letters or digits count once, runs of other characters three times at most."""
    return _RUNS.sub(lambda m: m[1] or m[2] * 3, word.translate(_KIND))


class Units(dict):
    """Word -> bucket of the lower-case word * BUCKETS + bucket of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        w = xxhash.xxh32_intdigest(word.lower(), 1) % BUCKETS
        s = xxhash.xxh32_intdigest(shape(word), 2) % BUCKETS
        self[word] = out = w * BUCKETS + s
        return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of each bucket's index vector; the same wherever they are made."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def _units(texts, units: Units) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, documents, words' buckets, shapes' buckets, document number of each) of chunks."""
    held: list[int] = []
    counts: list[int] = []
    first = 0

    def chunk():
        code = np.array(held, np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        word, form = code // BUCKETS, code % BUCKETS
        same = np.zeros(len(code), bool)
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        form[same] = (form[same] * 40503 + 977) % BUCKETS  # the shape of a repeated word
        return first, len(counts), word, form, doc

    for t in texts:
        codes = list(map(units.__getitem__, t.encode().split())) if isinstance(t, str) else []
        held += codes
        counts.append(len(codes))
        if len(held) >= CHUNK:
            yield chunk()
            first += len(counts)
            held, counts = [], []
    if counts:
        yield chunk()


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context sums (BUCKETS x DIM) and counts of all units over all documents."""
    columns = [f"v{i}" for i in range(DIM)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, (dims, signs) = Units(), index_vectors()
        total, count = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)
        for f in batches(frames, TEXT):
            for _, _, word, form, doc in _units(f["text"], units):
                inner = doc[1:] == doc[:-1]
                a, b, s, t = word[:-1][inner], word[1:][inner], form[:-1][inner], form[1:][inner]
                for unit, context in ((a, b), (b, a), (word, form), (s, t), (t, s), (form, form)):
                    for k in range(NONZERO):
                        total += np.bincount(unit * DIM + dims[context, k], signs[context, k], BUCKETS * DIM)
                count += np.bincount(word, minlength=BUCKETS) + np.bincount(form, minlength=BUCKETS)
        seen = np.flatnonzero(count)
        out = pd.DataFrame(total.reshape(BUCKETS, DIM)[seen].astype(np.int64), columns=columns)
        out.insert(0, "n", count[seen].astype(np.int64))
        out.insert(0, "unit", seen)
        yield out

    schema = "unit long, n long, " + ", ".join(f"{c} long" for c in columns)
    # at most BUCKETS rows come to the driver, whatever the input
    rows = docs.select("text").mapInPandas(giving_back(run), schema).groupBy("unit").agg(*[F.sum(c).alias(c) for c in ["n", *columns]]).toPandas()
    sums, count = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    sums[rows["unit"]], count[rows["unit"]] = rows[columns], rows["n"]
    return sums, count


def finished(sums: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length vectors without their common direction, and pooling weights a / (a + p)."""
    v = sums / np.maximum(count, 1)[:, None]
    total = max(count.sum(), 1)
    v -= (v * count[:, None]).sum(axis=0) / total
    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    v[count == 0] = 0
    return v.astype(np.float32), (1e-3 / (1e-3 + count / total)).astype(np.float32)


def pooled(texts, units: Units, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Features (documents x FEATURES)."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for first, n, word, form, doc in _units(texts, units):
        tokens = np.bincount(doc, minlength=n)
        has = np.flatnonzero(tokens)
        if not len(has):
            continue
        starts = (tokens.cumsum() - tokens)[has]
        w = weights[word]
        out[first + has, :DIM] = np.add.reduceat(vectors[word] * w[:, None], starts) / np.add.reduceat(w, starts)[:, None]
        out[first + has, DIM : 2 * DIM] = np.add.reduceat(vectors[form], starts) / tokens[has, None]
        out[first + has, 2 * DIM] = np.log1p(tokens[has]) / 8
    return out


class Network:
    """tanh layer and a logistic output; plain numpy."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        held = order[: max(1, len(y) // 5)]
        fit = order[len(held) :] if len(y) > 4 else order
        self.p = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0]
        m, v, t = [0.0] * 4, [0.0] * 4, 0
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for at in range(0, len(fit), BATCH):
                rows = fit[at : at + BATCH]
                h = np.tanh(x[rows] @ self.p[0] + self.p[1])
                d = (_logistic(h @ self.p[2] + self.p[3]) - y[rows]) / len(rows)
                back = d[:, None] * self.p[2] * (1 - h * h)
                grads = [x[rows].T @ back + DECAY * self.p[0], back.sum(axis=0), h.T @ d + DECAY * self.p[2], d.sum()]
                t += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        logits = self._logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        self.temperature = float(min(grid, key=lambda s: _loss(logits / s, y[held])))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._logits((x - self.mean) / self.scale) / self.temperature)


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, after the columns named by ``keep``.

    labels: (doc_id, quality 0 or 1); rows of held-out ids are not learned from.
    """
    spark = docs.sparkSession
    vectors, weights = finished(*word_vectors(docs))
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    lookup = spark.sparkContext.broadcast((vectors, weights))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units()
        for f in batches(frames, TEXT):
            x = pooled(f["text"], units, *lookup.value)
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "x": list(x.astype(float))})

    # the sample has train_rows rows at most, and of rows with the same id one is kept: small enough to broadcast and to collect
    one = F.min_by(F.struct("y", "text"), F.xxhash64("text")).alias("one")
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*")
    learned = known.mapInPandas(giving_back(features), "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    y = learned["y"].to_numpy(float)
    if len(set(y)) == 2:
        model = Network(np.stack(learned["x"].to_list()), y)
    else:
        model = Constant(float(y.mean()) if len(y) else 0.5)
    network = spark.sparkContext.broadcast(model)

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = Units()
        for texts in parts:
            blocks = [network.value.score(pooled(f["text"], units, *lookup.value)) for f in batches([texts.to_frame("text")], TEXT)]
            yield pd.Series(np.concatenate([*blocks, []]))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return giving_back(scores)(parts)

    scored = docs.select(*keep, "doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that are predicted to be of label 1, with the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return score_quality(rows, labels, keep=("row",), **settings).where("predicted = 1").select("row.*")
