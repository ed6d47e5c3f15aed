"""Grouping of spelling variants through an index of grams of variable length.

Words that differ by one inserted, deleted or replaced letter are near.  Both ends of a
word are marked.  The gram dictionary holds the frequent grams of two to five letters:
more often than one place in 2^17 of the corpus's words, so at most 2^17 of each length,
whatever the corpus.  A word's gram at a place is the shortest one there that is not
frequent, or that cannot grow any more, so common beginnings are told apart by what
follows them.  A gram depends on its own letters alone.  Hence an edit of one letter
changes no more grams than lie over one letter; the most that do so anywhere in a word is
the word's bound.  Near words share all but that many grams of either, so in any order of
grams that holds for all words they share one of the first bound + 1 of both.  In the
order from rare to frequent, these are the lists that a word is put on; each list is
merged within a task, words of fitting lengths are compared, and pairs whose common
beginning and end leave one letter at most are kept.

A list of more than ``LONG`` words is not compared pair by pair: its words are put on the
lists of what they give with one letter left out, themselves included.  Near words share
one of these, and such a list has no more words than there are letters to put in.

Defined results: a null text has no words; a null id counts as an empty one; repeated
rows count as often as they stand there; an empty table gives an empty result; further
columns are not read.  Words may be of any length from ``LEAST`` letters up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch
from .components import bounds, whole_groups
from .tokens import spread

#: Fixed values of the word rule: letters, least length and count, how far a form leads its variant, and the planted slips.
LETTERS = "A-Za-zÀ-ÿ"
LEAST, LEAST_COUNT, LEAD, SLIP = 7, 2, 10, 31
SHORTEST, LONGEST = 2, 5  # letters of a gram
PLACES = 1 << 17
LONG = 512
#: Pairs that a task compares at once, and letters of words that are compared as rows of one table.
PAIRS, WIDTH = 1 << 19, 48


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): words of ``LEAST`` letters or more that occur ``LEAST_COUNT`` times or more."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.withColumn("h", h)
    words = runs.select(F.when(F.col("h") % SLIP == 0, without(F.col("run"), F.col("h"))).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def without(word: Column, h: Column) -> Column:
    """The word without its letter h % length (from 0)."""
    at = (h % F.length(word)).cast("int")
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


class Grams:
    """Grams at every place of a batch of words, marked at both ends; 7 bits a letter, so lengths differ in value."""

    def __init__(self, words: list[str]):
        text = "".join([f"\x01{w}\x02" for w in words])
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        # marks 1 and 2, then a-z, then the Latin-1 letters
        self.letters = np.where(points < 3, points, np.where(points < 0x80, points - 0x61 + 3, points - 0xC0 + 29))
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.of_word = np.repeat(np.arange(len(words)), self.ends - self.starts)
        self.room = self.ends[self.of_word] - np.arange(len(self.letters)) if len(words) else self.ends
        self.by_length = {1: self.letters}
        for q in range(2, LONGEST + 1):
            longer = self.by_length[q - 1] << 7
            longer[: len(longer) - q + 1] |= self.letters[q - 1 :]
            self.by_length[q] = longer

    def all(self) -> np.ndarray:
        return np.concatenate([g[self.room >= q] for q, g in self.by_length.items() if q >= SHORTEST])

    def decompose(self, dictionary: np.ndarray, counts: np.ndarray):
        """(word number, gram, count or 0, letters) of every place, and each word's bound."""
        at = np.flatnonzero(self.room >= SHORTEST)
        length = np.full(len(at), SHORTEST)
        gram = self.by_length[SHORTEST][at]
        n = _count(gram, dictionary, counts)
        for q in range(SHORTEST + 1, LONGEST + 1):
            grow = (length == q - 1) & (n > 0) & (self.room[at] >= q)
            length[grow] = q
            gram[grow] = self.by_length[q][at[grow]]
            n[grow] = _count(gram[grow], dictionary, counts)
        over = np.zeros(len(self.letters) + 1, np.int64)
        np.add.at(over, at, 1)
        np.add.at(over, at + length, -1)
        bound = np.maximum.reduceat(np.cumsum(over)[:-1], self.starts)
        return self.of_word[at], gram, n, bound


def _count(grams: np.ndarray, dictionary: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(dictionary):
        return np.zeros(len(grams), np.int64)
    place = np.minimum(np.searchsorted(dictionary, grams), len(dictionary) - 1)
    return np.where(dictionary[place] == grams, counts[place], 0)


def rarest(grams: Grams, dictionary: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, list key) of each word's bound + 1 rarest grams; equal grams of a word are told apart by their number."""
    word, gram, n, bound = grams.decompose(dictionary, counts)
    order = np.lexsort((gram, n, word))
    word, gram = word[order], gram[order]
    place = np.arange(len(word))
    new_word = np.diff(word, prepend=-1) > 0
    new_gram = new_word | (np.diff(gram, prepend=-1) != 0)
    rank = place - np.maximum.accumulate(np.where(new_word, place, 0))
    nth = place - np.maximum.accumulate(np.where(new_gram, place, 0))
    kept = rank <= bound[word]
    return word[kept], (gram[kept] << 27) + nth[kept]


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): how often each gram occurs in distinct words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                gram, n = np.unique(Grams(f["word"].tolist()).all(), return_counts=True)
                yield pd.DataFrame({"gram": gram, "n": n})

    return words.select("word").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_lists(words: DataFrame, dictionary: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(key, word, n, size): the lists that each word is put on."""
    shared = words.sparkSession.sparkContext.broadcast((dictionary, counts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                word, key = rarest(Grams(f["word"].tolist()), *shared.value)
                out = f.iloc[word]
                yield pd.DataFrame({"key": key, "word": out["word"], "n": out["n"], "size": out["word"].str.len()})

    return words.mapInPandas(run, "key long, word string, n long, size int")


def letter_lists(words: DataFrame) -> DataFrame:
    """(key, word, n, size): the lists of what a word gives with one letter left out, and of itself."""
    at = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")  # the last leaves nothing out
    left = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word")))
    rows = words.select("word", "n", at).select(F.xxhash64(left).alias("key"), "word", "n", F.length("word").alias("size"))
    return rows.distinct()


def one_edit(a: str, b: str) -> bool:
    """Whether two different words differ by one letter inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


class Rows:
    """Words as rows of letters, from the left and from the right; words longer than ``WIDTH`` are compared as they are."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        cut = [w[:WIDTH] for w in words]
        self.left = self._table(cut)
        self.right = self._table([w[::-1] for w in cut])

    @staticmethod
    def _table(words: list[str]) -> np.ndarray:
        a = np.array(words, "U")
        return a.view(np.uint32).reshape(len(a), -1).astype(np.uint8)  # letters lie below U+0100

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of different words, whose lengths differ by one at most, are one edit apart."""
        most = np.maximum(self.size[i], self.size[j])
        out = self._alike(self.left, i, j) + self._alike(self.right, i, j) >= most - 1
        for k in np.flatnonzero(most > WIDTH).tolist():
            out[k] = one_edit(self.words[i[k]], self.words[j[k]])
        return out

    @staticmethod
    def _alike(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (table[i] != table[j]).argmax(1)


def near_pairs(lists: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): near words that share a list; a before b in code-point order, maybe several times."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["key"]):
            edges = bounds(f, ["key"])
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            size = f["size"].to_numpy(np.int64)
            # in a list words stand by length: partners follow, up to the next length
            at = np.arange(len(f))
            partners = np.searchsorted((group << 32) + size, (group << 32) + size + 1, side="right") - at - 1
            words, n, rows = f["word"].tolist(), f["n"].to_numpy(), None
            for block in np.split(at, np.flatnonzero(np.diff(np.cumsum(partners) // PAIRS)) + 1):
                i = np.repeat(block, partners[block])
                j = spread(block + 1, partners[block])
                if not len(i):
                    continue
                rows = rows or Rows(words)
                good = rows.near(i, j)
                found = [(x, y) if words[x] < words[y] else (y, x) for x, y in zip(i[good].tolist(), j[good].tolist())]
                found = [(words[x], words[y], n[x], n[y]) for x, y in found]
                yield pd.DataFrame(found, columns=["a", "b", "n_a", "n_b"]).drop_duplicates()

    dealt = lists.repartition("key").sortWithinPartitions("key", "size")
    return dealt.mapInPandas(run, "a string, b string, n_a long, n_b long")


def final_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, in steps that double.

    A form occurs ``LEAD`` times as often as its variant, so paths are short and have no circles."""
    now = scratch(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = scratch(after, "forms")
        moved = after.where("moved").limit(1).count()
        drop_scratch(now)
        now = after.drop("moved")
        now._scratch_path = after._scratch_path
        if not moved:
            return now


def spelling_variants(docs: DataFrame, places: int = PLACES, long: int = LONG) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of (doc_id, text)."""
    spark = docs.sparkSession
    found = corpus_words(docs)
    found = scratch(found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"), "words")
    total = found.agg(F.sum(F.length("word") + 1).alias("t")).first()["t"] or 0
    # no more than ``places`` grams of a length can occur that often
    frequent = gram_counts(found).where(F.col("n") > max(1, total // places)).toPandas().sort_values("gram")
    lists = scratch(gram_lists(found, frequent["gram"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)), "gram-lists")
    long_keys = scratch(lists.groupBy("key").count().where(F.col("count") > long).select("key"), "long-lists")
    short = lists.join(long_keys, "key", "left_anti")
    rest = letter_lists(lists.join(long_keys, "key", "left_semi").select("word", "n").distinct())
    pairs = scratch(near_pairs(short).union(near_pairs(rest)).distinct(), "near-words")
    drop_scratch(lists)

    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    both = both.union(pairs.select("b", "a", "n_a"))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    known = found.join(near, "word", "left")
    leads = -F.col("best.m") >= LEAD * F.col("n")
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("best.other")).alias("form"),
        F.when(leads, -F.col("best.m")).alias("form_n"),
    )
    known = scratch(known, "word-forms")
    roots = final_forms(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
