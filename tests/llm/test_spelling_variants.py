import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs
from mailspark.llm import spelling_variants as sv
from pyspark.sql import functions as F


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_near(a, b):
    """One step of the usual table of edit distances, whole."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] == 1


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and plain_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, words[w], len(near[w]), form[w], words.get(form[w]), root


def family(rng, letters="abcdeé", n=14):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(n)]
    out = []
    for w in base:
        out += [w] * rng.choice([2, 30, 400])
        for _ in range(6):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            out += [v] * rng.choice([1, 2, 3, 40])
    return out


def result(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("places, long", [(1 << 17, 512), (60, 512), (8, 3), (1, 2)])
def test_variants_by_brute_force(spark, places, long):
    rng = random.Random(places)
    rows = [(i, " ".join(rng.choice([w, w.upper(), w.title()]) for w in family(rng))) for i in range(8)]
    rows += [(None, "Understanding understanding Understanding"), (50, "banananana " * 3 + "bananananana " * 40 + "aaaaaaaaa " * 2 + "aaaaaaaaaa " * 30)]
    rows += [(51, "x" * 3000 + " " + "x" * 3001 + " " + "ÀÉÿ×÷öü " * 3), (52, None), (53, "")]
    rows += [(54, "x" * 3000 + " " + "x" * 3001 + " ÀÉÿ×÷öüé ")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(sv.spelling_variants(docs, places, long)) == sorted(plain_variants(rows))


def test_chains_of_forms(spark):
    words = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji"]
    text = " ".join(w for k, w in enumerate(words) for _ in range([2, 30, 500, 9000][k]))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r["word"]: r for r in sv.spelling_variants(docs).collect()}
    assert got["abcdefgh"]["root"] in ("abcdekji", "abcdefgh") and result(sv.spelling_variants(docs)) == sorted(plain_variants([(1, text)]))


def test_near_words_share_a_list():
    rng = random.Random(5)
    words = sorted({w for _ in range(20) for w in family(rng, "abc")})
    words = [w for w in words if len(w) >= 7]
    for limit in (0, 3, 30):
        grams = sv.Grams(words)
        dictionary, counts = np.unique(grams.all(), return_counts=True)
        frequent = counts > limit
        word, key = sv.rarest(grams, dictionary[frequent], counts[frequent])
        lists = [set(key[word == k].tolist()) for k in range(len(words))]
        for i in range(0, len(words), 5):
            for j in range(len(words)):
                if plain_near(words[i], words[j]):
                    assert lists[i] & lists[j], (words[i], words[j])


def test_one_edit():
    rng = random.Random(3)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(2))
        if a != b:
            rows = sv.Rows([a, b])
            assert sv.one_edit(a, b) == plain_near(a, b)
            if abs(len(a) - len(b)) <= 1:
                assert rows.near(np.array([0]), np.array([1]))[0] == plain_near(a, b)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward_docs(spark, extra=True)
    assert result(sv.spelling_variants(docs)) == sorted(plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert sv.spelling_variants(empty_docs(spark)).count() == 0


def test_a_word_family_of_thousands(spark):
    """Words that all share their rarest grams: lists are split, none is compared pair by pair."""
    docs = spark.range(4000).select("id", F.concat(F.lit("zzzzzzqqqqqq"), F.translate(F.lpad(F.col("id").cast("string"), 4, "0"), "0123456789", "abcdefghij")).alias("w"))
    docs = docs.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "w", "w", "w", "w").alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = plain_words(rows)
    got = sv.spelling_variants(docs, long=64).toPandas().set_index("word")
    assert set(got.index) == set(words)
    for w in list(words)[::400]:
        assert got.loc[w, "n_near"] == sum(abs(len(v) - len(w)) <= 1 and plain_near(w, v) for v in words)
