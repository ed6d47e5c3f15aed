import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs, text_of
from mailspark.llm.lm_scoring import END, WIDTH, Trie, crc_mod, grams, score_documents
from mailspark.llm.mixing import _numbered, flight, mix, take, targets
from mailspark.llm.packing import best_cuts, pack
from mailspark.llm.queries import tokenizer_path
from pyspark.sql import functions as F


# -- language model ---------------------------------------------------------------


def trie_of(texts, order):
    counts = [Counter() for _ in range(order + 1)]
    for g in grams(texts, order)[0].tolist():
        for o in range(order + 1):
            counts[o][g & ((1 << (WIDTH * (o + 1))) - 1)] += 1
    return Trie([(np.array(sorted(c), np.int64), np.array([c[g] for g in sorted(c)], np.int64)) for c in counts])


def plain_ppm(texts, order, context, symbol):
    """Probability by the definition: escape with q / 2n, leave out what longer contexts have seen."""
    p, excluded = 1.0, set()
    padded = [[END] * order + list(t) + [END] for t in texts]
    for o in range(order, -1, -1):
        seen = Counter(t[i] for t in padded for i in range(order, len(t)) if t[i - o : i] == context[len(context) - o :])
        left = {s: n for s, n in seen.items() if s not in excluded}
        total = sum(left.values())
        if symbol in left:
            return p * (left[symbol] - 0.5) / total
        if left:
            p *= 0.5 * len(left) / total
        excluded |= set(seen)
    return p / max(1, 257 - len(excluded))


def test_trie_codes_by_the_definition():
    texts, order = [b"abracadabra", b"abba", b"", b"cab"], 3
    trie = trie_of(texts, order)
    rng = random.Random(1)
    for _ in range(150):
        context = [rng.choice([*b"abcdrz", END]) for _ in range(order)]
        symbol = rng.choice([*b"abcdrz", END])
        gram = sum(s << (WIDTH * (order - i)) for i, s in enumerate([*context, symbol]))
        assert math.isclose(trie.log10(np.array([gram]))[0], math.log10(plain_ppm(texts, order, context, symbol)), abs_tol=1e-9)


def test_grams_stop_at_texts():
    g, starts = grams([b"ab", b"", b"c"], 2)
    assert starts.tolist() == [0, 3, 4]
    want = [(END, END, 97), (END, 97, 98), (97, 98, END), (END, END, END), (END, END, 99), (END, 99, END)]
    assert g.tolist() == [a << 18 | b << 9 | c for a, b, c in want]


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_base_score_by_the_definition(spark, frequent):
    docs = awkward_docs(spark, extra=True)
    part = crc_mod(F.col("doc_id"), 10)
    rows = score_documents(docs, part != 0, part == 0, frequent=frequent).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in docs.collect()]
    counts = Counter()
    for i, w in texts:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = counts.total(), len(counts)
    want = Counter(
        (i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in texts
    )
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)


def test_model_beats_the_unigram_and_bounds_its_nodes(spark):
    rng = random.Random(4)
    sentences = [text_of(rng, 8) for _ in range(20)]  # contexts tell much about what follows
    docs = spark.createDataFrame([(i, " ".join(rng.choices(sentences, k=7))) for i in range(300)], "doc_id long, text string")
    part = crc_mod(F.col("doc_id"), 10)
    sums = [
        score_documents(docs, part != 0, part == 0, **s).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        for s in ({}, {"max_nodes": 50})
    ]
    assert sums[0][0] > sums[0][1] and sums[0][0] > sums[1][0]
    nobody = score_documents(docs, F.lit(False), part == 0).first()
    assert nobody["train_tokens"] == 0 and nobody["n_known"] == 0
    assert score_documents(empty_docs(spark), part != 0, part == 0).count() == 0


@pytest.mark.parametrize("settings", [{}, {"cached": 100, "bin_rows": 20_000}, {"order": 2, "cached": 0, "bin_rows": 3_000}])
def test_every_node_of_the_trie_counts(spark, settings):
    rng = random.Random(8)
    letters = [chr(c) for c in range(192, 223)] + list("abcdefghijklmnopqrstuvwxyz 0123456789")  # more than 1,500,000 nodes
    texts = ["".join(rng.choices(letters, k=2000)) for _ in range(300)] + ["aaaa" * 500] * 20 + ["", None]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(4)
    part = crc_mod(F.col("doc_id"), 10)
    raws = [(t or "").encode().lower() for t in texts]
    order = settings.get("order", 5)
    trie = trie_of([r for i, r in enumerate(raws) if zlib.crc32(str(i).encode()) % 10], order)
    if order == 5:
        assert sum(len(o[0]) for o in trie.orders) > 1_500_000
    got = score_documents(docs, part != 0, part == 0, **settings).select("doc_id", "score").collect()
    assert len(got) == len(texts) + 1
    want = {i: trie.log10(grams([r], order)[0]).sum() for i, r in enumerate(raws)}
    for r in got:
        assert math.isclose(r["score"], want[r["doc_id"] or 0], rel_tol=1e-9)


# -- mixing -------------------------------------------------------------------------


def test_targets_share_the_excess():
    assert targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    got = targets([10, 1000, 1000])
    assert got[0] == 30 and math.isclose(sum(got), 2010) and math.isclose(got[1] / got[2], 2)
    assert targets([]) == [] and targets([0, 0]) == [0, 0]


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 300))
        size, prob = rng.integers(0, 50, n).astype(float), rng.random(n)
        p = flight(size, prob, rng.random(3 * n + 3))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert math.isclose(p.sum(), prob.sum(), abs_tol=1e-6) and math.isclose((p * size).sum(), (prob * size).sum(), abs_tol=1e-4)


@pytest.mark.parametrize("settings", [{}, {"block": 8, "fan_in": 4}])
def test_mix_comes_near_its_targets(spark, settings):
    rng = random.Random(1)
    rows = [(i, text_of(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "B", None, "c"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, **settings).toPandas()
    assert len(got) == 400 and (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"))
    assert math.isclose(by["target"].sum(), by["own"].sum())
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"] + 30).all()
    order = ["B", "a", "b", "c", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == o) for o in order]
    assert np.allclose([by["target"][o] if o else by["target"][by.index.isna()].iloc[0] for o in order], targets(sizes))
    again = mix(docs, **settings).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_blocks_stay_small_whatever_the_ids(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("s").alias("source")
    )
    rows = rows.unionByName(spark.range(100).select("id", F.lit("one").alias("text"), F.lit("t").alias("source")).toDF("doc_id", "text", "source"))
    sizes = rows.select("doc_id", "source", F.lit(2).cast("long").alias("size"))
    numbered = _numbered(sizes, 64)
    assert numbered.count() == 30_100 == numbered.distinct().count()
    blocks = numbered.groupBy(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "size", "nth"), F.lit(100))).count().toPandas()
    assert blocks["count"].max() < 500
    got = mix(rows, block=256, fan_in=8).toPandas()
    assert len(got) == 30_100 and (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 0.01 * by["target"] + 4).all()
    assert got["doc_id"].isna().sum() == 20_000


def test_take_of_equal_rows_and_null_ids(spark):
    rows = [(None, "two words", "s", "x")] * 500 + [(None, f"word {i}", "s", None) for i in range(300)]
    rows += [(7, "two words", "s", None)] * 40 + [(7, "two words", "s", "x"), (8, None, "s", "x"), (9, "one", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string").repartition(5)
    for settings in ({}, {"block": 16, "fan_in": 4}):
        m, got = mix(docs, **settings).toPandas(), take(docs, **settings)
        assert got.columns == docs.columns
        got = Counter(map(tuple, got.collect()))
        assert sum(got.values()) == m["copies"].sum() and set(got) <= set(rows)
        for key, part in m.groupby(["doc_id", "source", "size"], dropna=False):
            ours = {r: n for r, n in Counter(rows).items() if (r[0] or -1, r[2], len((r[1] or "").split())) == (-1 if key[0] != key[0] else key[0], *key[1:])}
            assert sum(ours.values()) == len(part) and sum(got[r] for r in ours) == part["copies"].sum()
            least, most = part["copies"].min(), part["copies"].max()
            assert all(least * n <= got[r] <= most * n for r, n in ours.items())


def test_mix_of_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    m = mix(docs)
    assert m.count() == docs.count()
    taken = take(docs)
    assert taken.columns == docs.columns
    assert taken.count() == m.agg(F.sum("copies")).first()[0]
    assert mix(empty_docs(spark)).count() == 0 and take(empty_docs(spark)).count() == 0


# -- packing ------------------------------------------------------------------------


def plain_cost(places, penalty, length):
    best = {0: 0.0}
    at = [0, *places]
    for j, p in zip(places, penalty):
        best[j] = min(best[i] + p + length - (j - i) for i in at if i in best and j - length <= i < j)
    return best[places[-1]]


def test_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        places = np.cumsum([rng.randrange(1, 20) for _ in range(rng.randrange(1, 60))])
        penalty = np.array([rng.choice([0.0, 4.0, 48.0]) for _ in places])
        cuts = best_cuts(places, penalty, 40)
        assert cuts[-1] == places[-1]
        cost = sum(penalty[np.searchsorted(places, j)] + 40 - (j - i) for i, j in zip([0, *cuts], cuts))
        assert all(0 < j - i <= 40 for i, j in zip([0, *cuts], cuts))
        assert math.isclose(cost, plain_cost(places.tolist(), penalty.tolist(), 40))


@pytest.mark.parametrize("settings", [{}, {"length": 64, "stretch_tokens": 200}])
def test_packing_is_a_partition_of_all_ids(spark, settings):
    from tokenizers import Tokenizer

    docs = awkward_docs(spark, extra=True)
    plain = Tokenizer.from_file(tokenizer_path())
    length = settings.get("length", 2048)
    rows = pack(docs, tokenizer_path(), **settings).collect()
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1)] += 1
    assert sum(r["length"] for r in rows) == sum(n * k for (_, n), k in want.items())
    pieces = Counter((r["doc_id"], r["doc_tokens"], r["start"]) for r in rows)
    assert Counter({(d, n): k for (d, n, s), k in pieces.items() if s == 0}) == want
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    sequences = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.concatenate([[0], np.cumsum([r["length"] for r in s])[:-1]]).tolist()
        assert sum(r["length"] for r in s) == s[0]["sequence_tokens"] <= length
    assert pack(empty_docs(spark), tokenizer_path()).count() == 0
