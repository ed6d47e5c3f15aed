import random
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward_docs, components, empty_docs, text_of
from mailspark.llm import embedding_dedup, simhash_dedup
from mailspark.llm.components import connected_components, forest


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}" if h else "0" * 16


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 301), (301, 300)]
    links += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)]
    rng.shuffle(links)
    want = components(700, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want[n] for a, b in links if a != b for n in (a, b)}
    assert forest(700, np.array([a for a, _ in links]), np.array([b for _, b in links])).tolist() == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_plan_finds_every_near_pair():
    rng = np.random.default_rng(5)
    both = np.full((64, 64), 250.0) + 250 * np.eye(64)
    for n in (100, 10**6, 10**12):
        parts, thresholds = simhash_dedup.plan(both, n, rng.integers(0, 2**63, 500).astype(np.uint64), 3)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert sum(thresholds) == 3 - len(parts) + 1
        masks = [m for p, t in zip(parts, thresholds) for m in simhash_dedup.part_masks(p, t)]
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(flips & m == 0 for m in masks)
            m = masks[0]
            if flips & m == 0:  # and so do the finer keys of a large one
                assert any(flips & f == 0 and f & m == m for f in simhash_dedup.finer(m, 3))


@pytest.mark.parametrize("block", [1024, 4])
def test_simhash_against_brute_force(spark, block):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        words = text_of(rng, rng.randrange(80, 200)).split()
        for _ in range(rng.randrange(1, 12)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "One two", "one TWO", texts[0]]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(docs, block=block).collect()}
    fp = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i], 16) ^ int(fp[j], 16)).bit_count() <= 3]
    group = components(len(fp), links)
    least = {g: min(ids[i] for i in range(len(ids)) if group[i] == g) for g in group}
    for i, d in enumerate(ids):
        assert rows[d]["fingerprint"] == fp[i]
        assert rows[d]["component_id"] == least[group[i]]


def test_simhash_on_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    assert simhash_dedup.near_duplicates(docs).count() == docs.count()
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 100 not in ids  # 100 is a copy of 0
    assert len({200, 201, 202} & set(ids)) == 1  # three texts without words
    assert simhash_dedup.near_duplicates(empty_docs(spark)).count() == 0


def vectors():
    rng = np.random.default_rng(7)
    out = []
    for _ in range(30):
        centre = rng.standard_normal(16)
        out += [centre + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3]) for _ in range(int(rng.integers(1, 9)))]
    out += [out[0], out[0], out[5], out[3] * 1e-30, out[4] * 1e30]
    return [v.tolist() for v in out]


@pytest.mark.parametrize("block", [1024, 3])
def test_embeddings_against_brute_force(spark, block):
    vs = vectors()
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [float("inf")] * 16, [1.0] * 3, [1.0] * 3]
    rows = [(i, v, 1) for i, v in enumerate(vs + odd)] + [(None, vs[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, recall=0.9999, block=block).collect()}
    x = np.array(vs)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    group = components(len(vs), close.tolist())
    links = np.bincount(close.ravel(), minlength=len(vs))
    found = sum(got[i]["n_links"] for i in range(len(vs)))
    assert 0.99 * links.sum() <= found <= links.sum()
    assert np.mean([got[i]["component_id"] == group[i] for i in range(len(vs))]) > 0.99
    n = len(vs)
    for i in range(n, n + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[n + 7]["n_links"], got[n + 7]["component_id"], got[n + 7]["kept"]) == (1, n + 6, False)
    assert (got[None]["n_links"], got[None]["kept"]) == (0, True)


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
