import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import awkward_docs, components, empty_docs
from mailspark.llm.line_dedup import SIDE, _close, _halves, _line_keys, _meet, drop_repeated_lines, key_plan, line_classes, lines_of, parted, signatures, within
from mailspark.llm.simhash_dedup import drop_near_duplicates
from mailspark.llm.substring_dedup import repeated_windows, remove_repeats


def expected_cut(texts, length):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        edge = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = edge.cumsum()[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def test_sorted_blocks_find_all_repeats():
    rng = np.random.default_rng(1)
    for _ in range(25):
        length, letters = int(rng.integers(8, 40)), int(rng.integers(1, 4))
        contents = [bytes(rng.integers(97, 97 + letters, int(rng.integers(1, 200))).astype(np.uint8)) for _ in range(int(rng.integers(1, 10)))]
        times = Counter(c[i : i + length] for c in contents for i in range(len(c) - length + 1))
        for c, found in zip(contents, repeated_windows(contents, length)):
            assert found.tolist() == [times[c[i : i + length]] > 1 for i in range(len(c) - length + 1)]


@pytest.mark.parametrize("settings", [{"length": 50, "gram": 12}, {"length": 50, "gram": 12, "variants": 2}, {"length": 50, "gram": 12, "block": 500}, {}])
def test_substrings_against_brute_force(spark, settings):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abé") for _ in range(60)) for _ in range(6)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))[rng.randrange(0, 30) :] for _ in range(80)]
    texts += [texts[5], texts[5], None, "", "a" * 1500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in remove_repeats(docs, **settings).collect()}
    for i, want in enumerate(expected_cut(texts, settings.get("length", 200))):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == want[3] and len(r["starts"]) == want[2]


def test_substrings_of_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    rows = remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    want = Counter(expected_cut([r["text"] for r in docs.collect()], 200))
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_substrings_of_many_equal_rows(spark):
    rng = random.Random(8)
    long, other = ("".join(rng.choice("abcdefgh ") for _ in range(21_000)) for _ in range(2))
    lone = other[:9000] + long[5000:5600] + other[9000:]
    texts = [(7, long)] * 2000 + [(i, long) for i in range(100, 600)] + [(None, "short")] * 50 + [(8, lone)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    got = remove_repeats(docs).groupBy("n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    gone = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in got} == {
        (21_000, 21_000, 1, gone, 2500),
        (5, 0, 0, hashlib.sha256(b"short").hexdigest(), 50),
        (21_600, 600, 1, hashlib.sha256(other.encode()).hexdigest(), 1),
    }


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, n):
    s = bytearray(line)
    for _ in range(n):
        at = rng.randrange(len(s))
        [lambda: s.__setitem__(at, rng.choice(b"abc")), lambda: s.insert(at, rng.choice(b"abc")), lambda: s.__delitem__(at)][rng.randrange(3)]()
    return bytes(s)


def test_automaton_and_keys_agree_with_edit_distance():
    rng = random.Random(3)
    x = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(20, 40))) for _ in range(600)]
    y = [edited(rng, s, rng.randrange(0, 5)) for s in x]
    d = np.array([distance(a, b) for a, b in zip(x, y)])

    def keys(s, k, probe):
        return {(s[i:j], seed) for i, j, seed, p in key_plan(len(s), k) if p == probe}

    for k in (1, 2, 3):
        assert (within(x, y, k) == (d <= k)).all()
        for a, b in ((a, b) for a, b, n in zip(x, y, d) if n <= k):
            assert keys(a, k, False) & keys(b, k, True) or keys(b, k, False) & keys(a, k, True)
            assert _close(signatures([a]), signatures([b]) | SIDE, k).all()


def test_keys_of_a_batch_are_those_of_the_plan():
    """Computed all at once, across blocks of the hash, two lines meet under as many keys as by the plan's substrings and seeds."""
    rng = random.Random(4)
    base = [bytes(rng.choice(b"ab\xff") for _ in range(size)) for size in (5, 6, 20, 33, 40_000, 33, 50, 70_000)]
    lines = [edited(rng, s, n) for s in base for n in (0, 0, 1, 2)]
    for k in (1, 2, 3):
        key, row, probe = _line_keys(lines, k)
        plan = [Counter((x[s:e], seed, p) for s, e, seed, p in key_plan(len(x), k)) for x in lines]
        got = [Counter((h, p) for h, p in zip(key[row == n].tolist(), probe[row == n].tolist())) for n in range(len(lines))]
        met = lambda sets, side: [
            [sum(c for t, c in x.items() if not t[-1] and side(t) in y) for y in sets] for x in sets
        ]
        assert met(got, lambda t: (*t[:-1], True)) == met(plan, lambda t: (*t[:-1], True))
        assert [sorted(x.values()) for x in got] == [sorted(x.values()) for x in plan]
    h = xxhash.xxh3_128_intdigest(b"x")
    assert _halves([b"x"]).ravel().tolist() == [(h >> 64) - 2**63, h % 2**64 - 2**63]


@pytest.mark.parametrize("settings", [{}, {"hot": 3}, {"k": 1}, {"k": 3, "hot": 6}, {"filter_bits": 1 << 15}])
def test_lines_against_brute_force(spark, settings):
    rng = random.Random(9)
    base = [bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(15, 60))) for _ in range(25)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.randrange(0, 4)).decode() for _ in range(rng.randrange(0, 6))) for _ in range(80)]
    texts += [None, "", " \n\t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    lines = [(i, n, s) for i, t in enumerate(texts) for n, s in lines_of(t)]
    k = settings.get("k", 2)
    links = [
        (i, j)
        for i, (*_, a) in enumerate(lines)
        for j, (*_, b) in enumerate(lines[:i])
        if a == b or (min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= k and distance(a, b) <= k)
    ]
    group = components(len(lines), links)
    want = {(d, n, *lines[g][:2], g == i) for i, ((d, n, _), g) in enumerate(zip(lines, group))}
    got = line_classes(docs, **settings).drop("th").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(lines)


def test_lines_of_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    n = sum(1 for r in docs.collect() for _ in lines_of(r["text"]))
    assert line_classes(docs).count() == n
    kept = drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 0 in rows and 100 not in rows  # 100 repeats 0
    assert rows[200] is None and rows[201] == "" and rows[202] == " \n\t "
    assert drop_repeated_lines(empty_docs(spark)).count() == 0


def test_only_repeated_lines_go(spark):
    first = "the first line of this text\nanother line that is long enough"
    second = "a line of its own, seen once only\nanother line that is lung enough\n\nlast"
    docs = spark.createDataFrame([(1, first), (2, second), (3, "the first line of this text.")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in drop_repeated_lines(docs).collect()} == {
        1: first,
        2: "a line of its own, seen once only\n\nlast",
    }


def test_parted_groups_keep_every_close_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63 - 1, 40)
    sig = base[rng.integers(0, 40, 3000)]
    for _ in range(2):  # up to two of 63 bits turned over in each, four between two rows
        sig = np.where(rng.random(3000) < 0.7, sig ^ (np.int64(1) << rng.integers(0, 63, 3000)), sig)
    sig &= ~np.int64(0xFFF)  # a stretch that is the same in all rows, as under a key that was split by it
    sig = np.where(rng.random(3000) < 0.5, sig | SIDE, sig)
    own = np.arange(3000)
    met, most = set(), 0
    for a, s in parted(own, sig, 2, most=50):
        i, j = np.nonzero(_close(s[:, None], s[None, :], 2))
        met |= set(zip(np.minimum(a[i], a[j]).tolist(), np.maximum(a[i], a[j]).tolist()))
        most = max(most, len(a))
    i, j = np.nonzero(_close(sig[:, None], sig[None, :], 2))
    assert met == {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} and len(met) > 10_000 and most < 300


def test_copies_of_a_line_under_one_key_are_compared_once():
    """100,000 tasks that each write the keys of three lines: rows count once, however many there are."""
    n = 100_000
    a, sig = np.tile([5, 6, 7], n), np.tile(np.array([3, 1 | SIDE, (2**40 - 1) | SIDE]), n)
    frames = iter([pd.DataFrame({"key": np.ones(3 * n, np.int64), "a": a, "sig": sig})])
    assert pd.concat(_meet(2)(frames)).drop_duplicates().to_dict("records") == [{"a1": 5, "a2": 6}]


def test_repeated_rows_stay_once(spark):
    rows = [(7, "a line that many rows hold again and again", "x", i) for i in range(2000)] + [(None, None, None, i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string, nth long").repartition(16)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in drop_repeated_lines(docs).collect()) == [(0, None), (7, rows[0][1])]
    assert drop_near_duplicates(docs).count() == 2
