import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs
from mailspark.llm.best_fit import Plan, cut, pack_best_fit, sequences
from mailspark.llm.queries import tokenizer_path


def one_by_one(sizes, capacity):
    """The same rules, piece by piece: room left in every sequence."""
    large = sorted(s for s in sizes if 3 * s > capacity)
    rooms = []
    while large:
        x = large.pop()
        fits = [i for i, y in enumerate(large) if x + y <= capacity]
        rooms.append(capacity - x - (large.pop(fits[-1]) if fits else 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def contents(plan):
    got, numbers = defaultdict(list), defaultdict(list)
    for s, r0, n, first, each, offset in plan.segments:
        for j in range(n):
            got[first + j // each].append((offset + j % each * s, s))
            numbers[s].append(r0 + j)
    return got, numbers


@pytest.mark.parametrize("seed", range(60))
def test_plan_packs_as_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 30, 100])
    sizes = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 4)) for _ in range(rng.randrange(0, 120))]
    counts = Counter(sizes)
    plan = Plan(counts, capacity)
    got, numbers = contents(plan)
    for s, n in counts.items():
        assert sorted(numbers[s]) == list(range(n))
    assert sorted(got) == list(range(plan.sequences))
    rooms = []
    for parts in got.values():
        at = 0
        for offset, s in sorted(parts):
            assert offset == at
            at += s
        assert at <= capacity and sum(3 * s > capacity for _, s in parts) <= 2
        rooms.append(capacity - at)
    assert sorted(rooms) == one_by_one(sizes, capacity)


def test_plan_of_very_many_pieces_is_short():
    plan = Plan({s: 10**9 + s for s in range(1, 2049)})
    tokens = sum(s * (10**9 + s) for s in range(1, 2049))
    assert plan.sequences < 1.01 * tokens / 2048 and len(plan.segments) < 100_000


def test_cut():
    assert cut(1) == [(0, 1)] and cut(2048) == [(0, 2048)]
    assert cut(2049) == [(0, 1), (1, 2048)] and cut(4096) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_every_id_lies_in_one_place(spark, capacity):
    from tokenizers import Tokenizer

    docs = awkward_docs(spark, extra=True)
    rows = pack_best_fit(docs, tokenizer_path(), capacity, with_ids=True).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    copies = Counter(r["doc_id"] for r in docs.collect())
    want = Counter({(d, k, s, n): copies[d] for d in ids for k, (s, n) in enumerate(cut(len(ids[d]), capacity))})
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        raw = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids"] == raw and r["ids_crc32"] == zlib.crc32(raw)
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(at) == len(one_by_one([r["length"] for r in rows], capacity))


def test_sequences_hold_the_ids(spark):
    docs = awkward_docs(spark)
    pieces = pack_best_fit(docs, tokenizer_path(), 256, with_ids=True)
    built = {r["sequence_id"]: r for r in sequences(pieces).collect()}
    for r in pieces.collect():
        s = built[r["sequence_id"]]
        assert bytes(s["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
        assert len(s["ids"]) == 4 * s["n_tokens"]


def test_many_equal_rows_and_empty_tables(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "if(id % 3 = 0, 'one two three', repeat('word ', int(id % 50))) text").repartition(7)
    rows = pack_best_fit(docs, tokenizer_path(), 128).toPandas()
    assert len(rows) == 20_000 and rows.groupby("sequence_id")["length"].sum().max() <= 128
    assert rows["sequence_id"].nunique() <= 1.02 * rows["length"].sum() / 128 + 1
    assert pack_best_fit(empty_docs(spark), tokenizer_path()).count() == 0
