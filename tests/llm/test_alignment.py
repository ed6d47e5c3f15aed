import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from helpers import awkward_docs, empty_docs
from mailspark.llm.alignment import Aligned, Words, align, shared_ends
from mailspark.llm.queries import piece_tokenizer_path as piece_path
from mailspark.llm.queries import tokenizer_path
from mailspark.llm.tokens import ByteTokens
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(a, b):
    """a, b: (id, byte length) of one text; the groups of ids."""
    out, i, j, at_a, at_b, g = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            g[0].append(a[i][0])
            at_a, i = at_a + a[i][1], i + 1
        else:
            g[1].append(b[j][0])
            at_b, j = at_b + b[j][1], j + 1
        if at_a == at_b and all(g):
            out.append(g)
            g = ([], [])
    return out


def said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def random_tokens(rng, total):
    cuts = sorted(rng.sample(range(1, total), rng.randrange(0, total))) if total > 1 else []
    return [(rng.randrange(6), q - p) for p, q in zip([0, *cuts], [*cuts, total])]


@pytest.mark.parametrize("seed", range(40))
def test_groups_and_links_of_random_tokens(seed):
    rng = random.Random(seed)
    texts = [(random_tokens(rng, n), random_tokens(rng, n)) for n in (rng.randint(1, 60) for _ in range(rng.randrange(1, 9)))]
    side = lambda k: [np.array([t[i] for pair in texts for t in pair[k]]) for i in (0, 1)]
    at = [np.cumsum([0, *(len(pair[k]) for pair in texts)]) for k in (0, 1)]
    (a, a_len), (b, b_len) = side(0), side(1)
    got = Aligned(a, b, a_len, b_len, at[0], at[1])
    groups = [plain_groups(*t) for t in texts]
    assert [t.decode() for t in got.texts(Words(6))] == [said(g) for g in groups]
    want = Counter((d, x, y) for d, g in enumerate(groups) for xs, ys in g for x in xs for y in ys)
    for limit in (1, 40, 1 << 20):
        keys, times = got.links(7, limit)
        assert {(k >> 32, (k & 0xFFFFFFFF) // 7, k % (1 << 32) % 7): n for k, n in zip(keys.tolist(), times.tolist())} == want
        assert (np.diff(keys) > 0).all()


def test_shared_ends_far_from_the_middle():
    a = np.arange(1, 2001)
    for b in (np.array([2000]), np.array([1, 2000]), np.array([1999, 2000]), np.array([3, 900, 901, 2000])):
        assert (shared_ends(a, b, np.array([0]), np.array([2000])) + 1).tolist() == b.tolist()


def plain(rows):
    first = Tokenizer.from_file(tokenizer_path())
    first.encode_special_tokens = True
    spelled = ByteTokens(tokenizer_path(), True).bytes_of()
    second = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for doc_id, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(spelled[i] for i in a) != want or b"".join(map(piece, b)) != want:
            a, b = [], []
        docs.append((doc_id, len(a), len(b), plain_groups([(i, len(spelled[i])) for i in a], [(i, len(piece(i))) for i in b])))
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for *_, g in docs]
    counts = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for (doc_id, n_a, n_b, g), c in zip(docs, links):
        n_best = sum(n for p, n in c.items() if counts[p] == best[p[0]])
        sha = hashlib.sha256(said(g).encode()).hexdigest() if g else ""
        yield doc_id, n_a, n_b, len(g), sum(c.values()), n_best, sum(n * counts[p] for p, n in c.items()), sha


@pytest.mark.parametrize("table", [1_000_000, 40, 0])
def test_awkward_documents_by_brute_force(spark, table):
    docs = awkward_docs(spark, extra=True)
    odd = [(300, "a▁b <|endoftext|> <0x41>"), (301, "日本 é x"), (302, "\n\nx  y\n"), (303, "ab" * 3000), (304, "<|endoftext|>")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = sorted(plain([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in align(docs, tokenizer_path(), piece_path(), table).collect()), key=repr)
    assert got == want


def test_groups_on_request_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Lamp walks"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in align(docs, tokenizer_path(), piece_path(), with_groups=True).collect()}
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"]
    assert rows[2]["groups"] == "" and rows[2]["n_a"] == 0
    assert align(empty_docs(spark), tokenizer_path(), piece_path()).count() == 0
