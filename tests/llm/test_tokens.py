"""Ids through distinct units equal those of the tokenizers themselves."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mailspark.llm import tokens
from mailspark.llm.queries import piece_tokenizer_path as piece_path
from mailspark.llm.queries import tokenizer_path

ODD = ["", " ", "a b", "a  b", "\n", "\n\nx", " a\nb ", "a\tb c\n d", "Ünï 日本語 x's it's\nI'll 12 3,4", "x.. y!?; 3,. é."]
ODD += ["a., b,", "é. x", "...", "a\n...b. .\n.", " . x", "x\u200b. y", "don't. s'. '", "<|endoftext|> a b", "w" * 3000, "b, b\nb"]
ODD += ["a\u00a0 b", "a\x1cb \x1c c", "١٢ ab", "\U0001f600 x", "ǅ ʰ ª º ² ½", "\u3000 a", "a \r\n\r\n b\x0b", "\u0378 Ɤ", "x▁y ▁", "a\x00b "]
BYTE, PLAIN = tokens.ByteTokens(tokenizer_path()), tokens.ByteTokens(tokenizer_path(), True)
PIECE = tokens.PieceTokens(piece_path())


def all_ids(kind, texts):
    ids, at = kind.ids(pa.array(texts, pa.large_string()))
    return [ids[i:j].tolist() for i, j in zip(at, at[1:])]


def check(texts):
    for kind in (BYTE, PLAIN):
        assert all_ids(kind, texts) == [kind.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = all_ids(PIECE, [" " + t for t in texts])
    assert got == [PIECE.model.encode(t) if t else [PIECE.space] for t in texts]


def test_odd_texts():
    assert BYTE.fast is not None
    check(ODD)
    check(ODD[::-1] * 2)
    check([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from([*" \n\t\r\u00a0\u2003ab.'1é▁日\u0378"]), max_size=12), max_size=6))
def test_random_texts(texts):
    check(texts)


def test_all_texts_of_a_table():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    check([t or "" for t in texts])


def test_without_the_quick_merger(monkeypatch):
    monkeypatch.setattr(BYTE, "fast", None)
    assert all_ids(BYTE, ODD) == all_ids(tokens.ByteTokens(tokenizer_path()), ODD)


def test_bytes_of_ids():
    for t in ("ab é 日本\n x", "\x00\xff½"):
        assert b"".join(PLAIN.bytes_of()[i] for i in all_ids(PLAIN, [t])[0]) == t.encode()
        assert b"".join(PIECE.bytes_of()[i] for i in all_ids(PIECE, [" " + t])[0]) == (" " + t).encode()


@pytest.mark.parametrize("n", [0, 5])
def test_spread(n):
    starts, lengths = np.arange(n) * 10, np.arange(n) % 3
    assert tokens.spread(starts, lengths).tolist() == [10 * k + i for k in range(n) for i in range(k % 3)]
