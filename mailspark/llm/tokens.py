"""Token ids of many texts at once: every distinct word of a batch goes through its tokenizer once.

Both kinds of tokenizer code the stretches between certain places of a text apart,
whatever stands around them.  The byte-level one always cuts between a character
that is no white space and white space.  The piece one never joins a character and
a space (or a line feed) after it, as long as no entry of its vocabulary does, which
is looked up.  So a text is its *units*, each a run of ASCII white space and what
follows up to the next, and the ids of a batch are the ids of its distinct units,
dealt out again.  A text with other white space (or, for the byte-level tokenizer,
the string of a special token) is one unit, so ids always equal the tokenizer's own.
Nothing but the tokenizers is kept from one batch to the next.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: White space beyond ASCII's, and separators that some tokenizers take for white space.
OTHER_SPACE = "[\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"

_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them, then the same of the next."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total)


def units(texts: pa.Array, whole: np.ndarray, breaks: np.ndarray = _WHITE) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of texts (large_string, no nulls) as a dictionary array, and where each text's units begin (n + 1 places).

    ``whole``: texts that are one unit; ``breaks``: bytes before which a unit may begin, if no such byte stands before them.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    white = breaks[raw[lo:hi]]
    begin = white.copy()
    begin[1:] &= ~white[:-1]
    edges = offsets - lo
    for k in np.flatnonzero(whole):
        begin[edges[k] : edges[k + 1]] = False
    filled = edges[:-1][edges[1:] > edges[:-1]]
    begin[filled] = True
    at = np.flatnonzero(begin)
    of_text = np.searchsorted(at, edges)
    places = np.append(at, hi - lo) + lo
    array = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(places.astype(np.int64)), data if data is not None else pa.py_buffer(b""))
    return array.dictionary_encode(), of_text


def ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists one after another, and their n + 1 places."""
    places = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=places[1:])
    return np.fromiter(chain.from_iterable(lists), "<u4", int(places[-1])), places


class Tokens:
    """Base of the two tokenizers: ``ids(texts)`` gives the ids of all texts and each text's n + 1 places."""

    breaks = _WHITE

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, of_text = units(texts, self.one_unit(texts), self.breaks)
        values, places = ragged(self.encode(found.dictionary))
        index = found.indices.to_numpy(zero_copy_only=False)
        lengths = np.diff(places)[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return values[spread(places[index], lengths)], ends[of_text]

    def one_unit(self, texts: pa.Array) -> np.ndarray:
        """Which texts are a unit as they stand."""
        return np.zeros(len(texts), bool)


#: Characters whose class (letter, digit, other) is as old as Unicode 5; others may differ between libraries.
SETTLED = "^[\x00-ɏ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]*$"

#: Fixed value: how byte-level vocabularies cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens(Tokens):
    """Byte-level tokenizer of a ``tokenizers`` file; with ``plain`` the strings of special tokens are ordinary text.

    The ids are those of the ``tokenizers`` library.  Where the file's ids stand in the order
    of its merges, units of settled characters are merged by ``tiktoken`` over the same file's
    vocabulary, which gives the same ids in a fifth of the time; all else goes through ``tokenizers``.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._merger(path)

    def _merger(self, path: str):
        """The quick merger, if the file's rules are those that it follows."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, cut = rules["model"], rules["pre_tokenizer"] or {}
        vocab, merges = model["vocab"], model.get("merges", [])
        joined = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
        ordered = None not in joined and joined == sorted(set(joined))
        usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        if not (model["type"] == "BPE" and ordered and usual and rules["normalizer"] is None):
            return None
        alphabet, added = byte_alphabet(), {t["content"] for t in rules["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in s): i for s, i in vocab.items() if s not in added}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, found: pa.Array) -> list[list[int]]:
        texts = found.to_pylist()
        if self.fast is None:
            return self._plain(texts)
        settled = pc.and_(pc.match_substring_regex(found, SETTLED), pc.invert(self._kept_whole(found)))
        rest = np.flatnonzero(~settled.to_numpy(zero_copy_only=False)).tolist()
        if not rest:
            return list(map(self.fast, texts))
        slow = dict(zip(rest, self._plain([texts[i] for i in rest])))
        return [slow[i] if i in slow else self.fast(t) for i, t in enumerate(texts)]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _kept_whole(self, texts: pa.Array) -> pa.Array:
        out = pc.match_substring_regex(texts, OTHER_SPACE)
        for s in self.special:
            out = pc.or_(out, pc.match_substring(texts, s))
        return out

    def one_unit(self, texts: pa.Array) -> np.ndarray:
        return self._kept_whole(texts).to_numpy(zero_copy_only=False)

    def bytes_of(self) -> list[bytes]:
        """The bytes that each id stands for."""
        alphabet = byte_alphabet()
        vocab = self.tokenizer.get_vocab(True)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        out = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            out[i] = added.get(i) or bytes(alphabet[c] for c in s)
        return out


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, all others as U+0100 and on, in order."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(0x100 + k): b for k, b in enumerate(others)}


class PieceTokens(Tokens):
    """``sentencepiece`` tokenizer, for texts that begin with the space which it adds itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.space = self.model.piece_to_id(SPACE_PIECE)
        self.breaks = np.zeros(256, bool)
        self.breaks[0x20] = not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in self.pieces)
        self.breaks[0x0A] = self.breaks[0x20] and not any("\n" in p for p in self.pieces)

    def one_unit(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring(texts, SPACE_PIECE).to_numpy(zero_copy_only=False)

    def encode(self, found: pa.Array) -> list[list[int]]:
        texts = found.to_pylist()
        led = [t[:1] == " " for t in texts]
        out = self.model.encode([t[1:] if s else t for t, s in zip(texts, led)], num_threads=1)
        # the space that the model adds: the unit's own, or (before a line feed) a piece to take away
        return [(x or [self.space]) if s else x[1:] for x, s in zip(out, led)]

    def bytes_of(self) -> list[bytes]:
        """The bytes that each id stands for."""
        return [
            bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_PIECE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]


#: How pieces write a space.
SPACE_PIECE = "▁"

_LOADED: dict[tuple, Tokens] = {}


def loaded(kind: type[Tokens], *args) -> Tokens:
    """A worker's tokenizer of that kind and file, read once."""
    if (kind, args) not in _LOADED:
        _LOADED[kind, args] = kind(*args)
    return _LOADED[kind, args]


def documents_ids(tokens: Tokens, f: pd.DataFrame, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids and the end token) of the rows of a frame of (doc_id, text)."""
    ids, at = tokens.ids(pa.array(f["text"].fillna(""), pa.large_string()))
    end, at = np.array([end_id], "<u4"), at.tolist()
    for k, doc_id in enumerate(f["doc_id"]):
        yield None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids[at[k] : at[k + 1]], end])
