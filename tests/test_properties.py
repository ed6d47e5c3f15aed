"""Property tests: Spark text functions vs direct Python statements of the rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from support import eval_col
from mailspark.functions import filenames as N
from mailspark.functions import text as X

# Alphabet with every class the rules care about: controls, blanks, delimiters,
# forbidden name characters, Latin-1, CJK, an astral character, NEL, NBSP.
ALPHABET = st.sampled_from(list("ab Z9.!?\t\n\r\x0b\x0c\x01\x7f/\\:%*|\"<>'éß中\U0001F600\u0085 　-"))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=40)

WS_NL = set(chr(c) for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def py_trim(s):
    a, b = 0, len(s)
    while a < b and s[a] in WS_NL:
        a += 1
    while b > a and s[b - 1] in WS_NL:
        b -= 1
    return s[a:b]


def py_lenient(s):
    return all(0x09 <= b <= 0x0D or 0x20 <= b <= 0x7E for b in s.encode("utf-8"))


def py_strict(s):
    return all(b in (0x09, 0x0A, 0x0D) or 0x20 <= b <= 0x7E for b in s.encode("utf-8"))


def py_strip(s):
    return "".join(c for c in s if 0x20 <= ord(c) <= 0x7E or c in "\n\r\t")


def py_first(s):
    return next((t for t in (py_trim(p) for p in re.split(r"[.!?]", s)) if len(t) > 8), "")


def py_last(s):
    return next((t for t in reversed([py_trim(p) for p in re.split(r"[.!?]", s)]) if len(t) > 8), "")


def py_sanitize(s):
    return re.sub(r"[/\\:?%*|\"<>']", "_", py_strip(s))


@settings(max_examples=6, deadline=None)
@given(TEXTS)
def test_text_functions_match_rules(spark, texts):
    assert eval_col(spark, texts, X.is_clear_text) == [py_lenient(t) for t in texts]
    assert eval_col(spark, texts, X.is_clear_text_strict) == [py_strict(t) for t in texts]
    assert eval_col(spark, texts, X.strip_non_ascii) == [py_strip(t) for t in texts]
    assert eval_col(spark, texts, X.trim_ws_nl) == [py_trim(t) for t in texts]
    assert eval_col(spark, texts, X.first_sentence) == [py_first(t) for t in texts]
    assert eval_col(spark, texts, X.last_sentence) == [py_last(t) for t in texts]
    assert eval_col(spark, texts, N.sanitize_for_filename) == [py_sanitize(t) for t in texts]
