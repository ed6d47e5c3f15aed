"""Text predicates and transforms as Catalyst expressions.

Every function takes a Column (or column name) and returns a Column, so all of
them run inside whole-stage codegen next to the scan; none is a Python UDF.
Regexes use ``\\A``/``\\z`` because ``$`` also matches before a final newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Loader clear-text bytes: TAB, LF, VT, FF, CR and printable ASCII 0x20-0x7E.
LENIENT_CLEAR_RE = r"\A[\x09-\x0D\x20-\x7E]*\z"
# Strict clear-text bytes: TAB, LF, CR and printable ASCII 0x20-0x7E.
STRICT_CLEAR_RE = r"\A[\t\n\r\x20-\x7E]*\z"
# Characters kept by the ASCII strip: printable ASCII, LF, CR, TAB.
NON_ASCII_RE = r"[^\x20-\x7E\n\r\t]"
# Whitespace-and-newline set: Unicode Z categories, U+0009-U+000D, U+0085.
WS_NL_CLASS = r"[\p{Z}\x09-\x0D\x{85}]"
# Whitespace set used for header values: TAB and Unicode Zs.
WS_CLASS = r"[\t\p{Zs}]"
# Sentence delimiters.
SENTENCE_SPLIT_RE = r"[.!?]"
# A sentence counts when its length is above this many characters.
MIN_SENTENCE_LEN = 8
# Body clean-up markers (matched case-insensitively): an RTF part ends before the
# next "\n--" or at the end; multipart and attachment markers cut to the end.
RTF_PART_RE = r"(?is)content-type: application/rtf.*?(\n--|\z)"
MULTIPART_TAIL_RE = r"(?is)content-type: multipart/mixed.*\z"
ATTACHMENT_TAIL_RE = r"(?is)content-disposition: attachment.*\z"
MARKER_START = "content-"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_clear_text(col) -> Column:
    """loader's lenient test; NULL counts as clear."""
    return F.coalesce(_c(col).rlike(LENIENT_CLEAR_RE), F.lit(True))


def is_clear_text_strict(col) -> Column:
    """strict test (vertical tab and form feed fail); NULL counts as clear."""
    return F.coalesce(_c(col).rlike(STRICT_CLEAR_RE), F.lit(True))


def strip_non_ascii(col) -> Column:
    """Keep printable ASCII, LF, CR, TAB."""
    return F.regexp_replace(_c(col), NON_ASCII_RE, "")


def _trim_re(cls: str) -> str:
    # The trailing run may only start where a run starts (lookbehind) and is
    # matched possessively, so a long blank run costs linear time, not quadratic.
    return rf"\A{cls}++|(?<!{cls}){cls}++\z"


def trim_ws_nl(col) -> Column:
    """Trim Unicode whitespace and newlines at both ends."""
    return F.regexp_replace(_c(col), _trim_re(WS_NL_CLASS), "")


def trim_ws(col) -> Column:
    """Trim TAB and Unicode space separators at both ends (header values)."""
    return F.regexp_replace(_c(col), _trim_re(WS_CLASS), "")


def remove_attachments(col) -> Column:
    """Drop RTF parts, then a multipart/mixed tail, then an attachment tail.

    The three case-insensitive regexes run only on texts that contain the
    common marker start (a plain substring test on the lower-cased text); any
    ASCII-case variant of a marker lower-cases to it, so no match is missed.
    """
    src = _c(col)
    c = F.regexp_replace(src, RTF_PART_RE, "$1")
    c = F.regexp_replace(c, MULTIPART_TAIL_RE, "")
    c = F.regexp_replace(c, ATTACHMENT_TAIL_RE, "")
    return F.when(F.lower(src).contains(MARKER_START), c).otherwise(src)


def sentences(col) -> Column:
    """Pieces between '.', '!' and '?' (empty pieces kept; NULL -> [''])."""
    return F.split(F.coalesce(_c(col), F.lit("")), SENTENCE_SPLIT_RE, -1)


# Sentence pieces without arrays (all codegen, linear time).  A piece starts at
# the text start or right after a delimiter (lookbehind); its trimmed part runs
# from its first to its last non-blank character.  The leading \A keeps a failed
# search from restarting at every position.
_NOT_DELIM = r"[^.!?]"
_CONTENT = r"[^.!?\p{Z}\x09-\x0D\x{85}]"  # neither delimiter nor blank
_PIECE_START = r"(?<![^.!?])"
# Trimmed piece longer than the limit: a content char, then at least `limit`
# more characters of the piece, the last of them a content char.
_LONG_TRIMMED = rf"{WS_NL_CLASS}*+({_CONTENT}{_NOT_DELIM}{{{MIN_SENTENCE_LEN},}}(?<!{WS_NL_CLASS}))"
FIRST_LONG_PIECE_RE = rf"\A(?s:.*?){_PIECE_START}({_NOT_DELIM}{{{MIN_SENTENCE_LEN + 1},}})"
FIRST_SENTENCE_RE = rf"\A(?s:.*?){_PIECE_START}{_LONG_TRIMMED}"
LAST_SENTENCE_RE = rf"\A(?s:.*){_PIECE_START}{_LONG_TRIMMED}"


def first_sentence_thread_form(col) -> Column:
    """X6 (per message of a thread): first piece whose *untrimmed* length is
    above the limit, then trimmed; NULL when the message has no such piece."""
    piece = F.regexp_extract(F.coalesce(_c(col), F.lit("")), FIRST_LONG_PIECE_RE, 1)
    return trim_ws_nl(F.nullif(piece, F.lit("")))


def first_sentence(col) -> Column:
    """First trimmed piece longer than the limit, else ''."""
    return F.regexp_extract(F.coalesce(_c(col), F.lit("")), FIRST_SENTENCE_RE, 1)


def last_sentence(col) -> Column:
    """Last trimmed piece longer than the limit, else ''."""
    return F.regexp_extract(F.coalesce(_c(col), F.lit("")), LAST_SENTENCE_RE, 1)


def contains_ci(col, keyword: str, unicode_equal: bool = False) -> Column:
    """F1-F3 match: keyword trimmed (F7), case-insensitive substring; a NULL
    field never matches and an empty keyword matches nothing (F6).

    ``unicode_equal`` compares under the ``UNICODE_CI`` collation, so composed
    and decomposed forms of a character match (slower: ICU); the default is the
    binary comparison of lower-cased text.
    """
    key = keyword.strip(_PY_WS_NL)
    if key == "":
        return F.lit(False)
    if unicode_equal:
        return F.coalesce(F.contains(F.collate(_c(col), "UNICODE_CI"), F.lit(key)), F.lit(False))
    return F.coalesce(F.lower(_c(col)).contains(F.lower(F.lit(key))), F.lit(False))


def regex_match(col, pattern: str) -> Column:
    """Regular-expression search on a field; NULL never matches."""
    return F.coalesce(_c(col).rlike(pattern), F.lit(False))


def describe_email(from_col="from_addr", subject_col="subject", date_col="date") -> Column:
    """Debug text ``<Email from:.. subject:.. date:..>``; NULL -> (none)."""
    none = F.lit("(none)")
    return F.concat(
        F.lit("<Email from:"), F.coalesce(_c(from_col), none),
        F.lit(" subject:"), F.coalesce(_c(subject_col), none),
        F.lit(" date:"), F.coalesce(_c(date_col), none),
        F.lit(">"),
    )


# Python-side equivalent of the whitespace-and-newline set, for literals typed by a user.
_PY_WS_NL = "".join(
    chr(c) for c in list(range(0x09, 0x0E)) + [0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    + list(range(0x2000, 0x200B))
)
