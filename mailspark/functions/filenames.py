"""File-name functions (N1-N4) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_non_ascii

# Fixed values that must equal the reference's behaviour.
# Characters replaced by "_" in names: / \ : ? % * | " < > '
FORBIDDEN_NAME_CHARS_RE = r"[/\\:?%*|\"<>']"
# Longest kept name part.
MAX_NAME_LEN = 48
MESSAGE_NAME_FMT = "message%04d.txt"
THREAD_NAME_FMT = "thread%04d"
EXPORT_PREFIX = "export "
SUMMARY_PREFIX = "summary "


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def message_filename(num) -> Column:
    """message%04d.txt (wider numbers are not cut)."""
    return F.format_string(MESSAGE_NAME_FMT, _c(num).cast("long"))


def sanitize_for_filename(col) -> Column:
    """ASCII strip, then each forbidden character becomes one '_'."""
    return F.regexp_replace(strip_non_ascii(_c(col)), FORBIDDEN_NAME_CHARS_RE, "_")


def thread_filename(subject, thread_num, prefix: str) -> Column:
    """``<prefix><name>.txt``; name = subject, or thread%04d when the
    subject is NULL/empty or sanitizes to nothing; cut at 48 characters."""
    fallback = F.format_string(THREAD_NAME_FMT, _c(thread_num).cast("long"))
    subj = _c(subject)
    base = F.when(F.length(F.coalesce(subj, F.lit(""))) > 0, subj).otherwise(fallback)
    clean = F.substring(sanitize_for_filename(base), 1, MAX_NAME_LEN)
    clean = F.when(F.length(clean) == 0, fallback).otherwise(clean)
    return F.concat(F.lit(prefix), clean, F.lit(".txt"))


def export_filename(subject, thread_num) -> Column:
    return thread_filename(subject, thread_num, EXPORT_PREFIX)


def summary_filename(subject, thread_num) -> Column:
    return thread_filename(subject, thread_num, SUMMARY_PREFIX)
