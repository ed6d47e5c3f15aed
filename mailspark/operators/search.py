"""Case-insensitive searches and counts.

A count is a filter plus ``count`` (partial count per task, one row per task
through the exchange); several keywords share one scan with ``count_if``.
On a Parquet emails table Spark reads only the searched column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_mail_date
from ..functions.text import contains_ci, regex_match

# Command names of the reference mapped to the searched field.
SEARCH_FIELDS = {"from": "from_addr", "subject": "subject", "count": "body"}


def match(field: str, keyword: str, unicode_equal: bool = False) -> Column:
    """Predicate of one search command (``from``/``subject``/``count`` or a column)."""
    return contains_ci(SEARCH_FIELDS.get(field, field), keyword, unicode_equal)


def search(emails: DataFrame, field: str, keyword: str, unicode_equal: bool = False) -> DataFrame:
    """Matching messages; ``search(...).count()`` is the command's answer."""
    return emails.filter(match(field, keyword, unicode_equal))


def search_count(emails: DataFrame, field: str, keyword: str, name: str = "n", unicode_equal: bool = False) -> DataFrame:
    """One-row count of messages matching (emails, not occurrences)."""
    return emails.agg(F.count_if(match(field, keyword, unicode_equal)).alias(name))


def multi_counts(emails: DataFrame, searches: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A1: several (name, field, keyword) counts in one pass."""
    return emails.agg(*[F.count_if(match(field, kw)).alias(name) for name, field, kw in searches])


def total(emails: DataFrame, name: str = "n_emails") -> DataFrame:
    """A2: session total."""
    return emails.agg(F.count(F.lit(1)).alias(name))


def regex_search(emails: DataFrame, field: str, pattern: str) -> DataFrame:
    """Regular-expression search on one field."""
    return emails.filter(regex_match(SEARCH_FIELDS.get(field, field), pattern))


def date_between(start: str | None, end: str | None) -> Column:
    """Parsed Date header within [start, end]; unparsable dates never match."""
    d = parse_mail_date("date")
    cond = d.isNotNull()
    if start is not None:
        cond = cond & (d >= F.to_timestamp(F.lit(start)))
    if end is not None:
        cond = cond & (d <= F.to_timestamp(F.lit(end)))
    return cond


def any_of(*preds: Column) -> Column:
    """E5: OR of field predicates."""
    out = F.lit(False)
    for p in preds:
        out = out | p
    return out


def all_of(*preds: Column) -> Column:
    """E5: AND of field predicates."""
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out
