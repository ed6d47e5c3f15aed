"""Best-effort parse of a mail Date header (the reference keeps it as text).

Used only by the opt-in chronological order (O2) and the date-range filter (E2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts, tried in order after the weekday and a "(TZ)" comment are removed.
DATE_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_mail_date(col) -> Column:
    s = F.regexp_replace(_c(col), r"^\s*[A-Za-z]{3},\s*", "")
    s = F.trim(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", ""))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATE_FORMATS])
