"""Subject threads: grouping, first/last picks, sentences, numbering.

A thread is every message whose lower-cased subject is equal; a missing and
an empty subject both fall in thread ``""``.  Threads are never materialised as
lists: every per-thread value is a mergeable aggregate (``count``, ``min``,
``min_by``/``max_by``), so Spark aggregates partially before the shuffle and a
thread that holds a third of all mail costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_mail_date
from ..functions.text import first_sentence_thread_form, last_sentence
from .numbering import add_group_position, add_sequence

STRING_ORDER = "string"
CHRONOLOGICAL_ORDER = "chronological"


def thread_key(subject="subject") -> Column:
    """A3: lower(subject), NULL -> ''."""
    s = F.col(subject) if isinstance(subject, str) else subject
    return F.coalesce(F.lower(s), F.lit(""))


def order_columns(order: str = STRING_ORDER) -> list[Column]:
    """O1/O2 sort inside a thread: date NULLS FIRST, ties by load order."""
    if order == STRING_ORDER:
        d = F.col("date")
    elif order == CHRONOLOGICAL_ORDER:
        d = parse_mail_date("date")
    else:
        raise ValueError(f"unknown order {order!r}")
    return [d.isNotNull(), d, F.col("msg_seq")]


def order_key(order: str = STRING_ORDER) -> Column:
    """The O1/O2 order as one comparable struct (no NULL fields inside)."""
    if order == STRING_ORDER:
        d, filler = F.col("date"), F.lit("")
    elif order == CHRONOLOGICAL_ORDER:
        d, filler = parse_mail_date("date"), F.lit("1970-01-01 00:00:00").cast("timestamp")
    else:
        raise ValueError(f"unknown order {order!r}")
    return F.struct(d.isNotNull().alias("has_date"), F.coalesce(d, filler).alias("d"), F.col("msg_seq").alias("seq"))


def with_thread_key(emails: DataFrame) -> DataFrame:
    return emails.withColumn("thread_key", thread_key("subject"))


def thread_sizes(emails: DataFrame) -> DataFrame:
    """A3/A5: messages per thread."""
    return with_thread_key(emails).groupBy("thread_key").agg(F.count(F.lit(1)).alias("n_messages"))


def thread_count(emails: DataFrame) -> DataFrame:
    """A4: number of threads (one row)."""
    return emails.select(thread_key("subject").alias("thread_key")).agg(
        F.count_distinct("thread_key").alias("n_threads")
    )


def thread_aggregates(emails: DataFrame, order: str = STRING_ORDER) -> DataFrame:
    """A5-A8 per thread, one shuffle of partial aggregates on ``thread_key``.

    * first/last message (A6) by ``min_by``/``max_by`` over the sort key;
    * first sentence (A7): the first message in order that has a piece longer
      than the limit gives it (trimmed, possibly empty);
    * last sentence (A8): the last message that has a trimmed piece longer than
      the limit gives it.
    """
    k = order_key(order)
    rows = emails.select(
        thread_key("subject").alias("thread_key"),
        "msg_seq",
        k.alias("_k"),
        F.struct("subject", "from_addr", "date").alias("_m"),
        first_sentence_thread_form("body").alias("_fs"),
        last_sentence("body").alias("_ls"),
    )
    agg = rows.groupBy("thread_key").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min("msg_seq").alias("first_seq"),
        F.min_by("_m", "_k").alias("_first"),
        F.max_by("_m", "_k").alias("_last"),
        F.min_by("_fs", F.when(F.col("_fs").isNotNull(), F.col("_k"))).alias("_fs"),
        F.max_by("_ls", F.when(F.col("_ls") != "", F.col("_k"))).alias("_ls"),
    )
    return agg.select(
        "thread_key",
        "first_seq",
        "n_messages",
        F.coalesce(F.col("_first.subject"), F.lit("")).alias("subject"),
        F.col("_first.from_addr").alias("from_first"),
        F.col("_first.date").alias("date_first"),
        F.col("_last.from_addr").alias("from_last"),
        F.col("_last.date").alias("date_last"),
        F.coalesce("_fs", F.lit("")).alias("first_sentence"),
        F.coalesce("_ls", F.lit("")).alias("last_sentence"),
    )


def threads(emails: DataFrame, order: str = STRING_ORDER) -> DataFrame:
    """Thread table with W3 numbers (order of each thread's first message)."""
    return thread_aggregates(emails, order).join(thread_numbers(emails), "thread_key")


def thread_numbers(emails: DataFrame) -> DataFrame:
    """(thread_key, thread_num); only keys and numbers are sorted and written."""
    first = emails.groupBy(thread_key("subject").alias("thread_key")).agg(F.min("msg_seq").alias("first_seq"))
    return add_sequence(first, ["first_seq"], "thread_num").select("thread_key", "thread_num")


def thread_positions(emails: DataFrame, order: str = STRING_ORDER, per_thread: DataFrame | None = None) -> DataFrame:
    """1-based number of each message inside its thread, in O1/O2 order.

    Works on the keys only (msg_seq, thread_key, date): the numbering
    materialises this narrow table, never the message bodies.  Join the result
    back on the unique ``msg_seq`` for full rows.  ``per_thread`` (thread_key and
    others) adds its columns; messages of other threads are left out.
    """
    keys = emails.select("msg_seq", thread_key("subject").alias("thread_key"), "date")
    return add_group_position(keys, ["thread_key"], order_columns(order), "position", per_group=per_thread)
