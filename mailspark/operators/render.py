"""Document rendering (R1-R3): per-message, per-thread and summary texts.

Thread documents are produced as *ordered pieces* - one row per message with
its file name and position - never as one concatenated string, so a huge
thread is never gathered in one row; the file sink streams the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filenames import export_filename, message_filename, summary_filename
from ..functions.text import strip_non_ascii
from .threads import STRING_ORDER, thread_positions, threads

# Fixed texts of the documents.
THREAD_PIECE_HEADER = "----- Email #%d -----\n"
UNKNOWN = "unknown"


def _x2(c: Column, default: str = "") -> Column:
    return strip_non_ascii(F.coalesce(c, F.lit(default)))


def message_text() -> Column:
    """``From:``/``Subject:``/``Date:`` lines, blank line, body - all ASCII-stripped."""
    return F.concat(
        F.lit("From: "), _x2(F.col("from_addr")), F.lit("\n"),
        F.lit("Subject: "), _x2(F.col("subject")), F.lit("\n"),
        F.lit("Date: "), _x2(F.col("date")), F.lit("\n\n"),
        _x2(F.col("body")),
    )


def render_messages(emails: DataFrame) -> DataFrame:
    """S6 content: one (file_name, content) per message, numbered by msg_seq."""
    return emails.select(
        "msg_seq",
        message_filename("msg_seq").alias("file_name"),
        message_text().alias("content"),
    )


def render_thread_pieces(emails: DataFrame, order: str = STRING_ORDER, latest_only: bool = False) -> DataFrame:
    """One piece per message: ``----- Email #k -----`` + R1 + blank line.

    A thread's file is its pieces concatenated in ``position`` order.  With
    ``latest_only`` threads whose file name is taken by a later thread (N5)
    are dropped on the thread table (one row per thread) before the join, so
    the messages are never shuffled for it.
    """
    t = threads(emails, order).select(
        "thread_key", "thread_num", export_filename("subject", "thread_num").alias("file_name")
    )
    if latest_only:
        from ..sources.named_files import safe_name

        t = t.withColumn("file_name", safe_name(F.col("file_name")))
        top = t.groupBy(F.col("file_name").alias("_n")).agg(F.max("thread_num").alias("_v"))
        t = t.join(top, (t["file_name"] == top["_n"]) & (t["thread_num"] == top["_v"]), "left_semi")
    # Thread number and name come with the position, one row per (range, thread), so no
    # join has a hot thread as its key; the bodies are joined once on the unique msg_seq.
    keys = thread_positions(emails, order, per_thread=t).drop("thread_key", "date")
    joined = emails.join(keys, "msg_seq")
    return joined.select(
        "file_name",
        "thread_num",
        "position",
        "msg_seq",
        F.concat(F.format_string(THREAD_PIECE_HEADER, F.col("position")), message_text(), F.lit("\n\n")).alias(
            "piece"
        ),
    )


def summary_text() -> Column:
    """R3 over a thread row (columns of :func:`threads`)."""
    first, last = F.col("first_sentence"), F.col("last_sentence")
    began = F.when(F.length(first) > 0, F.concat(F.lit("Thread began: "), strip_non_ascii(first), F.lit("\n")))
    ended = F.when(
        (F.length(last) > 0) & (first != last),
        F.concat(F.lit("Thread ended: "), strip_non_ascii(last), F.lit("\n")),
    )
    return F.concat(
        F.lit("Subject: "), strip_non_ascii(F.col("subject")), F.lit("\n"),
        F.lit("Thread length: "), F.col("n_messages").cast("string"), F.lit(" message(s)\n"),
        F.lit("From: "), _x2(F.col("from_first"), UNKNOWN), F.lit(" ("), _x2(F.col("date_first"), UNKNOWN), F.lit(")\n"),
        F.lit("To:   "), _x2(F.col("from_last"), UNKNOWN), F.lit(" ("), _x2(F.col("date_last"), UNKNOWN), F.lit(")\n"),
        F.coalesce(began, F.lit("")),
        F.coalesce(ended, F.lit("")),
    )


def render_summaries(emails: DataFrame, order: str = STRING_ORDER) -> DataFrame:
    """S8 content: one (file_name, content) per thread."""
    t = threads(emails, order)
    return t.select(
        "thread_num",
        summary_filename("subject", "thread_num").alias("file_name"),
        summary_text().alias("content"),
    )


def filename_collisions(named: DataFrame, order_col: str = "thread_num") -> DataFrame:
    """For each output name, which document wins (the last written, i.e.
    highest ``order_col``) and how many earlier ones it silently replaces.

    Aggregates per file name (partial aggregation; a name shared by many
    documents is still one row per map task before the shuffle).
    """
    return named.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.max(order_col).alias("winner"),
        (F.count(F.lit(1)) - 1).alias("n_replaced"),
    )


def unique_filenames(named: DataFrame, order_col: str = "thread_num") -> DataFrame:
    """N5 opt-in: suffix every non-winning duplicate name with `` (n)`` so no
    document replaces another.  ``n`` counts earlier duplicates by ``order_col``."""
    from .numbering import add_group_position

    ranked = add_group_position(named, ["file_name"], [F.col(order_col).desc()], "_dup_rank")
    stem = F.regexp_replace("file_name", r"\.txt\z", "")
    renamed = F.when(F.col("_dup_rank") == 1, F.col("file_name")).otherwise(
        F.concat(stem, F.lit(" ("), (F.col("_dup_rank") - 1).cast("string"), F.lit(").txt"))
    )
    return ranked.withColumn("file_name", renamed).drop("_dup_rank")
