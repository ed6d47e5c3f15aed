"""Views that map the driver tables onto the engine's schemas.

* email view over ``conversations`` (one message per turn): null subjects,
  case variants of one subject, forbidden file-name characters, colliding file
  names and null / tied dates all occur, so every thread operator has work.
* request log over ``events``: one row per event, back-end chosen by user.

The same mappings are written as DuckDB SQL in :mod:`mailspark.plans.sqlparts`
(email view) and :mod:`mailspark.plans.usage` (request log).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import add_sequence_by_key
from ..operators.usage import FALLBACK_PRIORITY

# The ten back-ends, listed in fallback priority order.
BACKENDS_BY_PRIORITY = FALLBACK_PRIORITY


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def email_columns(conv: DataFrame) -> DataFrame:
    """Map conversation turns to (from_addr, subject, date, body) - no numbering."""
    cid, turn = F.col("conv_id"), F.col("turn")
    subject = (
        F.when(cid % 5 == 0, F.lit(None).cast("string"))
        .when(cid % 5 == 1, F.concat(F.lit("Topic "), (cid % 10).cast("string")))
        .when(cid % 5 == 2, F.concat(F.lit("TOPIC "), ((cid - 1) % 10).cast("string")))
        .when(cid % 5 == 3, F.concat(F.lit("Plan: a/b? "), (cid % 4).cast("string")))
        .otherwise(F.concat(F.lit("Plan_ a_b_ "), (cid % 4).cast("string")))
    )
    date = F.when(turn % 7 == 6, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("2024-01-"), F.lpad((turn % 28 + 1).cast("string"), 2, "0"))
    )
    return conv.select(
        cid,
        turn,
        F.concat(F.col("role"), F.lit("@example.com")).alias("from_addr"),
        subject.alias("subject"),
        date.alias("date"),
        F.col("text").alias("body"),
    )


def email_view(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Emails numbered 1.. in (conv_id, turn) order (two-phase W1).

    Numbering needs a range shuffle and a materialised table, so queries that
    never look at ``msg_seq`` (searches, thread sizes) ask for
    ``numbered=False`` and stay a single scan.
    """
    emails = email_columns(read_table(spark, sf_dir, "conversations"))
    return add_sequence_by_key(emails, ["conv_id", "turn"], "msg_seq") if numbered else emails


def llm_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return llm_log_from_events(read_table(spark, sf_dir, "events"))


def llm_log_from_events(ev: DataFrame) -> DataFrame:
    """Request log: backend by user, success unless the event is an error,
    tokens from ``props.k``, response time from ``value`` (missing on every
    17th event, which makes such a success count as a failure in B4).
    Works on batch and streaming DataFrames alike."""
    names = F.array(*[F.lit(b) for b in BACKENDS_BY_PRIORITY])
    return ev.select(
        F.col("event_id"),
        F.get(names, (F.col("user_id") % len(BACKENDS_BY_PRIORITY)).cast("int")).alias("backend"),
        F.col("ts"),
        (F.col("event_type") != F.lit("error")).alias("success"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("response_time"),
        F.col("event_type"),
        F.col("user_id"),
    )
