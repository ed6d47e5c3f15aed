"""Registered queries that write real files and read them back: archives loaded from
files (S1-S5, S11, P1-P12), the three exports (S6-S10, N5, A9) and the archive and
usage streams (ST1-ST4, run with ``availableNow``).

All folders lie in the shared checkpoint folder and go when the driver process ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import materialize
from ..session import remember_scratch, scratch_path
from ..sources.exports import export_messages, export_summaries, export_table, export_threads, read_table_export
from ..sources.mbox import MboxLoad, load_mbox
from ..sources.views import email_view, llm_log_from_events
from ..streaming.archive import emails_stream, running_search_counts, running_thread_sizes, start_archive_stream
from ..streaming.state import read_change_log, start_change_log
from ..streaming.usage import read_changes, running_usage_stats, start_availability_stream
from . import sqlparts as Q
from .mail import RENDER_MESSAGES_SQL, RENDER_THREADS_SQL, THREAD_SUMMARIES_SQL
from .mbox import ARCHIVES_SQL, rendered_archives
from .usage import AVAILABILITY_CHANGES_SQL, LOG_SQL

#: Conversations of one archive file.
PER_FILE = 16


def _folder(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    remember_scratch(spark, path)
    return path


def write_archives(spark: SparkSession, sf: str) -> str:
    """One file for each ``PER_FILE`` conversations; returns the folder."""
    out = _folder(spark, "archives")
    a = rendered_archives(spark, sf).select(
        F.lpad(F.floor(F.col("conv_id") / PER_FILE).cast("string"), 12, "0").alias("f"),
        "conv_id",
        "turn",
        F.regexp_replace("archive", r"\n\z", "").alias("value"),  # the writer ends each row with a line feed
    )
    a.repartition("f").sortWithinPartitions("f", "conv_id", "turn").select("f", "value").write.partitionBy("f").text(out)
    return out


def _load(spark: SparkSession, sf: str) -> MboxLoad:
    """An empty file, all archive files in name order, and the first of them again."""
    folder = write_archives(spark, sf)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    empty = jvm.org.apache.hadoop.fs.Path(f"{folder}/empty.mbox")
    empty.getFileSystem(conf).create(empty).close()
    first = jvm.org.apache.hadoop.fs.Path(f"{folder}/f=*/*.txt")
    again = min(s.getPath().toString() for s in first.getFileSystem(conf).globStatus(first))
    return load_mbox(spark, [f"{folder}/empty.mbox", f"{folder}/f=*/*.txt", again])


def mbox_load_files(spark: SparkSession, sf: str) -> DataFrame:
    return _load(spark, sf).emails.select("msg_seq", "file_ordinal", "from_addr", "subject", "date", "body")


def mbox_missing_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths, globs and folders that are not there give no rows and stop nothing."""
    folder = write_archives(spark, sf)
    paths = [f"{folder}/absent.mbox", f"{folder}/f=*/*.txt", f"{folder}/none-*/*.mbox", f"{folder}/absent/"]
    return load_mbox(spark, paths).emails.select("msg_seq", "file_ordinal", "from_addr", "subject", "date", "body")


def mbox_load_report(spark: SparkSession, sf: str) -> DataFrame:
    return _load(spark, sf).report.drop("file_path")


# The parse SQL over whole files: the first file stands at 2, after the empty one, and again at the end.
_FILES_SQL = ARCHIVES_SQL.replace(
    "parts AS (SELECT conv_id, turn, string_split(archive",
    f"""grouped AS (
  SELECT conv_id // {PER_FILE} AS f, string_agg(CASE WHEN suffix(archive, chr(10)) THEN archive ELSE archive || chr(10) END, '' ORDER BY conv_id, turn) AS archive
  FROM archives GROUP BY 1),
ranked AS (SELECT row_number() OVER (ORDER BY f) + 1 AS conv_id, 0 AS turn, archive FROM grouped),
files AS (SELECT * FROM ranked UNION ALL SELECT (SELECT max(conv_id) FROM ranked) + 1, 0, archive FROM ranked WHERE conv_id = 2),
parts AS (SELECT conv_id, turn, string_split(archive""",
).replace("FROM archives)", "FROM files)")
MBOX_LOAD_FILES_SQL = f"""WITH {_FILES_SQL}
SELECT row_number() OVER (ORDER BY conv_id, msg_index) AS msg_seq, conv_id::INTEGER AS file_ordinal, from_addr, subject, date, body FROM parsed WHERE kept"""
MBOX_MISSING_PATHS_SQL = f"""SELECT msg_seq, (file_ordinal - 1)::INTEGER AS file_ordinal, from_addr, subject, date, body FROM ({MBOX_LOAD_FILES_SQL})
WHERE file_ordinal <= (WITH e AS ({Q.EMAIL_VIEW}) SELECT count(DISTINCT conv_id // {PER_FILE}) + 1 FROM e)"""
MBOX_LOAD_REPORT_SQL = f"""WITH {_FILES_SQL}
SELECT 1::INTEGER AS file_ordinal, 0::BIGINT AS n_messages, 0::BIGINT AS n_lines
UNION ALL SELECT conv_id::INTEGER, count(*) FILTER (WHERE kept), sum(n_lines)::BIGINT FROM parsed GROUP BY conv_id"""


def _digest(spark: SparkSession, folder: str) -> DataFrame:
    """What each exported file holds: its lines with their places (a huge file is read in many splits)."""
    name = F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("lineSep", "\n").text(folder).select(
        name.alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    # a split's lines are numbered one after another; one row per split tells how many lines stand before it
    splits = lines.groupBy("file_name", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "digest-splits")
    placed = lines.join(splits, ["file_name", "block"]).withColumn("line_no", F.col("at") - F.col("first") + F.col("before") + 1)
    return placed.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.octet_length("value") + 1).cast("long").alias("n_bytes"),
        F.sum(_line_number(F.concat_ws(":", "line_no", "value"))).alias("digest"),
    )


def _line_number(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _digest_sql(documents: str) -> str:
    """documents: SQL of (file_name, content)."""
    return f"""
WITH doc AS ({documents}),
t AS (SELECT file_name, string_split(CASE WHEN suffix(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS x FROM doc),
l AS (SELECT file_name, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS k FROM t)
SELECT file_name, count(*) AS n_lines, sum(strlen(s) + 1)::BIGINT AS n_bytes,
       sum(('0x' || left(md5(k || ':' || s), 8))::BIGINT)::BIGINT AS digest FROM l GROUP BY file_name"""


def export_messages_files(spark: SparkSession, sf: str) -> DataFrame:
    out = _folder(spark, "export-messages")
    export_messages(email_view(spark, sf), out)
    return _digest(spark, out)


def export_threads_files(spark: SparkSession, sf: str) -> DataFrame:
    out = _folder(spark, "export-threads")
    export_threads(email_view(spark, sf), out)
    return _digest(spark, out)


def export_summaries_files(spark: SparkSession, sf: str) -> DataFrame:
    out = _folder(spark, "export-summaries")
    export_summaries(email_view(spark, sf), out)
    return _digest(spark, out)


def export_replaced_files(spark: SparkSession, sf: str) -> DataFrame:
    """Messages written over earlier ones of the same names; the summaries beside them stay."""
    out, emails = _folder(spark, "export-replaced"), email_view(spark, sf)
    export_summaries(emails, out)
    export_messages(emails.withColumn("body", F.concat(F.lit("earlier\n"), F.repeat("body", 2))), out)
    export_messages(emails, out)
    return _digest(spark, out)


EXPORT_MESSAGES_FILES_SQL = _digest_sql(f"SELECT file_name, content FROM ({RENDER_MESSAGES_SQL})")
EXPORT_THREADS_FILES_SQL = _digest_sql(
    f"""SELECT file_name, string_agg(piece, '' ORDER BY position) AS content FROM ({RENDER_THREADS_SQL}) p
WHERE (file_name, thread_num) IN (SELECT file_name, max(thread_num) FROM ({RENDER_THREADS_SQL}) GROUP BY file_name) GROUP BY file_name"""
)
EXPORT_SUMMARIES_FILES_SQL = _digest_sql(f"SELECT file_name, max_by(content, thread_num) AS content FROM ({THREAD_SUMMARIES_SQL}) GROUP BY file_name")

EXPORT_REPLACED_FILES_SQL = f"{EXPORT_MESSAGES_FILES_SQL} UNION ALL SELECT * FROM ({EXPORT_SUMMARIES_FILES_SQL})"


def _table_export(spark: SparkSession, sf: str, form: str) -> DataFrame:
    emails = email_view(spark, sf).select("msg_seq", "from_addr", "subject", "date", "body")
    out = _folder(spark, f"export-{form}")
    export_table(emails, out, form)
    return read_table_export(spark, out, emails.schema, form)


def export_json_files(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as JSON lines, read back."""
    return _table_export(spark, sf, "json")


def export_csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as CSV, read back."""
    return _table_export(spark, sf, "csv")


EXPORT_TABLE_SQL = f"WITH emails AS ({Q.EMAIL_VIEW}) SELECT msg_seq, from_addr, subject, date, body FROM emails"


# ---------------------------------------------------------------------- streams
def _streamed_emails(spark: SparkSession, sf: str) -> str:
    """ST1: the archive files as a stream, in micro-batches of the loader's own size; the folder of the emails.

    A micro-batch costs some ten jobs however little it holds, so their number must not follow that of small files."""
    emails = _folder(spark, "stream-emails")
    source = f"{write_archives(spark, sf)}/f=*"
    start_archive_stream(spark, source, emails, _folder(spark, "stream-state")).awaitTermination()
    return emails


def _ended(stream: DataFrame, spark: SparkSession, name: str, *keys: str) -> DataFrame:
    """The last result of a running aggregate, from the log of the groups that each batch changed."""
    out = _folder(spark, name)
    start_change_log(stream, out, _folder(spark, f"{name}-state")).awaitTermination()
    return read_change_log(spark, out, stream, keys)


def stream_load(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: the streamed messages.  Files are numbered as they arrive, so the numbers are not compared."""
    from ..streaming.archive import EMAILS_STREAM_SCHEMA

    e = spark.read.schema(EMAILS_STREAM_SCHEMA).parquet(_streamed_emails(spark, sf))
    return e.groupBy("from_addr", "subject", "date", "body").agg(F.count(F.lit(1)).alias("n"))


def stream_thread_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: running thread sizes over the streamed emails."""
    return _ended(running_thread_sizes(emails_stream(spark, _streamed_emails(spark, sf))), spark, "stream-threads", "thread_key")


_SEARCHES = [("n_topic", "subject", "topic 1"), ("n_the", "body", "the")]


def stream_search_counts(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: running search counts over the streamed emails."""
    return _ended(running_search_counts(emails_stream(spark, _streamed_emails(spark, sf)), _SEARCHES), spark, "stream-search")


_STREAMED_SQL = ARCHIVES_SQL.replace(
    "parts AS (SELECT conv_id, turn, string_split(archive",
    f"""files AS (
  SELECT conv_id // {PER_FILE} AS conv_id, 0 AS turn, string_agg(CASE WHEN suffix(archive, chr(10)) THEN archive ELSE archive || chr(10) END, '' ORDER BY archives.conv_id, archives.turn) AS archive
  FROM archives GROUP BY archives.conv_id // {PER_FILE}),
parts AS (SELECT conv_id, turn, string_split(archive""",
).replace("FROM archives)", "FROM files)")
STREAM_LOAD_SQL = f"WITH {_STREAMED_SQL} SELECT from_addr, subject, date, body, count(*) AS n FROM parsed WHERE kept GROUP BY ALL"
STREAM_THREAD_SIZES_SQL = f"WITH {_STREAMED_SQL} SELECT coalesce(lower(subject), '') AS thread_key, count(*) AS n_messages FROM parsed WHERE kept GROUP BY 1"
STREAM_SEARCH_COUNTS_SQL = f"""WITH {_STREAMED_SQL}
SELECT count(*) FILTER (WHERE {Q.contains_ci('subject', 'topic 1')}) AS n_topic, count(*) FILTER (WHERE {Q.contains_ci('body', 'the')}) AS n_the FROM parsed WHERE kept"""


def _event_log(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of request logs."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return llm_log_from_events(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))


def stream_usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    """ST3: running usage statistics."""
    return _ended(running_usage_stats(_event_log(spark, sf)), spark, "stream-usage", "backend")


STREAM_USAGE_STATS_SQL = f"""WITH {LOG_SQL}
SELECT backend, count(*) AS total_attempts, count(*) FILTER (WHERE success AND response_time IS NOT NULL) AS successful_attempts,
       CAST(sum(tokens) FILTER (WHERE success) AS BIGINT) AS total_tokens, count(*) FILTER (WHERE success) AS total_requests,
       CAST(sum(tokens * price) FILTER (WHERE success) AS DOUBLE) / 1000000.0 AS total_cost,
       CAST(sum(CAST(response_time AS DECIMAL(38,10))) FILTER (WHERE success) AS DOUBLE) / count(response_time) FILTER (WHERE success) AS average_latency,
       max(ts) FILTER (WHERE success) AS last_used
FROM priced GROUP BY backend"""


def stream_availability(spark: SparkSession, sf: str) -> DataFrame:
    """ST4: availability changes, written batch by batch."""
    out = _folder(spark, "stream-availability")
    snapshots = _event_log(spark, sf).select("backend", "ts", "event_id", F.col("success").alias("available"))
    start_availability_stream(snapshots, out, _folder(spark, "stream-availability-state")).awaitTermination()
    return read_changes(spark, out)


QUERIES = {
    "mbox_load_files": mbox_load_files,
    "mbox_load_report": mbox_load_report,
    "mbox_missing_paths": mbox_missing_paths,
    "export_messages_files": export_messages_files,
    "export_threads_files": export_threads_files,
    "export_summaries_files": export_summaries_files,
    "export_replaced_files": export_replaced_files,
    "export_json_files": export_json_files,
    "export_csv_files": export_csv_files,
    "stream_load": stream_load,
    "stream_thread_sizes": stream_thread_sizes,
    "stream_search_counts": stream_search_counts,
    "stream_usage_stats": stream_usage_stats,
    "stream_availability": stream_availability,
}
ORACLE_SQL = {
    "mbox_load_files": MBOX_LOAD_FILES_SQL,
    "mbox_load_report": MBOX_LOAD_REPORT_SQL,
    "mbox_missing_paths": MBOX_MISSING_PATHS_SQL,
    "export_messages_files": EXPORT_MESSAGES_FILES_SQL,
    "export_threads_files": EXPORT_THREADS_FILES_SQL,
    "export_summaries_files": EXPORT_SUMMARIES_FILES_SQL,
    "export_replaced_files": EXPORT_REPLACED_FILES_SQL,
    "export_json_files": EXPORT_TABLE_SQL,
    "export_csv_files": EXPORT_TABLE_SQL,
    "stream_load": STREAM_LOAD_SQL,
    "stream_thread_sizes": STREAM_THREAD_SIZES_SQL,
    "stream_search_counts": STREAM_SEARCH_COUNTS_SQL,
    "stream_usage_stats": STREAM_USAGE_STATS_SQL,
    "stream_availability": AVAILABILITY_CHANGES_SQL,
}
