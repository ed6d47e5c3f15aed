"""ST1/ST2: incremental archive loading and running counts.

ST1 - new MBOX files dropped in a folder become new email rows.  The file
source lists new files per micro-batch (``maxFilesPerTrigger`` bounds a batch);
each batch is parsed with the batch code (first/last record per file,
Catalyst parse) inside ``foreachBatch``, numbered after everything already
loaded, and written to ``<emails_dir>/batch_id=<n>`` with overwrite of that
one folder, so a replayed batch replaces itself (exactly-once output).

ST2 - a second stream reads the emails table and keeps running thread sizes
and search counts (streaming aggregation in ``update`` mode; ``state.py`` keeps
only the groups that a batch changed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators.search import match
from ..operators.threads import thread_key
from ..session import drop_path
from ..sources.mbox import MboxFile, _canonical_uri, _canonical_uri_col, load_records, parsed_records
from .state import read_state, write_state

EMAILS_STREAM_SCHEMA = "file_path string, file_ordinal int, msg_seq long, from_addr string, subject string, date string, body string, batch_id long"


def manifest_dir(emails_dir: str) -> str:
    """One small table per batch: its files with their messages and lines (S11).  Readers of the emails skip it."""
    return f"{emails_dir.rstrip('/')}/_files"


TOTALS_SCHEMA = "n_messages long, n_files int"


def totals_dir(emails_dir: str) -> str:
    """Messages and files loaded so far: one row, which each batch replaces.  Readers of the emails skip it."""
    return f"{emails_dir.rstrip('/')}/_totals"


def _previous(spark: SparkSession, emails_dir: str, batch_id: int) -> tuple[int, int]:
    """(messages, files) loaded by earlier batches: the row that the last one left."""
    row = read_state(spark, totals_dir(emails_dir), TOTALS_SCHEMA, batch_id).first()
    return (int(row["n_messages"]), int(row["n_files"])) if row else (0, 0)


def _process_batch(emails_dir: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        # The archives are read once; the batch's files (bounded by maxFilesPerTrigger) come from the written records.
        raw = batch.select("rec", "file_uri", "file_size", "block", F.monotonically_increasing_id().alias("rid"))
        parsed = parsed_records(raw)
        listed = sorted((r[0], r[1]) for r in parsed.select("file_uri", "file_size").distinct().collect())
        if not listed:
            drop_path(spark, parsed._scratch_path)
            return
        n_prev, f_prev = _previous(spark, emails_dir, batch_id)
        files = []
        for i, (uri, size) in enumerate(listed):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()  # as batch loads name it
            files.append(MboxFile(f_prev + i + 1, path, path, _canonical_uri(uri), size))
        load = load_records(parsed, files, start=n_prev)
        out = f"{emails_dir.rstrip('/')}/batch_id={batch_id}"
        load.emails.select(*[f.name for f in schema.EMAILS.fields]).write.mode("overwrite").parquet(out)
        load.report.coalesce(1).write.mode("overwrite").parquet(f"{manifest_dir(emails_dir)}/batch_id={batch_id}")
        totals = spark.createDataFrame([(n_prev + load.n_messages, f_prev + len(files))], TOTALS_SCHEMA)
        write_state(totals, totals_dir(emails_dir), batch_id)
        load.close()

    return run


def start_archive_stream(
    spark: SparkSession,
    source_dir: str,
    emails_dir: str,
    checkpoint_dir: str,
    max_files_per_trigger: int = 1000,
    available_now: bool = True,
) -> StreamingQuery:
    """ST1: load every new MBOX file of ``source_dir`` into ``emails_dir``.

    ``max_files_per_trigger`` bounds a micro-batch, and with it the file list
    the batch function reads on the driver."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.option("lineSep", "\nFrom ").text(source_dir).select(
        F.col("value").alias("rec"),
        _canonical_uri_col(F.col("_metadata.file_path")).alias("file_uri"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
    )
    w = src.writeStream.foreachBatch(_process_batch(emails_dir)).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def emails_stream(spark: SparkSession, emails_dir: str) -> DataFrame:
    return spark.readStream.schema(EMAILS_STREAM_SCHEMA).parquet(emails_dir)


def running_thread_sizes(emails: DataFrame) -> DataFrame:
    """ST2: messages per thread so far."""
    return emails.groupBy(thread_key("subject").alias("thread_key")).agg(F.count(F.lit(1)).alias("n_messages"))


def running_search_counts(emails: DataFrame, searches) -> DataFrame:
    """ST2: counts of the searches so far ((name, field, keyword) triples)."""
    return emails.agg(*[F.count_if(match(field, kw)).alias(name) for name, field, kw in searches])


__all__ = [
    "EMAILS_STREAM_SCHEMA",
    "emails_stream",
    "running_search_counts",
    "running_thread_sizes",
    "start_archive_stream",
]
