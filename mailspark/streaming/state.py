"""What a stream's batches keep for one another, as tables in the stream's output folder.

A *state* is a small table that each batch writes whole under its own number; the next
batch reads that one and no other, and older ones are removed, so the thousandth batch
reads as much as the second.  A replayed batch finds the state before it and replaces its
own.  A *change log* holds, batch by batch, only the groups of a running aggregate that
changed (update mode); reading it keeps each group's last row, ``compact`` puts the
earlier batches together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import drop_path


def batch_numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that have a table there, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))


def read_state(spark: SparkSession, folder: str, schema: str, batch_id: int) -> DataFrame:
    """The state that the batch before ``batch_id`` left; empty if there was none."""
    earlier = [n for n in batch_numbers(spark, folder) if n < batch_id]
    if not earlier:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch_id={earlier[-1]}")


def write_state(state: DataFrame, folder: str, batch_id: int) -> None:
    """The state after ``batch_id``; the one before it stays for a replay, older ones go."""
    spark = state.sparkSession
    state.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
    for old in [n for n in batch_numbers(spark, folder) if n < batch_id][:-1]:
        drop_path(spark, f"{folder}/batch_id={old}")


def start_change_log(running: DataFrame, out_dir: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Write the groups of a running aggregate that each batch changed."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = running.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_change_log(spark: SparkSession, out_dir: str, running: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each group's last row; ``running`` is the aggregate that the log was written from."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in running.schema.fields]
    log = spark.read.schema(", ".join([*fields, "batch_id long"])).parquet(out_dir)
    values = [c for c in running.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("last")) if keys else log.agg(
        F.max_by(F.struct(*values), "batch_id").alias("last")
    )
    return last.select(*keys, "last.*").select(*running.columns)


def compact(spark: SparkSession, out_dir: str, running: DataFrame, keys: Sequence[str]) -> None:
    """Put all batches of a change log together as the last of them; the stream must not be running.

    The merged table is written beside the log first, so that a failure loses nothing: it holds
    the same rows, and reading both gives the same result."""
    numbers = batch_numbers(spark, out_dir)
    if len(numbers) < 2:
        return
    whole = read_change_log(spark, out_dir, running, keys)
    merged = f"{out_dir}/_merged"
    whole.write.mode("overwrite").parquet(merged)
    rows = spark.read.schema(whole.schema).parquet(merged)
    rows.write.mode("overwrite").parquet(f"{out_dir}/batch_id={numbers[-1]}")
    for old in numbers[:-1]:
        drop_path(spark, f"{out_dir}/batch_id={old}")
    drop_path(spark, merged)
