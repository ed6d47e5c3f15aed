"""B2 over appended logs, ST3/ST4: running usage statistics and availability changes over
a stream of request events.

B2 in its mutating form goes on over logs that arrive one after another: a log's requests
get their stats from the batch operator on top of the totals that the log before it left,
one row a back-end, and leave such totals for the next.  Requests count in the order of
their logs, and by time inside one.

ST3 is a plain streaming aggregation (partial aggregation per micro-batch,
state per back-end in the state store).  ST4 runs the batch operator
(``availability_changes``, balanced however many events one back-end has) on
each micro-batch, after one row per back-end that holds its last known state.
Each batch writes its changes and its late events under its own number with
overwrite, so a replayed batch replaces itself, and one state for all back-ends,
which is all that the next batch reads.  An event that is
older than the state of its back-end cannot be placed any more; it goes to the
table of late events, from which it can be counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import USAGE_TOTALS, availability_changes, exact_avg, price_per_million, usage_running, usage_totals
from .state import batch_numbers, read_state, write_state

SNAPSHOT_SCHEMA = "backend string, ts timestamp_ntz, event_id long, available boolean"
CHANGE_SCHEMA = SNAPSHOT_SCHEMA + ", status string"
RUNNING_SCHEMA = (
    "event_id long, backend string, ts timestamp_ntz, running_tokens long, running_requests long, running_cost double, "
    "running_avg_response_time double"
)


def append_usage(log: DataFrame, out_dir: str, batch_id: int) -> None:
    """B2: add the stats after each request of a log to the table in ``out_dir``, and the totals that the next log goes on from.

    A log that is appended again under its number replaces itself, if it was the last one.
    """
    spark, totals = log.sparkSession, f"{out_dir}/totals"
    carried = read_state(spark, totals, USAGE_TOTALS, batch_id)
    usage_running(log, carried=carried).write.mode("overwrite").parquet(f"{out_dir}/running/batch_id={batch_id}")
    write_state(usage_totals(log, carried), totals, batch_id)


def read_running(spark: SparkSession, out_dir: str) -> DataFrame:
    """The stats after each request of all logs appended so far."""
    return _read(spark, f"{out_dir}/running", RUNNING_SCHEMA).drop("batch_id")


def read_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """``USAGE_TOTALS`` after the last log."""
    last = max(batch_numbers(spark, f"{out_dir}/totals"), default=-1)
    return read_state(spark, f"{out_dir}/totals", USAGE_TOTALS, last + 1)


def start_usage_stream(log: DataFrame, out_dir: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """B2 over a stream: each micro-batch is a log that is appended."""
    folder = out_dir.rstrip("/")
    w = log.writeStream.foreachBatch(lambda batch, n: append_usage(batch, folder, n)).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def running_usage_stats(log: DataFrame) -> DataFrame:
    """ST3: B1 and B4 counters per back-end, updated every micro-batch."""
    ok = F.col("success") & F.col("response_time").isNotNull()
    return log.groupBy("backend").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(ok).alias("successful_attempts"),
        F.sum(F.when(F.col("success"), F.col("tokens"))).alias("total_tokens"),
        F.count_if("success").alias("total_requests"),
        (F.sum(F.when(F.col("success"), F.col("tokens") * price_per_million())).cast("double") / F.lit(1_000_000.0)).alias(
            "total_cost"
        ),
        exact_avg(F.when(ok, F.col("response_time"))).alias("average_latency"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("last_used"),
    )


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches of a table that a stream writes; none if it has not begun."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema + ", batch_id long")
    return spark.read.schema(schema + ", batch_id long").parquet(folder)


def read_changes(spark: SparkSession, out_dir: str) -> DataFrame:
    return _read(spark, f"{out_dir}/changes", CHANGE_SCHEMA).drop("batch_id")


def read_late(spark: SparkSession, out_dir: str) -> DataFrame:
    return _read(spark, f"{out_dir}/late", SNAPSHOT_SCHEMA).drop("batch_id")


def _change_batch(out_dir: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = F.struct("ts", "event_id")
        states = f"{out_dir}/states"
        state = read_state(spark, states, SNAPSHOT_SCHEMA, batch_id)
        known = state
        state = state.select("backend", order.alias("_at"), F.col("available").alias("_was"))
        events = batch.select("backend", "ts", "event_id", "available").join(F.broadcast(state), "backend", "left")
        events = events.withColumn("_late", F.coalesce(order <= F.col("_at"), F.lit(False)))
        fresh = events.where("not _late").select("backend", "ts", "event_id", "available")
        seeds = state.select("backend", "_at.ts", "_at.event_id", F.col("_was").alias("available"))
        both = fresh.withColumn("seed", F.lit(False)).unionByName(seeds.withColumn("seed", F.lit(True)))
        # a seed that is on looks like a change; it was reported before
        changes = availability_changes(both).join(F.broadcast(seeds.select("backend", "ts", "event_id")), ["backend", "ts", "event_id"], "left_anti")

        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch_id}")

        put(changes.select("backend", "ts", "event_id", "available", "status"), "changes")
        put(events.where("_late").select("backend", "ts", "event_id", "available"), "late")
        both = known.unionByName(fresh).groupBy("backend").agg(F.max_by(F.struct("ts", "event_id", "available"), order).alias("s"))
        last = both.select("backend", "s.ts", "s.event_id", F.coalesce("s.available", F.lit(False)).alias("available"))
        write_state(last, states, batch_id)

    return run


def start_availability_stream(snapshots: DataFrame, out_dir: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """ST4: (backend, ts, event_id, available) stream -> tables of changes and late events under ``out_dir``."""
    w = snapshots.writeStream.foreachBatch(_change_batch(out_dir.rstrip("/"))).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
