"""Streaming = batch (ST1-ST4)."""

import os
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from support import SF001, SF01
from mailspark.operators import threads
from mailspark.plans.files import _streamed_emails, stream_load
from mailspark.operators.usage import availability_changes
from mailspark.sources.mbox import load_mbox
from mailspark.sources.views import email_columns, llm_log_from_events, read_table
from mailspark.streaming.archive import emails_stream, running_search_counts, running_thread_sizes, start_archive_stream
from mailspark.streaming.state import batch_numbers, compact, read_change_log, read_state, start_change_log
from mailspark.streaming.usage import read_changes, read_late, running_usage_stats, start_availability_stream


def _mbox_files(spark, d):
    rows = email_columns(read_table(spark, SF001, "conversations")).orderBy("conv_id", "turn").collect()
    paths = []
    for f in range(3):
        text = "".join(
            f"From {r['from_addr']} Mon\nFrom: {r['from_addr']}\n"
            + (f"Subject: {r['subject']}\n" if r["subject"] is not None else "")
            + (f"Date: {r['date']}\n" if r["date"] is not None else "")
            + f"\n{r['body']}\n"
            for r in rows
            if r["conv_id"] % 3 == f
        )
        p = os.path.join(d, f"arch{f}.mbox")
        with open(p, "w", encoding="utf-8") as fh:
            fh.write(text)
        t = time.time() - 100 + f
        os.utime(p, (t, t))
        paths.append(p)
    return paths


def test_archive_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    paths = _mbox_files(spark, src)
    out, ck = os.path.join(tmp_dir, "emails"), os.path.join(tmp_dir, "ck")
    q = start_archive_stream(spark, src, out, ck, max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out)
    cols = ["msg_seq", "from_addr", "subject", "date", "body"]
    got = sorted(tuple(r) for r in streamed.select(*cols).collect())
    batch = load_mbox(spark, paths).emails
    want = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert got == want and len(got) > 0
    assert streamed.select("batch_id").distinct().count() == 3

    # ST2 over the emails table as a stream.
    sizes = running_thread_sizes(emails_stream(spark, out))
    q2 = sizes.writeStream.outputMode("complete").format("memory").queryName("st2_sizes").start()
    q2.processAllAvailable()
    q2.stop()
    got2 = sorted(tuple(r) for r in spark.table("st2_sizes").collect())
    want2 = sorted(tuple(r) for r in threads.thread_sizes(batch).collect())
    assert got2 == want2
    searches = [("n_user", "from", "user"), ("n_topic", "subject", "topic")]
    q3 = running_search_counts(emails_stream(spark, out), searches).writeStream.outputMode("complete").format("memory").queryName("st2_counts").start()
    q3.processAllAvailable()
    q3.stop()
    got3 = tuple(spark.table("st2_counts").first())
    from mailspark.operators.search import multi_counts

    assert got3 == tuple(multi_counts(batch, searches).first())


def _event_chunks(d, n=4):
    t = pq.read_table(f"{SF01}/events.parquet")
    t = t.sort_by([("ts", "ascending"), ("event_id", "ascending")])
    size = (t.num_rows + n - 1) // n
    base = time.time() - 100
    for i in range(n):
        p = os.path.join(d, f"events{i}.parquet")
        pq.write_table(t.slice(i * size, size), p)
        os.utime(p, (base + i, base + i))
    return t


def test_usage_streams_equal_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    os.makedirs(src)
    _event_chunks(src)
    schema = read_table(spark, SF01, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    log = llm_log_from_events(stream)

    q = running_usage_stats(log).writeStream.outputMode("complete").format("memory").queryName("st3").start()
    q.processAllAvailable()
    q.stop()
    batch_log = llm_log_from_events(read_table(spark, SF01, "events"))
    got = sorted(tuple(r) for r in spark.table("st3").collect())
    want = sorted(tuple(r) for r in running_usage_stats(batch_log).collect())
    assert got == want

    snaps = log.select("backend", "ts", "event_id", F.col("success").alias("available"))
    out = os.path.join(tmp_dir, "availability")
    start_availability_stream(snaps, out, os.path.join(tmp_dir, "availability-state")).awaitTermination(300)
    got4 = sorted(tuple(r) for r in read_changes(spark, out).select("backend", "ts", "event_id", "available", "status").collect())
    assert read_late(spark, out).count() == 0
    bsnaps = batch_log.select("backend", "ts", "event_id", F.col("success").alias("available"))
    want4 = sorted(tuple(r) for r in availability_changes(bsnaps).select("backend", "ts", "event_id", "available", "status").collect())
    assert got4 == want4 and len(got4) > 0


def test_archive_stream_awkward_files_equal_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src2")
    os.makedirs(src)
    contents = [
        "preamble\r\nFrom one@x Mon\r\nFrom: one@x \r\nSubject: first\r\n\r\n>From escaped\nNUL\x00cut\n\nFrom two@x\nFrom: two@x\n\nlast body no newline",
        "From a\nFrom: a@b\nSubject: s\n\nbody one\n\nFrom b\nSubject: only subject\n\n",
    ]
    paths = []
    for i, c in enumerate(contents):
        p = os.path.join(src, f"f{i}.mbox")
        with open(p, "wb") as fh:
            fh.write(c.encode("utf-8"))
        t = time.time() - 50 + i
        os.utime(p, (t, t))
        paths.append(p)
    out, ck = os.path.join(tmp_dir, "emails2"), os.path.join(tmp_dir, "ck2")
    q = start_archive_stream(spark, src, out, ck, max_files_per_trigger=1)
    q.awaitTermination(300)
    cols = ["msg_seq", "from_addr", "subject", "date", "body"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*cols).collect())
    want = sorted(tuple(r) for r in load_mbox(spark, paths).emails.select(*cols).collect())
    assert got == want and len(got) == 4
    assert [r[4] for r in got][1] == "last body no newline\n"


def test_late_events_are_kept_apart(spark, tmp_dir):
    import datetime

    at = lambda m: datetime.datetime(2030, 1, 1, 0, m)
    batches = [[("x", at(5), 1, True), ("x", at(9), 2, True)], [("x", at(7), 3, False), ("x", at(10), 4, False), ("y", at(1), 5, True)]]
    src, out = os.path.join(tmp_dir, "late-in"), os.path.join(tmp_dir, "late-out")
    schema = "backend string, ts timestamp_ntz, event_id long, available boolean"
    state = os.path.join(tmp_dir, "late-state")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        start_availability_stream(spark.readStream.schema(schema).parquet(src), out, state).awaitTermination(300)
    changes = [(r["backend"], r["event_id"], r["available"]) for r in read_changes(spark, out).orderBy("event_id").collect()]
    assert changes == [("x", 1, True), ("x", 4, False), ("y", 5, True)]
    assert [r["event_id"] for r in read_late(spark, out).collect()] == [3]


def test_a_batch_reads_one_state_and_no_earlier_output(spark, tmp_dir):
    """Seven batches: the state folder never holds more than the last two, and it alone decides the next batch."""
    import datetime
    import shutil

    at = lambda m: datetime.datetime(2030, 1, 1, 0, m)
    schema = "backend string, ts timestamp_ntz, event_id long, available boolean"
    src, out, state = (os.path.join(tmp_dir, n) for n in ("st-in", "st-out", "st-state"))
    seen = []
    for k in range(7):
        rows = [("x", at(2 * k), 2 * k, k % 2 == 0), (f"y{k}", at(k), 2 * k + 1, True)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        start_availability_stream(spark.readStream.schema(schema).parquet(src), out, state).awaitTermination(300)
        assert len(batch_numbers(spark, f"{out}/states")) <= 2
        seen += [(r["backend"], r["available"]) for r in read_changes(spark, out).orderBy("event_id").collect()]
        shutil.rmtree(f"{out}/changes")  # nothing that an earlier batch reported is read again
    assert [s for s in seen if s[0] == "x"] == [("x", k % 2 == 0) for k in range(7)]
    last = read_state(spark, f"{out}/states", schema, 1 << 40).orderBy("backend").collect()
    assert [r["backend"] for r in last] == ["x", *(f"y{k}" for k in range(7))]


def test_change_log_holds_changed_groups_only(spark, tmp_dir):
    src, out, state = (os.path.join(tmp_dir, n) for n in ("log-in", "log-out", "log-state"))
    schema = "file_path string, file_ordinal int, msg_seq long, from_addr string, subject string, date string, body string"
    row = lambda i, subject: ("f", 1, i, "a", subject, None, "the body")
    batches = [[row(1, "A"), row(2, "b"), row(3, None)], [row(4, "a")], [row(5, "a"), row(6, "C")]]
    os.makedirs(src)
    stream = running_thread_sizes(spark.readStream.schema(schema).parquet(src))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        start_change_log(stream, out, state).awaitTermination(300)
        touched = {(r[4] or "").lower() for r in rows}
        assert {r["thread_key"] for r in spark.read.parquet(f"{out}/batch_id={batch_numbers(spark, out)[-1]}").collect()} == touched, k
    want = {"a": 3, "b": 1, "": 1, "c": 1}
    read = lambda: {r["thread_key"]: r["n_messages"] for r in read_change_log(spark, out, stream, ["thread_key"]).collect()}
    assert read() == want
    compact(spark, out, stream, ["thread_key"])
    assert read() == want and len(batch_numbers(spark, out)) == 1


def test_an_archive_batch_reads_its_files_once(spark, tmp_dir):
    src = os.path.join(tmp_dir, "once")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"f{i}.mbox"), "w", encoding="utf-8") as fh:
            fh.write("".join(f"From a\nFrom: a@b\nSubject: s{k}\n\nbody {i} {k}\n" for k in range(4)))
    out = os.path.join(tmp_dir, "once-emails")
    q = start_archive_stream(spark, src, out, os.path.join(tmp_dir, "once-ck"), max_files_per_trigger=2)
    q.awaitTermination(300)
    assert sorted(p["numInputRows"] for p in q.recentProgress if p["numInputRows"]) == [4, 8]
    assert sorted(r["msg_seq"] for r in spark.read.parquet(out).collect()) == list(range(1, 13))
    assert [tuple(r) for r in spark.read.parquet(f"{out}/_totals/batch_id=1").collect()] == [(12, 3)]


def test_the_number_of_stream_batches_does_not_follow_small_files(spark, tmp_dir):
    """Sixty files of one message each: one micro-batch, and the rows of all files."""
    rows = [(16 * i, 0, "user", f"text {i}") for i in range(1, 61)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    assert batch_numbers(spark, _streamed_emails(spark, tmp_dir)) == [0]
    got = stream_load(spark, tmp_dir)
    assert got.agg(F.sum("n")).first()[0] == 60 and got.filter("from_addr = 'user@example.com'").count() == 60
