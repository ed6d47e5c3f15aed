"""Usage-log operators (B3, B4, B8, B9, B10, B11) on literal rows."""

import datetime as dt
import random

from mailspark.operators import usage as U
from mailspark.streaming.usage import append_usage, read_running, read_totals, start_usage_stream

LOG = "event_id long, backend string, ts timestamp_ntz, success boolean, tokens long, response_time double, event_type string"


def _log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_cost_table(spark):
    df = spark.createDataFrame([("OpenAI", 1_000_000), ("IBM Watson", 500_000), ("Ollama", 10**9), ("Unknown", 5)], "backend string, tokens long")
    got = [r[0] for r in df.select(U.cost_usd()).collect()]
    assert got == [10.0, 6.0, 0.0, 0.0]


def test_performance_success_without_time_is_failure(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, "OpenAI", t, True, 10, 1.0, "x"),
        (2, "OpenAI", t + dt.timedelta(seconds=1), True, 10, None, "x"),
        (3, "OpenAI", t + dt.timedelta(seconds=2), False, 10, 9.0, "error"),
        (4, "OpenAI", t + dt.timedelta(seconds=3), True, 10, 3.0, "x"),
    ]
    m = U.performance_metrics(_log(spark, rows)).first()
    assert (m["total_attempts"], m["successful_attempts"], m["failed_attempts"]) == (4, 2, 2)
    assert m["success_rate"] == 0.5 and m["average_latency"] == 2.0 and m["last_response_time"] == 3.0
    assert m["last_failure"] == t + dt.timedelta(seconds=2)


def test_pick_model_answer_and_short_names(spark):
    df = spark.createDataFrame(
        [(["a:1", "b"], "b"), (["a:1", "b"], "zz"), ([], "keep")], "models array<string>, selected_model string"
    )
    assert [r[0] for r in df.select(U.pick_model()).collect()] == ["b", "a:1", "keep"]
    raw = spark.createDataFrame(
        [
            ("generate", '{"response": "hi", "done": true}'),
            ("chat", '{"choices": []}'),
            ("chat", '{"choices": [{"message": {"content": "yo"}}]}'),
            ("jsonl", '{"content": "a"}\n{"content": "b"}\nnot json\n\n'),
            ("webui", '{"msg": 1}'),
        ],
        "shape string, raw_response string",
    )
    assert [r[0] for r in raw.select(U.answer_text()).collect()] == ["hi", "", "yo", "b", None]
    names = spark.createDataFrame([("llama3:8b",), ("::x:y",), ("",), ("plain",)], "n string")
    assert [r[0] for r in names.select(U.short_model_name("n")).collect()] == ["llama3", "x", "", "plain"]


def test_latest_connection_test(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "TinyLLM", t, True, 1, 0.5, "ok"), (2, "TinyLLM", t + dt.timedelta(hours=1), False, 1, 2.0, "error")]
    r = U.latest_connection_test(_log(spark, rows)).first()
    assert (r["success"], r["response_time"], r["error"], r["n_tests"]) == (False, None, "HTTP error: error", 2)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_appended_logs_go_on_from_earlier_totals(spark, tmp_dir):
    """B2 mutating: parts by time, appended one after another, give what one run gives."""
    rng, t = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [
        (
            i,
            # a third of all requests on one back-end, one that only the last part knows
            "Late" if i > 290 and i % 7 == 0 else "OpenAI" if i % 3 == 0 else rng.choice(["Ollama", "IBM Watson", None]),
            t + dt.timedelta(seconds=i // 2),
            rng.random() < 0.9,
            None if i < 40 or i % 11 == 0 else rng.randrange(5000),
            None if i % 5 == 0 else round(rng.random() * 9, 3),
            "x",
        )
        for i in range(300)
    ]
    whole = _log(spark, rows)
    parts = [rows[:100], [], rows[100:250], rows[250:]]
    for n, part in enumerate(parts):
        append_usage(_log(spark, part), tmp_dir, n)
    one = _rows(U.usage_running(whole))
    assert _rows(read_running(spark, tmp_dir)) == one and len(one) > 200
    assert _rows(U.stats_of_totals(read_totals(spark, tmp_dir))) == _rows(U.usage_stats(whole))
    append_usage(_log(spark, parts[-1]), tmp_dir, len(parts) - 1)  # the last log once more
    assert _rows(read_running(spark, tmp_dir)) == one
    assert _rows(U.stats_of_totals(read_totals(spark, tmp_dir))) == _rows(U.usage_stats(whole))


def test_running_stats_before_the_first_value_are_null(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "OpenAI", t + dt.timedelta(seconds=i), True, None if i < 3 else 10 if i == 3 else None, None, "x") for i in range(8)]
    got = [(r["running_tokens"], r["running_requests"]) for r in U.usage_running(_log(spark, rows)).orderBy("event_id").collect()]
    assert got == [(None, 1), (None, 2), (None, 3), (10, 4), (10, 5), (10, 6), (10, 7), (10, 8)]


def test_stream_of_logs_equals_one_run(spark, tmp_dir):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "OpenAI" if i % 3 else "Ollama", t + dt.timedelta(seconds=i), i % 10 > 0, i, i / 8, "x") for i in range(60)]
    for n in range(3):
        _log(spark, rows[20 * n : 20 * n + 20]).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/log")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/log")
    start_usage_stream(stream, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination(120)
    assert _rows(read_running(spark, f"{tmp_dir}/out")) == _rows(U.usage_running(_log(spark, rows)))
    assert _rows(U.stats_of_totals(read_totals(spark, f"{tmp_dir}/out"))) == _rows(U.usage_stats(_log(spark, rows)))
