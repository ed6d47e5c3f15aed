"""Registered usage-log queries (B1-B11) over the request log derived from
``events``, each with its DuckDB oracle SQL.  Configuration, model lists, raw
responses and model names are derived from each event by rule, so every
query's work grows with the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as U
from ..session import remember_scratch, scratch_path
from ..sources.views import BACKENDS_BY_PRIORITY, llm_log_view
from ..streaming.usage import append_usage, read_running, read_totals

# Written out, so that the SQL does not follow the engine's own constants.
_BACKENDS_SQL = """['Ollama', 'OpenAI', 'TinyChat', 'TinyLLM', 'OpenWebUI', 'Google Cloud AI', 'Microsoft Azure',
   'IBM Watson', 'MLX Toolkit', 'AWS AI Services']"""
_PRICE_SQL = """CASE backend WHEN 'OpenAI' THEN 10 WHEN 'Google Cloud AI' THEN 7 WHEN 'Microsoft Azure' THEN 10
   WHEN 'AWS AI Services' THEN 8 WHEN 'IBM Watson' THEN 12 ELSE 0 END"""
_PRIO_SQL = """CASE backend WHEN 'Ollama' THEN 1 WHEN 'OpenAI' THEN 2 WHEN 'TinyChat' THEN 3 WHEN 'TinyLLM' THEN 4 WHEN 'OpenWebUI' THEN 5
   WHEN 'Google Cloud AI' THEN 6 WHEN 'Microsoft Azure' THEN 7 WHEN 'IBM Watson' THEN 8 WHEN 'MLX Toolkit' THEN 9 WHEN 'AWS AI Services' THEN 10 END"""

LOG_SQL = f"""
log AS (
  SELECT event_id, ({_BACKENDS_SQL})[user_id % 10 + 1] AS backend, ts, event_type <> 'error' AS success,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS response_time, event_type, user_id
  FROM events),
priced AS (SELECT *, {_PRICE_SQL} AS price FROM log)
"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return llm_log_view(spark, sf)


def usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return U.usage_stats(_log(spark, sf))


USAGE_STATS_SQL = f"""WITH {LOG_SQL}
SELECT backend, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) AS total_requests,
       CAST(sum(tokens * price) AS DOUBLE) / 1000000.0 AS total_cost, CAST(sum(CAST(response_time AS DECIMAL(38,10))) AS DOUBLE) / count(response_time) AS avg_response_time,
       max(ts) AS last_used
FROM priced WHERE success GROUP BY backend"""


def usage_running(spark: SparkSession, sf: str) -> DataFrame:
    return U.usage_running(_log(spark, sf))


USAGE_RUNNING_SQL = f"""WITH {LOG_SQL}
SELECT event_id, backend, ts,
       CAST(sum(tokens) OVER w AS BIGINT) AS running_tokens, count(*) OVER w AS running_requests,
       CAST(sum(tokens * price) OVER w AS DOUBLE) / 1000000.0 AS running_cost,
       CAST(sum(CAST(response_time AS DECIMAL(38,10))) OVER w AS DOUBLE) / count(response_time) OVER w AS running_avg_response_time
FROM priced WHERE success
WINDOW w AS (PARTITION BY backend ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _appended(spark: SparkSession, sf: str) -> str:
    """The log in three parts by time, appended one after another; returns the folder."""
    out = scratch_path(spark, "usage-appended")
    remember_scratch(spark, out)
    log = _log(spark, sf)
    r = log.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if r["lo"] is None:
        append_usage(log, out, 0)
        return out
    cuts = [r["lo"] + (r["hi"] - r["lo"]) * i / 3 for i in (1, 2)]
    for n, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = log if lo is None else log.where(F.col("ts") > F.lit(lo).cast("timestamp_ntz"))
        append_usage(part if hi is None else part.where(F.col("ts") <= F.lit(hi).cast("timestamp_ntz")), out, n)
    return out


def usage_running_appended(spark: SparkSession, sf: str) -> DataFrame:
    return read_running(spark, _appended(spark, sf))


def usage_totals_appended(spark: SparkSession, sf: str) -> DataFrame:
    return U.stats_of_totals(read_totals(spark, _appended(spark, sf)))


def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    return U.with_cost(_log(spark, sf))


USAGE_COST_SQL = f"""WITH {LOG_SQL}
SELECT event_id, backend, tokens, price AS price_per_million, CAST(tokens * price AS DOUBLE) / 1000000.0 AS cost_usd FROM priced"""


def performance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return U.performance_metrics(_log(spark, sf))


PERFORMANCE_METRICS_SQL = f"""WITH {LOG_SQL},
m AS (SELECT *, success AND response_time IS NOT NULL AS ok FROM log)
SELECT backend, count(*) AS total_attempts, count(*) FILTER (WHERE ok) AS successful_attempts,
       count(*) FILTER (WHERE NOT ok) AS failed_attempts,
       count(*) FILTER (WHERE ok) / count(*) AS success_rate,
       coalesce(CAST(sum(CAST(response_time AS DECIMAL(38,10))) FILTER (WHERE ok) AS DOUBLE) / count(response_time) FILTER (WHERE ok), 0.0) AS average_latency,
       arg_max(response_time, {{'t': ts, 'e': event_id}}) FILTER (WHERE ok) AS last_response_time,
       max(ts) FILTER (WHERE ok) AS last_success, max(ts) FILTER (WHERE NOT ok) AS last_failure
FROM m GROUP BY backend"""


def availability_changes(spark: SparkSession, sf: str) -> DataFrame:
    snaps = _log(spark, sf).select("backend", "ts", "event_id", F.col("success").alias("available"))
    return U.availability_changes(snaps)


AVAILABILITY_CHANGES_SQL = f"""WITH {LOG_SQL},
s AS (SELECT backend, ts, event_id, success AS available,
             lag(success, 1, false) OVER (PARTITION BY backend ORDER BY ts, event_id) AS prev FROM log)
SELECT backend, ts, event_id, available, CASE WHEN available THEN 'Online' ELSE 'Offline' END AS status
FROM s WHERE available <> prev"""


def fallback_state(log: DataFrame) -> DataFrame:
    """Per hour and back-end: last known availability; the hour's last request
    names the active back-end."""
    k = F.struct("ts", "event_id")
    snap = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("snapshot")
    st = log.groupBy(snap, "backend").agg(F.max_by("success", k).alias("available"), F.max(k).alias("_last"))
    act = st.groupBy("snapshot").agg(F.max_by("backend", "_last").alias("_active"))
    return st.join(act, "snapshot").select("snapshot", "backend", "available", (F.col("backend") == F.col("_active")).alias("is_active"))


def fallback_order(spark: SparkSession, sf: str) -> DataFrame:
    return U.fallback_order(fallback_state(_log(spark, sf)))


FALLBACK_ORDER_SQL = f"""WITH {LOG_SQL},
st AS (SELECT date_trunc('hour', ts) AS snapshot, backend, arg_max(success, {{'t': ts, 'e': event_id}}) AS available,
              max({{'t': ts, 'e': event_id}}) AS last_k
       FROM log GROUP BY 1, 2),
act AS (SELECT snapshot, arg_max(backend, last_k) AS active FROM st GROUP BY 1),
av AS (SELECT st.snapshot, st.backend, st.backend = act.active AS is_active, {_PRIO_SQL} AS priority
       FROM st JOIN act USING (snapshot) WHERE st.available)
SELECT snapshot, backend, is_active, priority,
       row_number() OVER (PARTITION BY snapshot ORDER BY is_active DESC, priority) AS fallback_rank
FROM av"""


def _k() -> Column:
    return F.col("tokens")


def backend_config_available(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    k, uid = _k(), F.col("user_id")
    cfg = log.select(
        "event_id",
        F.when(k % 2 == 0, F.concat(F.lit("sk-"), k.cast("string"))).otherwise(F.lit("")).alias("openai_key"),
        F.when(k % 3 == 0, F.concat(F.lit("g-"), k.cast("string"))).alias("google_key"),
        F.when(k % 5 < 3, F.lit("az")).otherwise(F.lit("")).alias("azure_key"),
        F.when(uid % 2 == 0, F.lit("https://x")).otherwise(F.lit("")).alias("azure_endpoint"),
        F.when(k % 7 < 4, F.lit("AK")).otherwise(F.lit("")).alias("aws_access_key"),
        F.when(uid % 3 > 0, F.lit("SK")).otherwise(F.lit("")).alias("aws_secret_key"),
        F.when(k % 4 == 1, F.lit("ibm")).otherwise(F.lit("")).alias("ibm_key"),
        F.when(uid % 4 < 2, F.lit("https://ibm")).otherwise(F.lit("")).alias("ibm_url"),
    )
    return U.config_availability(cfg).select(
        "event_id", "openai_available", "google_available", "azure_available", "aws_available", "ibm_available"
    )


BACKEND_CONFIG_AVAILABLE_SQL = f"""WITH {LOG_SQL},
cfg AS (SELECT event_id,
  CASE WHEN tokens % 2 = 0 THEN 'sk-' || tokens ELSE '' END AS openai_key,
  CASE WHEN tokens % 3 = 0 THEN 'g-' || tokens END AS google_key,
  CASE WHEN tokens % 5 < 3 THEN 'az' ELSE '' END AS azure_key,
  CASE WHEN user_id % 2 = 0 THEN 'https://x' ELSE '' END AS azure_endpoint,
  CASE WHEN tokens % 7 < 4 THEN 'AK' ELSE '' END AS aws_access_key,
  CASE WHEN user_id % 3 > 0 THEN 'SK' ELSE '' END AS aws_secret_key,
  CASE WHEN tokens % 4 = 1 THEN 'ibm' ELSE '' END AS ibm_key,
  CASE WHEN user_id % 4 < 2 THEN 'https://ibm' ELSE '' END AS ibm_url
  FROM log)
SELECT event_id, coalesce(length(openai_key) > 0, false) AS openai_available,
       coalesce(length(google_key) > 0, false) AS google_available,
       coalesce(length(azure_key) > 0, false) AND coalesce(length(azure_endpoint) > 0, false) AS azure_available,
       coalesce(length(aws_access_key) > 0, false) AND coalesce(length(aws_secret_key) > 0, false) AS aws_available,
       coalesce(length(ibm_key) > 0, false) AND coalesce(length(ibm_url) > 0, false) AS ibm_available
FROM cfg"""


def pick_model(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    k, uid = _k(), F.col("user_id")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    models = (
        F.when(k % 5 == 0, arr())
        .when(k % 5 == 1, arr("llama3:8b", "mistral:latest"))
        .when(k % 5 == 2, arr("qwen2:7b"))
        .when(k % 5 == 3, F.lit(None).cast("array<string>"))
        .otherwise(arr("phi3:mini", "llama3:8b", "gemma:2b"))
    )
    selected = F.when(uid % 3 == 0, F.lit("mistral:latest")).when(uid % 3 == 1, F.lit("llama3:8b")).otherwise(F.lit("gemma:2b"))
    df = log.select("event_id", models.alias("models"), selected.alias("selected_model"))
    return df.select("event_id", "selected_model", F.coalesce(F.array_size("models"), F.lit(0)).cast("long").alias("n_models"), U.pick_model().alias("picked_model"))


PICK_MODEL_SQL = f"""WITH {LOG_SQL},
m AS (SELECT event_id,
  CASE WHEN tokens % 5 = 0 THEN []::VARCHAR[] WHEN tokens % 5 = 1 THEN ['llama3:8b', 'mistral:latest']
       WHEN tokens % 5 = 2 THEN ['qwen2:7b'] WHEN tokens % 5 = 3 THEN NULL ELSE ['phi3:mini', 'llama3:8b', 'gemma:2b'] END AS models,
  CASE user_id % 3 WHEN 0 THEN 'mistral:latest' WHEN 1 THEN 'llama3:8b' ELSE 'gemma:2b' END AS selected_model
  FROM log)
SELECT event_id, selected_model, coalesce(len(models), 0) AS n_models,
       CASE WHEN models IS NULL OR len(models) = 0 OR list_contains(models, selected_model) THEN selected_model ELSE models[1] END AS picked_model
FROM m"""


def _raw_responses(log: DataFrame) -> DataFrame:
    k, eid = _k().cast("string"), F.col("event_id")
    shape = F.when(eid % 4 == 0, "generate").when(eid % 4 == 1, "chat").when(eid % 4 == 2, "jsonl").otherwise("webui")
    kk = _k()
    raw = (
        F.when((eid % 4 == 0) & (kk % 7 == 0), F.lit('{"response": 5}'))
        .when((eid % 4 == 1) & (kk % 6 == 0), F.lit('{"error": "busy"}'))
        .when((eid % 4 == 1) & (kk % 6 == 1), F.lit('{"choices": [{"message": {"content": "x"}}, {"message": {}}]}'))
        .when((eid % 4 == 2) & (kk % 6 == 2), F.lit('{"content": "words"}\n{"content": 7}'))
        .when((eid % 4 == 3) & (kk % 5 == 0), F.lit('{"message": {"content": {"a": 1}}}'))
        .when(eid % 4 == 0, F.concat(F.lit('{"response": "'), F.col("event_type"), F.lit(" answer "), k, F.lit('", "done": true}')))
        .when(
            eid % 4 == 1,
            F.when(kk % 3 == 0, F.lit('{"choices": []}')).otherwise(
                F.concat(F.lit('{"choices": [{"message": {"role": "assistant", "content": "chat '), k, F.lit('"}}]}'))
            ),
        )
        .when(
            eid % 4 == 2,
            F.when(kk % 3 == 0, F.concat(F.lit('{"content": "a'), k, F.lit('"}\nnot json\n')))
            .when(kk % 3 == 1, F.concat(F.lit('{"x": 1}\n{"content": "z'), k, F.lit('"}\n\n{"y": 2}')))
            .otherwise(F.lit('{"done": true}')),
        )
        .otherwise(
            F.when(kk % 2 == 0, F.lit('{"msg": 1}')).otherwise(F.concat(F.lit('{"message": {"content": "webui '), k, F.lit('"}}')))
        )
    )
    return log.select("event_id", shape.alias("shape"), raw.alias("raw_response"))


def answer_text(spark: SparkSession, sf: str) -> DataFrame:
    r = _raw_responses(_log(spark, sf))
    return r.select("event_id", "shape", U.answer_text().alias("answer"))


ANSWER_TEXT_SQL = f"""WITH {LOG_SQL},
r AS (SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN 'generate' WHEN 1 THEN 'chat' WHEN 2 THEN 'jsonl' ELSE 'webui' END AS shape,
  CASE WHEN event_id % 4 = 0 AND tokens % 7 = 0 THEN '{{"response": 5}}'
       WHEN event_id % 4 = 1 AND tokens % 6 = 0 THEN '{{"error": "busy"}}'
       WHEN event_id % 4 = 1 AND tokens % 6 = 1 THEN '{{"choices": [{{"message": {{"content": "x"}}}}, {{"message": {{}}}}]}}'
       WHEN event_id % 4 = 2 AND tokens % 6 = 2 THEN '{{"content": "words"}}' || chr(10) || '{{"content": 7}}'
       WHEN event_id % 4 = 3 AND tokens % 5 = 0 THEN '{{"message": {{"content": {{"a": 1}}}}}}'
  ELSE CASE event_id % 4
    WHEN 0 THEN '{{"response": "' || event_type || ' answer ' || tokens || '", "done": true}}'
    WHEN 1 THEN CASE WHEN tokens % 3 = 0 THEN '{{"choices": []}}'
                ELSE '{{"choices": [{{"message": {{"role": "assistant", "content": "chat ' || tokens || '"}}}}]}}' END
    WHEN 2 THEN CASE tokens % 3 WHEN 0 THEN '{{"content": "a' || tokens || '"}}' || chr(10) || 'not json' || chr(10)
                WHEN 1 THEN '{{"x": 1}}' || chr(10) || '{{"content": "z' || tokens || '"}}' || chr(10) || chr(10) || '{{"y": 2}}'
                ELSE '{{"done": true}}' END
    ELSE CASE WHEN tokens % 2 = 0 THEN '{{"msg": 1}}' ELSE '{{"message": {{"content": "webui ' || tokens || '"}}}}' END
  END END AS raw
  FROM log)
SELECT event_id, shape,
  CASE shape
    WHEN 'generate' THEN CASE WHEN json_type(raw, '$.response') = 'VARCHAR' THEN json_extract_string(raw, '$.response') END
    WHEN 'chat' THEN CASE WHEN json_type(raw, '$.choices') <> 'ARRAY' OR json_type(raw, '$.choices') IS NULL THEN NULL
                          WHEN json_array_length(raw, '$.choices') = 0 THEN ''
                          WHEN len(list_filter(json_extract_string(raw, '$.choices[*].message.content'), lambda c: c IS NOT NULL))
                               = json_array_length(raw, '$.choices') THEN json_extract_string(raw, '$.choices[0].message.content') END
    WHEN 'jsonl' THEN list_filter(list_transform(list_filter(string_split(raw, chr(10)), lambda l: l <> ''),
                        lambda l: CASE WHEN json_valid(l) THEN CASE WHEN json_type(l, '$.content') = 'VARCHAR' THEN json_extract_string(l, '$.content') END END),
                        lambda c: c IS NOT NULL)[-1]
    ELSE CASE WHEN json_type(raw, '$.message.content') = 'VARCHAR' THEN json_extract_string(raw, '$.message.content') END END AS answer
FROM r"""


def short_model_name(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    eid = F.col("event_id")
    name = (
        F.when(eid % 5 == 0, F.lit("llama3:8b"))
        .when(eid % 5 == 1, F.lit("mistral"))
        .when(eid % 5 == 2, F.lit("::weird:tag"))
        .when(eid % 5 == 3, F.lit(""))
        .otherwise(F.concat(F.col("event_type"), F.lit(":"), _k().cast("string")))
    )
    return log.select("event_id", name.alias("model_name")).select("event_id", "model_name", U.short_model_name("model_name").alias("short_name"))


SHORT_MODEL_NAME_SQL = f"""WITH {LOG_SQL},
n AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'llama3:8b' WHEN 1 THEN 'mistral' WHEN 2 THEN '::weird:tag'
                                         WHEN 3 THEN '' ELSE event_type || ':' || tokens END AS model_name FROM log)
SELECT event_id, model_name, coalesce(list_filter(string_split(model_name, ':'), lambda p: p <> '')[1], model_name) AS short_name
FROM n"""


def latest_connection_test(spark: SparkSession, sf: str) -> DataFrame:
    return U.latest_connection_test(_log(spark, sf))


LATEST_CONNECTION_TEST_SQL = f"""WITH {LOG_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY ts DESC, event_id DESC) AS rn,
             count(*) OVER (PARTITION BY backend) AS n_tests FROM log)
SELECT backend, n_tests, success, CASE WHEN success THEN response_time END AS response_time,
       CASE WHEN NOT success THEN 'HTTP error: ' || event_type END AS error, ts AS tested_at
FROM r WHERE rn = 1"""


QUERIES = {
    "usage_stats": usage_stats,
    "usage_running": usage_running,
    "usage_running_appended": usage_running_appended,
    "usage_totals_appended": usage_totals_appended,
    "usage_cost": usage_cost,
    "performance_metrics": performance_metrics,
    "availability_changes": availability_changes,
    "fallback_order": fallback_order,
    "backend_config_available": backend_config_available,
    "pick_model": pick_model,
    "answer_text": answer_text,
    "short_model_name": short_model_name,
    "latest_connection_test": latest_connection_test,
}
ORACLE_SQL = {
    "usage_stats": USAGE_STATS_SQL,
    "usage_running": USAGE_RUNNING_SQL,
    "usage_running_appended": USAGE_RUNNING_SQL,
    "usage_totals_appended": USAGE_STATS_SQL,
    "usage_cost": USAGE_COST_SQL,
    "performance_metrics": PERFORMANCE_METRICS_SQL,
    "availability_changes": AVAILABILITY_CHANGES_SQL,
    "fallback_order": FALLBACK_ORDER_SQL,
    "backend_config_available": BACKEND_CONFIG_AVAILABLE_SQL,
    "pick_model": PICK_MODEL_SQL,
    "answer_text": ANSWER_TEXT_SQL,
    "short_model_name": SHORT_MODEL_NAME_SQL,
    "latest_connection_test": LATEST_CONNECTION_TEST_SQL,
}
