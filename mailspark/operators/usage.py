"""Usage-log analytics of language-model back-ends.

The reference keeps these as in-process counters updated per request; here
they are jobs over a request log with columns
``backend, ts, success, tokens, response_time`` (+ a tie-break ``event_id``).
Every per-backend value is a mergeable aggregate (partial aggregation before
the shuffle), and the ordered ones (running stats, state changes) use the
range-partitioned helpers of :mod:`mailspark.operators.running`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums, with_previous

# Price in USD per million tokens; local back-ends are free.
PRICE_PER_MILLION = {
    "OpenAI": 10,
    "Google Cloud AI": 7,
    "Microsoft Azure": 10,
    "AWS AI Services": 8,
    "IBM Watson": 12,
    "Ollama": 0,
    "MLX Toolkit": 0,
    "TinyLLM": 0,
    "TinyChat": 0,
    "OpenWebUI": 0,
}

# Fallback priority after the active back-end.
FALLBACK_PRIORITY = (
    "Ollama",
    "OpenAI",
    "TinyChat",
    "TinyLLM",
    "OpenWebUI",
    "Google Cloud AI",
    "Microsoft Azure",
    "IBM Watson",
    "MLX Toolkit",
    "AWS AI Services",
)

# Fixed value: the model when a list holds none.
DEFAULT_MODEL = "mistral:latest"

ORDER = ("ts", "event_id")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def price_per_million(backend="backend") -> Column:
    """B3 price lookup: a 10-entry literal map, no join."""
    m = F.create_map(*[x for k, v in PRICE_PER_MILLION.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(backend)], F.lit(0))


def cost_usd(backend="backend", tokens="tokens") -> Column:
    """Tokens / 1e6 x price."""
    return (_c(tokens) * price_per_million(backend)).cast("double") / F.lit(1_000_000.0)


_DECIMAL = "decimal(38,10)"


def exact_sum(col) -> Column:
    """Sum in DECIMAL(38,10): exact, so the result is the same whatever the
    order in which partial sums are merged."""
    return F.sum(_decimal(_c(col)))


def _decimal(c: Column) -> Column:
    return c.try_cast(_DECIMAL)


def _survives(c: Column) -> Column:
    """Whether a number is the same as a decimal; infinities, NaN, very large and very small ones are not."""
    return F.coalesce(_decimal(c).cast("double") == c, F.lit(False))


def exact_avg(col) -> Column:
    """Mean (NULL when no values): from the exact decimal sum if every value is the same as
    a decimal, else the plain mean of the doubles."""
    c = _c(col)
    exact = F.try_divide(exact_sum(c).cast("double"), F.count(c))
    return F.when(F.count_if(c.isNotNull() & ~_survives(c)) == 0, exact).otherwise(F.avg(c))


def usage_records(log: DataFrame) -> DataFrame:
    """Requests that produced usage (completed ones)."""
    return log.filter(F.col("success"))


def usage_stats(log: DataFrame) -> DataFrame:
    """B1: per back-end token, request and cost totals, mean response time, last use.

    Cost is summed in integer token x price units and divided once, so the
    result does not depend on summation order.
    """
    u = usage_records(log)
    return u.groupBy("backend").agg(
        F.sum("tokens").alias("total_tokens"),
        F.count(F.lit(1)).alias("total_requests"),
        (F.sum(F.col("tokens") * price_per_million()).cast("double") / F.lit(1_000_000.0)).alias("total_cost"),
        exact_avg("response_time").alias("avg_response_time"),
        F.max("ts").alias("last_used"),
    )


#: What one back-end's requests come to: all that the stats of its next request need (B2 in mutating form).
USAGE_TOTALS = (
    "backend string, tokens long, requests long, units long, rt_sum decimal(38,10), rt_plain double, rt_odd long, rt_n long, "
    "last_used timestamp_ntz"
)


def _running_values() -> dict[str, Column]:
    """What is summed for each request; ``units`` are integer token x price units."""
    rt = F.col("response_time")
    return {
        "run_tokens": F.col("tokens"),
        "run_requests": F.lit(1).cast("long"),
        "run_units": F.col("tokens") * price_per_million(),
        "run_rt_sum": F.coalesce(_decimal(rt), F.lit(0).cast(_DECIMAL)),
        "run_rt_plain": F.coalesce(rt, F.lit(0.0)),
        "run_rt_odd": (rt.isNotNull() & ~_survives(rt)).cast("long"),
        "run_rt_n": F.when(rt.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"),
    }


def _mean_time(prefix: str) -> Column:
    exact = F.col(f"{prefix}rt_sum").cast("double")
    return F.try_divide(F.when(F.col(f"{prefix}rt_odd") == 0, exact).otherwise(F.col(f"{prefix}rt_plain")), F.col(f"{prefix}rt_n"))


def usage_running(log: DataFrame, order: Sequence[str] = ORDER, carried: DataFrame | None = None) -> DataFrame:
    """B2: the stats after each request (the mutating form), per back-end in
    request order; computed with bucketed running sums (no one-key window).

    ``carried`` (``USAGE_TOTALS``) is what the requests before this log came to; the stats go on from there.
    """
    u = usage_records(log).select("event_id", "backend", "ts", "tokens", "response_time")
    values = _running_values()
    if carried is not None:
        carried = carried.select("backend", *[F.col(n.removeprefix("run_")).alias(n) for n in values])
    run = running_sums(u, ["backend"], list(order), values, carried=carried)
    return run.select(
        "event_id",
        "backend",
        "ts",
        F.col("run_tokens").alias("running_tokens"),
        F.col("run_requests").alias("running_requests"),
        (F.col("run_units").cast("double") / F.lit(1_000_000.0)).alias("running_cost"),
        _mean_time("run_").alias("running_avg_response_time"),
    )


def usage_totals(log: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """``USAGE_TOTALS`` of a log, on top of those carried from earlier ones: one row a back-end, mergeable."""
    values = {n.removeprefix("run_"): v for n, v in _running_values().items()}
    totals = usage_records(log).groupBy("backend").agg(*[F.sum(v).alias(n) for n, v in values.items()], F.max("ts").alias("last_used"))
    if carried is None:
        return totals
    both = totals.unionByName(carried)
    return both.groupBy("backend").agg(*[F.sum(n).alias(n) for n in values], F.max("last_used").alias("last_used"))


def stats_of_totals(totals: DataFrame) -> DataFrame:
    """B1 from ``USAGE_TOTALS``: the columns of ``usage_stats``."""
    return totals.select(
        "backend",
        F.col("tokens").alias("total_tokens"),
        F.col("requests").alias("total_requests"),
        (F.col("units").cast("double") / F.lit(1_000_000.0)).alias("total_cost"),
        _mean_time("").alias("avg_response_time"),
        "last_used",
    )


def with_cost(log: DataFrame) -> DataFrame:
    """B3 per request."""
    return log.select("event_id", "backend", "tokens", price_per_million().alias("price_per_million"), cost_usd().alias("cost_usd"))


def performance_metrics(log: DataFrame) -> DataFrame:
    """Attempts, successes, failures, success rate, mean latency over
    successes, last success/failure time and the latest success's response time.
    A success without a response time counts as a failure."""
    ok = F.col("success") & F.col("response_time").isNotNull()
    order_key = F.struct("ts", "event_id")
    agg = log.groupBy("backend").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(ok).alias("successful_attempts"),
        F.count_if(~ok).alias("failed_attempts"),
        exact_avg(F.when(ok, F.col("response_time"))).alias("_lat"),
        F.max_by(F.col("response_time"), F.when(ok, order_key)).alias("last_response_time"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
    )
    return agg.select(
        "backend",
        "total_attempts",
        "successful_attempts",
        "failed_attempts",
        F.try_divide(F.col("successful_attempts"), F.col("total_attempts")).alias("success_rate"),
        F.coalesce("_lat", F.lit(0.0)).alias("average_latency"),
        "last_response_time",
        "last_success",
        "last_failure",
    )


def availability_changes(snapshots: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows where a back-end's availability flips (no previous state = false).

    ``snapshots``: backend, available, + the ``order`` columns.
    """
    prev = with_previous(snapshots, ["backend"], list(order), {"_prev": "available"})
    was = F.coalesce(F.col("_prev"), F.lit(False))
    now = F.coalesce(F.col("available"), F.lit(False))
    return prev.filter(was != now).select(
        "backend",
        *order,
        now.alias("available"),
        F.when(now, F.lit("Online")).otherwise(F.lit("Offline")).alias("status"),
    )


def fallback_order(state: DataFrame) -> DataFrame:
    """Per snapshot, available back-ends in fallback order: the active one
    first (if available), then the fixed priority.

    ``state``: snapshot, backend, available, is_active (one row per back-end
    and snapshot; at most ten rows per snapshot, so the window is tiny).
    """
    prio = F.create_map(*[x for i, b in enumerate(FALLBACK_PRIORITY) for x in (F.lit(b), F.lit(i + 1))])
    avail = state.filter("available").withColumn("priority", prio[F.col("backend")])
    w = Window.partitionBy("snapshot").orderBy(F.col("is_active").desc(), F.col("priority"))
    return avail.select("snapshot", "backend", "is_active", "priority", F.row_number().over(w).cast("long").alias("fallback_rank"))


def config_availability(cfg: DataFrame) -> DataFrame:
    """Cloud back-end availability from configured keys (non-empty)."""

    def has(c: str) -> Column:
        return F.coalesce(F.length(F.col(c)) > 0, F.lit(False))

    return cfg.select(
        "*",
        has("openai_key").alias("openai_available"),
        has("google_key").alias("google_available"),
        (has("azure_key") & has("azure_endpoint")).alias("azure_available"),
        (has("aws_access_key") & has("aws_secret_key")).alias("aws_available"),
        (has("ibm_key") & has("ibm_url")).alias("ibm_available"),
    )


def pick_model(models="models", selected="selected_model") -> Column:
    """Keep the selected model if listed (or if there is no list, or an empty one), else the first."""
    m, s = _c(models), _c(selected)
    return F.when(m.isNull() | (F.size(m) == 0) | F.array_contains(m, s), s).otherwise(F.coalesce(F.get(m, 0), F.lit(DEFAULT_MODEL)))


def _string_at(json: Column, path: str) -> Column:
    """The JSON string at a path; NULL for anything else that stands there."""
    there = F.try_variant_get(json, path, "variant")
    return F.when(F.schema_of_variant(there) == "STRING", F.try_variant_get(json, path, "string"))


def answer_text(shape="shape", raw="raw_response") -> Column:
    """Answer from a logged raw response of one of four shapes:
    ``generate`` (``.response``), ``chat`` (``.choices[0].message.content``: '' for
    an empty list; every choice must have one), ``jsonl`` (last line whose JSON has
    ``content``), ``webui`` (``.message.content``).  Only JSON strings are answers;
    NULL = no answer (the call failed)."""
    r = _c(raw)
    json = F.try_parse_json(r)
    choices = F.try_variant_get(json, "$.choices", "array<variant>")
    answers = F.transform(choices, lambda c: _string_at(c, "$.message.content"))
    chat = F.when(F.size(choices) == 0, F.lit("")).when(F.forall(answers, lambda a: a.isNotNull()), F.get(answers, 0))
    contents = F.transform(F.split(r, "\n", -1), lambda l: _string_at(F.try_parse_json(l), "$.content"))
    s = _c(shape)
    return (
        F.when(s == "generate", _string_at(json, "$.response"))
        .when(s == "chat", chat)
        .when(s == "jsonl", F.try_element_at(F.filter(contents, lambda c: c.isNotNull()), F.lit(-1)))
        .when(s == "webui", _string_at(json, "$.message.content"))
    )


def short_model_name(col) -> Column:
    """Text before the first ':' (empty pieces skipped); the name itself if none."""
    c = _c(col)
    return F.coalesce(F.get(F.filter(F.split(c, ":", -1), lambda p: p != ""), 0), c)


def latest_connection_test(log: DataFrame) -> DataFrame:
    """The latest test per back-end: success, response time, error, time."""
    k = F.struct("ts", "event_id")
    rec = F.struct(
        F.col("success").alias("success"),
        F.when(F.col("success"), F.col("response_time")).alias("response_time"),
        F.when(~F.col("success"), F.concat(F.lit("HTTP error: "), F.col("event_type"))).alias("error"),
        F.col("ts").alias("tested_at"),
    )
    agg = log.groupBy("backend").agg(F.max_by(rec, k).alias("_t"), F.count(F.lit(1)).alias("n_tests"))
    return agg.select("backend", "n_tests", "_t.success", "_t.response_time", "_t.error", "_t.tested_at")
