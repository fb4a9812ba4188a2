"""Token usage, cost, rates and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.blocks import BLOCK_WIDTH, number_rows, with_running

# Request limits, and the retry policy (attempts, delays in seconds) per error type.
REQUESTS_PER_MINUTE = 30
RATE_WINDOW_SECONDS = 60
MAX_IN_FLIGHT = 4
RETRIES = {
    "network_connect": [1, 2, 4],
    "network_timeout": [2, 4, 8],
    "rate_limit": [5, 10, 15],
    "server_error": [1, 2, 4],
    "unknown_error": [1, 2],
}
NEVER_RETRIED = ["auth_error", "not_found", "validation_error"]
DEFAULT_DELAYS = [1, 1, 1]
# Ordered rules (type, substrings of the lower-case message), and the looser second set.
ERROR_RULES = [
    ("network_timeout", ["timeout"]),
    ("network_connect", ["connect"]),
    ("rate_limit", ["429", "rate limit", "too many requests"]),
    ("auth_error", ["401", "auth", "unauthorized"]),
    ("not_found", ["404", "not found"]),
    ("server_error", ["500", "502", "503", "server error"]),
]
LOOSE_ERROR_RULES = [
    ("network_timeout", ["timeout"]), ("network_connect", ["connect"]), ("rate_limit", ["429"]),
    ("auth_error", ["401"]), ("not_found", ["404"]), ("server_error", ["5"]),
]
UNKNOWN_ERROR = "unknown_error"
SECOND = 1_000_000
# Blocks of ten seconds: instants are distinct microseconds, so a block stays bounded whatever the load.
SWEEP_WIDTH = 10 * SECOND


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def usage_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cost of each request; NULL, never 0, where the model has no valid price.  The price list is a small dimension."""
    rates = pricing.where((F.col("input_per_million") >= 0) & (F.col("output_per_million") >= 0))
    joined = usage.join(rates, "model", "left")
    into = F.greatest(F.col("prompt_tokens"), F.lit(0)) * F.col("input_per_million") / 1_000_000
    out = F.greatest(F.col("completion_tokens"), F.lit(0)) * F.col("output_per_million") / 1_000_000
    return joined.withColumns({
        "priced": F.col("input_per_million").isNotNull(),
        "input_cost": F.bround(into, 6), "output_cost": F.bround(out, 6), "total_cost": F.bround(into + out, 6),
    }).drop("input_per_million", "output_per_million")


def usage_by_task(usage: DataFrame) -> DataFrame:
    """Tokens of each task after each request, in request order."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    running = with_running(usage, ["task_id"], "request_id", {
        "prompt_so_far": (F.col("prompt_tokens"), F.sum), "completion_so_far": (F.col("completion_tokens"), F.sum),
        "total_so_far": (total, F.sum)})
    return running.select("task_id", "request_id", "prompt_so_far", "completion_so_far", "total_so_far")


def batch_totals(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Totals of each batch over its successes; a cost only when every success is priced."""
    ok = F.col("ok")
    cost = usage_cost(usage, pricing).withColumnRenamed("task_id", "batch_id")
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    totals = cost.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(ok).alias("successful_files"), F.count_if(~ok).alias("failed_files"),
        F.coalesce(F.sum(F.when(ok, F.col("pages"))), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum(F.when(ok, tokens)), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("seconds"))), F.lit(0.0)), 6).alias("total_seconds"),
        F.coalesce(F.bool_and(F.when(ok, F.col("priced"))), F.lit(False)).alias("priced"),
        F.sum(F.when(ok, F.col("total_cost"))).alias("__cost"),
        F.min_by("currency", F.when(ok, F.col("request_id"))).alias("__currency"))
    return totals.withColumns({
        "total_cost": F.when(F.col("priced"), F.round("__cost", 6)), "currency": F.when(F.col("priced"), F.col("__currency")),
    }).drop("__cost", "__currency")


def throughput_report(history: DataFrame) -> DataFrame:
    """Seconds and tokens per page by model and translation, with subtotals."""
    report = history.groupingSets([["model", "translated"], ["model"], []], "model", "translated").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("processed_pages").alias("pages"), F.sum("total_tokens").alias("tokens"),
        F.sum("processing_time").alias("__seconds"), F.percentile("processed_pages", 0.5).alias("median_pages"),
        F.grouping("model").alias("__m"), F.grouping("translated").alias("__t"))
    return report.select(
        F.when(F.col("__m") == 1, "(all)").otherwise(F.col("model")).alias("model"),
        F.when(F.col("__t") == 1, "(all)").otherwise(F.col("translated").cast("string")).alias("translated"),
        "runs", "pages", "tokens", "median_pages", F.round(F.col("__seconds") / F.col("pages"), 6).alias("seconds_per_page"),
        F.round(F.col("tokens") / F.col("pages"), 6).alias("tokens_per_page"))


def rate_limit_windows(
    usage: DataFrame, limit: int = REQUESTS_PER_MINUTE, seconds: int = RATE_WINDOW_SECONDS, width: int = BLOCK_WIDTH
) -> DataFrame:
    """When each request of a model may start, if at most ``limit`` start in any window of ``seconds``; first come, first served.

    Only requests that started take up slots, so a request starts at its arrival, or ``seconds`` after the start of the one
    ``limit`` places before it, whichever is later.  Hence every ``limit``-th request makes a lane of its own, and in a lane the
    start less its turn times ``seconds`` is a running maximum.  Ties arrive in the order of ``request_id``.  Rows without a
    time make no request; a null name is a model.
    """
    span = seconds * SECOND
    arrivals = usage.where("ts IS NOT NULL").select("request_id", "model", micros(F.col("ts")).alias("at_micros")).withColumn("__place", F.struct("at_micros", "request_id"))
    numbered = number_rows(arrivals, ["model"], "__place", "__n", width)
    lanes = numbered.withColumns({"__lane": F.pmod(F.col("__n") - 1, F.lit(limit)), "__turn": F.floor((F.col("__n") - 1) / limit)})
    free = F.col("at_micros") - F.col("__turn") * span
    started = with_running(lanes, ["model", "__lane"], "__turn", {"__since": (free, F.max)}, width, counted=True)
    start = F.col("__since") + F.col("__turn") * span
    return started.select("request_id", "model", "at_micros", start.alias("start_micros"), (start == F.col("at_micros")).alias("admitted"),
                          F.round((start - F.col("at_micros")) / SECOND, 6).alias("wait_seconds"))


def concurrent_requests(usage: DataFrame, limit: int = MAX_IN_FLIGHT) -> DataFrame:
    """Peak number of requests in flight per model, by a sweep over starts and ends."""
    start = micros(F.col("ts"))
    end = start + F.floor(F.col("seconds") * SECOND)
    edges = usage.select("model", F.explode(F.array(
        F.struct(start.alias("at"), F.lit(1).cast("long").alias("change")), F.struct(end.alias("at"), F.lit(-1).cast("long").alias("change")))).alias("e"))
    net = edges.groupBy("model", F.col("e.at").alias("at")).agg(F.sum("e.change").alias("change"))
    swept = with_running(net, ["model"], "at", {"in_flight": (F.col("change"), F.sum)}, SWEEP_WIDTH)
    return swept.groupBy("model").agg(F.max("in_flight").alias("peak"), F.count_if(F.col("in_flight") > limit).alias("instants_over_limit"))


def classified(message: Column, rules=None) -> Column:
    lowered = F.lower(message)
    kind = F.lit(UNKNOWN_ERROR)
    for name, needles in reversed(rules or ERROR_RULES):
        hit = lowered.contains(needles[0])
        for needle in needles[1:]:
            hit = hit | lowered.contains(needle)
        kind = F.when(hit, name).otherwise(kind)
    return kind


def classify_error(errors: DataFrame) -> DataFrame:
    return errors.withColumns({"error_type": classified(F.col("message")), "loose_type": classified(F.col("message"), LOOSE_ERROR_RULES)})


def retry_plan(errors: DataFrame) -> DataFrame:
    """Planned retries of each error if it persists.

    ``declared`` is the stated policy; ``observed`` is what happens: an error that is never retried still waits
    and retries once before it is raised.
    """
    kind = classified(F.col("message"))
    delays = F.array(*[F.lit(d) for d in DEFAULT_DELAYS[:1]])
    for name, values in RETRIES.items():
        delays = F.when(kind == name, F.array(*[F.lit(v) for v in values])).otherwise(delays)
    planned = errors.select("event_id", kind.alias("error_type"), F.posexplode_outer(delays).alias("i", "delay_seconds"))
    return planned.select("event_id", "error_type", (F.col("i") + 1).alias("attempt"), "delay_seconds",
                          (~F.col("error_type").isin(NEVER_RETRIED)).alias("declared"), F.lit(True).alias("observed"))


def error_summary(errors: DataFrame) -> DataFrame:
    """Errors by type and in total, with how many are recoverable and how many pages failed."""
    report = classify_error(errors).rollup("error_type").agg(
        F.count(F.lit(1)).alias("errors"), F.count_if("recoverable").alias("recoverable"), F.count_if(~F.col("recoverable")).alias("non_recoverable"),
        F.countDistinct("page").alias("failed_pages"), F.grouping("error_type").alias("__all"))
    return report.withColumn("error_type", F.when(F.col("__all") == 1, "(all)").otherwise(F.col("error_type"))).drop("__all")


def error_page_summary(errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """Errors and warnings per page; a page is recoverable when any of its errors is."""
    failed = errors.groupBy("page").agg(F.count(F.lit(1)).alias("errors"), F.bool_or("recoverable").alias("is_recoverable"))
    warned = warnings.groupBy("page").agg(F.count(F.lit(1)).alias("warnings"))
    return failed.join(warned, "page", "full").select(
        "page", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"),
        F.coalesce("is_recoverable", F.lit(False)).alias("is_recoverable"))
