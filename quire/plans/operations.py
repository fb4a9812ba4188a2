"""Usage, cache, history, preferences, tasks, errors: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import cache, history, tasks, usage
from quire.plans import sql as S
from quire.plans.registry import register
from quire.plans.views import with_views

# Clock-based rules look at the tables from fixed times after their first and their last event.
CACHE_TIME = "2024-01-09 00:00:00"
TASK_TIME = "2024-02-06 06:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# ---- usage -------------------------------------------------------------------------------------------------------

_COST = """, cost AS (SELECT u.*, currency, p.model IS NOT NULL AS priced, greatest(prompt_tokens, 0) * input_per_million / 1000000 AS a,
    greatest(completion_tokens, 0) * output_per_million / 1000000 AS b
    FROM llm_usage u LEFT JOIN (SELECT * FROM pricing WHERE input_per_million >= 0 AND output_per_million >= 0) p ON u.model = p.model)"""
register(
    "usage_cost",
    lambda v: usage.usage_cost(v("llm_usage"), v("pricing")).select("request_id", "model", "priced", "currency", "input_cost", "output_cost", "total_cost"),
    with_views("llm_usage", "pricing") + _COST + """
  SELECT request_id, model, priced, currency, round_even(a, 6) AS input_cost, round_even(b, 6) AS output_cost, round_even(a + b, 6) AS total_cost FROM cost""",
)
register(
    "price_usage", lambda v: v("llm_usage").select("request_id", "model").join(v("pricing"), "model", "left"),
    with_views("llm_usage", "pricing") + " SELECT request_id, model, input_per_million, output_per_million, currency FROM llm_usage LEFT JOIN pricing USING (model)",
)
register(
    "usage_by_task", lambda v: usage.usage_by_task(v("llm_usage")),
    with_views("llm_usage") + """ SELECT task_id, request_id, CAST(sum(prompt_tokens) OVER w AS BIGINT) AS prompt_so_far,
    CAST(sum(completion_tokens) OVER w AS BIGINT) AS completion_so_far, CAST(sum(prompt_tokens + completion_tokens) OVER w AS BIGINT) AS total_so_far
  FROM llm_usage WINDOW w AS (PARTITION BY task_id ORDER BY request_id ROWS UNBOUNDED PRECEDING)""",
)
register(
    "batch_totals", lambda v: usage.batch_totals(v("llm_usage"), v("pricing")),
    with_views("llm_usage", "pricing") + _COST + """, t AS (SELECT task_id AS batch_id, count(*) AS total_files, count(*) FILTER (ok) AS successful_files,
    count(*) FILTER (NOT ok) AS failed_files, CAST(coalesce(sum(pages) FILTER (ok), 0) AS BIGINT) AS total_pages,
    CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (ok), 0) AS BIGINT) AS total_tokens, round(coalesce(sum(seconds) FILTER (ok), 0), 6) AS total_seconds,
    coalesce(bool_and(priced) FILTER (ok), false) AS priced, sum(round_even(a + b, 6)) FILTER (ok) AS c, arg_min(currency, request_id) FILTER (ok) AS cur
    FROM cost GROUP BY task_id)
  SELECT batch_id, total_files, successful_files, failed_files, total_pages, total_tokens, total_seconds, priced,
    CASE WHEN priced THEN round(c, 6) END AS total_cost, CASE WHEN priced THEN cur END AS currency FROM t""",
)
register(
    "throughput_report", lambda v: usage.throughput_report(v("history")),
    with_views("history") + """ SELECT coalesce(model, '(all)') AS model, coalesce(CAST(translated AS VARCHAR), '(all)') AS translated, count(*) AS runs,
    CAST(sum(processed_pages) AS BIGINT) AS pages, CAST(sum(total_tokens) AS BIGINT) AS tokens, quantile_cont(processed_pages, 0.5) AS median_pages,
    round(sum(processing_time) / sum(processed_pages), 6) AS seconds_per_page, round(sum(total_tokens) / sum(processed_pages), 6) AS tokens_per_page
  FROM history GROUP BY GROUPING SETS ((model, translated), (model), ())""",
)
register(
    "rate_limit_windows", lambda v: usage.rate_limit_windows(v("bursty_usage")),
    # Request by request: the one 30 places before must have started a minute ago.
    with_views("bursty_usage").replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT request_id, model, epoch_us(ts) AS at_micros, row_number() OVER (PARTITION BY model ORDER BY ts, request_id) AS k FROM bursty_usage),
  s AS (SELECT *, at_micros AS start_micros FROM n WHERE k <= 30
    UNION ALL SELECT n.*, greatest(n.at_micros, s.start_micros + 60000000) FROM s JOIN n ON n.model = s.model AND n.k = s.k + 30)
  SELECT request_id, model, at_micros, start_micros, start_micros = at_micros AS admitted, round((start_micros - at_micros) / 1000000.0, 6) AS wait_seconds FROM s""",
)
register(
    "concurrent_requests", lambda v: usage.concurrent_requests(v("llm_usage")),
    with_views("llm_usage") + """, e AS (SELECT model, epoch_us(ts) AS t, 1 AS d FROM llm_usage
    UNION ALL SELECT model, epoch_us(ts) + CAST(floor(seconds * 1000000) AS BIGINT), -1 FROM llm_usage),
  n AS (SELECT model, t, sum(d) AS d FROM e GROUP BY ALL), r AS (SELECT model, sum(d) OVER (PARTITION BY model ORDER BY t) AS f FROM n)
  SELECT model, CAST(max(f) AS BIGINT) AS peak, count(*) FILTER (f > 4) AS instants_over_limit FROM r GROUP BY model""",
)
_TYPED = """, c AS (SELECT *, CASE WHEN contains(m, 'timeout') THEN 'network_timeout' WHEN contains(m, 'connect') THEN 'network_connect'
      WHEN contains(m, '429') OR contains(m, 'rate limit') OR contains(m, 'too many requests') THEN 'rate_limit'
      WHEN contains(m, '401') OR contains(m, 'auth') OR contains(m, 'unauthorized') THEN 'auth_error'
      WHEN contains(m, '404') OR contains(m, 'not found') THEN 'not_found'
      WHEN contains(m, '500') OR contains(m, '502') OR contains(m, '503') OR contains(m, 'server error') THEN 'server_error' ELSE 'unknown_error' END AS error_type,
    CASE WHEN contains(m, 'timeout') THEN 'network_timeout' WHEN contains(m, 'connect') THEN 'network_connect' WHEN contains(m, '429') THEN 'rate_limit'
      WHEN contains(m, '401') THEN 'auth_error' WHEN contains(m, '404') THEN 'not_found' WHEN contains(m, '5') THEN 'server_error' ELSE 'unknown_error' END AS loose_type
    FROM (SELECT *, lower(message) AS m FROM error_msgs))"""
register("classify_error", lambda v: usage.classify_error(v("error_msgs")),
         with_views("error_msgs") + _TYPED + " SELECT event_id, message, page, recoverable, error_type, loose_type FROM c")
register(
    "retry_plan", lambda v: usage.retry_plan(v("error_msgs")),
    with_views("error_msgs") + _TYPED + """, p(error_type, delays, declared) AS (VALUES ('network_connect', [1, 2, 4], true), ('network_timeout', [2, 4, 8], true),
    ('rate_limit', [5, 10, 15], true), ('server_error', [1, 2, 4], true), ('unknown_error', [1, 2], true), ('auth_error', [1], false), ('not_found', [1], false)),
  x AS (SELECT event_id, error_type, declared, unnest(delays) AS delay_seconds, generate_subscripts(delays, 1) AS attempt FROM c JOIN p USING (error_type))
  SELECT event_id, error_type, attempt, delay_seconds, declared, true AS observed FROM x""",
)
register(
    "error_summary", lambda v: usage.error_summary(v("error_msgs")),
    with_views("error_msgs") + _TYPED + """ SELECT coalesce(error_type, '(all)') AS error_type, count(*) AS errors, count(*) FILTER (recoverable) AS recoverable,
    count(*) FILTER (NOT recoverable) AS non_recoverable, count(DISTINCT page) AS failed_pages FROM c GROUP BY ROLLUP (error_type)""",
)
register(
    "error_page_summary", lambda v: usage.error_page_summary(v("error_msgs"), v("page_warnings")),
    with_views("error_msgs", "page_warnings") + """, e AS (SELECT page, count(*) AS errors, bool_or(recoverable) AS r FROM error_msgs GROUP BY page),
  w AS (SELECT page, count(*) AS warnings FROM page_warnings GROUP BY page)
  SELECT page, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(r, false) AS is_recoverable FROM e FULL JOIN w USING (page)""",
)

# ---- cache -------------------------------------------------------------------------------------------------------

_KEY = """concat(md5(text), CASE WHEN pages IS NULL THEN '' ELSE '_p' || array_to_string(list_sort(list_transform(string_split(pages, ','), lambda p: CAST(p AS INT))), '-') END,
    CASE WHEN translate THEN '_tr' ELSE '' END)"""
_PUT = ", put AS (SELECT cache_key, arg_max(stored_at, seq) AS stored_at, arg_max(size_bytes, seq) AS size_bytes, max(seq) AS seq FROM cache GROUP BY cache_key)"
_OLD = f"epoch_us(TIMESTAMP '{CACHE_TIME}') - epoch_us(stored_at) > 604800000000"


def _stamped(df):
    return df.withColumn("stored_at", F.date_format("stored_at", STAMP))


_STAMPED = "strftime(stored_at, '%Y-%m-%d %H:%M:%S.%f') AS stored_at"
register("cache_keys", lambda v: cache.cache_keys(v("cache_requests")), with_views("cache_requests") + f" SELECT doc_id, {_KEY} AS cache_key FROM cache_requests")
register(
    "cache_lookup", lambda v: cache.cache_lookup(v("cache_requests"), v("cache"), CACHE_TIME),
    with_views("cache_requests", "cache") + _PUT + f""", k AS (SELECT doc_id, {_KEY} AS cache_key FROM cache_requests)
  SELECT doc_id, cache_key, CASE WHEN stored_at IS NULL THEN 'miss' WHEN {_OLD} THEN 'expired' ELSE 'hit' END AS outcome FROM k LEFT JOIN put USING (cache_key)""",
)
register("cache_put", lambda v: _stamped(cache.cache_put(v("cache"))), with_views("cache") + _PUT + f" SELECT cache_key, {_STAMPED}, size_bytes, seq FROM put")
register("cache_purge", lambda v: _stamped(cache.cache_purge(v("cache"), CACHE_TIME, v("documents").where("lang = 'en'"))),
         with_views("cache") + _PUT + f""" SELECT cache_key, {_STAMPED}, size_bytes, seq FROM put WHERE NOT ({_OLD})
  AND cache_key NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en')""")
register("cache_info", lambda v: cache.cache_info(v("cache"), CACHE_TIME),
         with_views("cache") + _PUT + f" SELECT count(*) AS entries, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size_bytes, count(*) FILTER ({_OLD}) AS expired FROM put")

# ---- history and preferences -------------------------------------------------------------------------------------

register("history_retain", lambda v: history.history_retain(v("history")),
         with_views("history") + " SELECT seq, filename, output_file, row_number() OVER (ORDER BY seq DESC) <= 20 AS kept FROM history")
register(
    "history_page", lambda v: history.history_page(v("history"), 10, 5).select("seq", "filename", "model", "pages", "position", "total"),
    with_views("history") + """, r AS (SELECT *, row_number() OVER (ORDER BY seq DESC) - 1 AS position FROM history)
  SELECT seq, filename, model, pages, position, 20 AS total FROM r WHERE position BETWEEN 5 AND 14""",
)
_CHOICES = """, c AS (SELECT 'model' AS kind, model AS name, seq FROM history UNION ALL SELECT 'template', template, seq FROM history WHERE template IS NOT NULL),
  u AS (SELECT kind, name, count(*) AS uses, min(seq) AS first_seen FROM c GROUP BY kind, name)"""
register("preference_usage", lambda v: history.preference_usage(v("history")), with_views("history") + _CHOICES + " SELECT kind, name, uses FROM u")
register(
    "preferred_choice", lambda v: history.preferred_choice(v("history")),
    with_views("history") + _CHOICES + """ SELECT kind, name, uses FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY uses DESC, first_seen) AS k FROM u)
  WHERE k = 1 AND uses >= 2""",
)
register(
    "preference_flags", lambda v: history.preference_flags(v("history")),
    with_views("history") + """, r AS (SELECT list([pages] ORDER BY seq) AS used FROM history WHERE pages <> 'all')
  SELECT bool_or(translated) AS default_translate, arg_max(quality_mode, seq) FILTER (quality_mode IS NOT NULL) AS quality_mode,
    (SELECT array_to_string(list_reduce(used, lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE (a || x)[-5:] END), ';') FROM r) AS page_ranges FROM history""",
)
_TERMS = f""", e AS (SELECT seq, lower({S.strip('source')}) AS source, {S.strip('target')} AS target, deleted FROM term_events),
  l AS (SELECT source, arg_max(target, seq) AS target, arg_max(deleted, seq) AS deleted FROM e WHERE deleted OR target <> '' GROUP BY source),
  terms AS (SELECT source, target FROM l WHERE NOT deleted)"""
register("terminology_latest", lambda v: history.terminology_latest(v("term_events")), with_views("term_events") + _TERMS + " SELECT source, target FROM terms")
register("terminology_prompt", lambda v: history.terminology_prompt(v("term_events")),
         with_views("term_events") + _TERMS + f" SELECT source, concat('  ', source, ' -> ', target) AS line FROM terms UNION ALL SELECT '', '{history.TERMINOLOGY_HEADER}'")
register(
    "preference_updates", lambda v: history.preference_updates(v("preference_updates")),
    with_views("preference_updates") + """ SELECT pref_key, arg_max(pref_value, seq) AS pref_value, count(*) AS accepted FROM preference_updates
  WHERE pref_key IN ('default_translate', 'terminology', 'template_usage', 'model_usage') OR (pref_key = 'quality_mode' AND pref_value IN ('standard', 'high'))
  GROUP BY pref_key""",
)
register(
    "new_cjk_terms", lambda v: history.new_cjk_terms(v("corrections")),
    with_views("corrections") + """, t AS (SELECT doc_id, regexp_extract_all(original, '[\\x{4e00}-\\x{9fff}]+') AS o, regexp_extract_all(corrected, '[\\x{4e00}-\\x{9fff}]+') AS c FROM corrections)
  SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: NOT list_contains(o, x)))), ',') AS terms FROM t""",
)
register("orphan_files", lambda v: history.orphan_files(v("output_files"), v("history")),
         with_views("output_files", "history") + " SELECT name FROM output_files WHERE concat('/out/', name) NOT IN (SELECT output_file FROM history)")

# ---- tasks -------------------------------------------------------------------------------------------------------


def _task_rows(df):
    return df.withColumns({c: F.date_format(c, STAMP) for c in ("created_at", "updated_at")})


_LATEST = """, latest AS (SELECT task_id, arg_max(status, event_id) AS status, arg_max(current_n, event_id) AS current_n, arg_max(total_n, event_id) AS total_n,
    min(ts) AS created, max(ts) AS updated, count(*) AS updates FROM task_events GROUP BY task_id),
  task_rows AS (SELECT task_id, status, current_n, total_n, CASE WHEN total_n > 0 THEN CAST(floor(current_n / CAST(total_n AS DOUBLE) * 100) AS INT) ELSE 0 END AS percent,
    strftime(created, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(updated, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, updates, updated FROM latest)"""
_FIELDS = "task_id, status, current_n, total_n, percent, created_at, updated_at, updates"
_TASKS = with_views("task_events") + _LATEST


def _state(v):
    return tasks.task_latest_state(v("task_events"))


def _pruned(terminal: str, ttl: int, cap: int) -> str:
    return _TASKS + f""", alive AS (SELECT * FROM task_rows WHERE status NOT IN ({terminal}) OR epoch_us(TIMESTAMP '{TASK_TIME}') - epoch_us(updated) <= {ttl}000000),
  ended AS (SELECT *, row_number() OVER (ORDER BY updated, task_id) AS oldest FROM alive WHERE status IN ({terminal}))
  SELECT {_FIELDS} FROM alive WHERE task_id NOT IN (SELECT task_id FROM ended WHERE oldest <= (SELECT count(*) - {cap} FROM alive))"""


register("task_latest_state", lambda v: _task_rows(_state(v)), _TASKS + f" SELECT {_FIELDS} FROM task_rows")
register("task_interrupted", lambda v: _task_rows(tasks.task_interrupted(_state(v))),
         _TASKS + f""" SELECT {_FIELDS.replace('status', "CASE WHEN a THEN 'failed' ELSE status END AS status")}, CASE WHEN a THEN '{tasks.INTERRUPTED}' ELSE '' END AS error
  FROM (SELECT *, status IN ('processing', 'extracting', 'converting', 'translating') AS a FROM task_rows)""")
register("task_prune", lambda v: _task_rows(tasks.task_prune(_state(v), TASK_TIME, max_tasks=100)), _pruned("'completed', 'failed', 'cancelled'", 604800, 100))
register("task_prune_memory", lambda v: _task_rows(tasks.task_prune(_state(v), "2024-01-30 23:00:00", tasks.MEMORY_TTL_SECONDS, 100, tasks.MEMORY_TERMINAL)),
         _pruned("'completed', 'error', 'failed'", 3600, 100).replace(TASK_TIME, "2024-01-30 23:00:00"))
register("task_list", lambda v: _task_rows(tasks.task_list(_state(v))), _TASKS + f" SELECT {_FIELDS} FROM task_rows ORDER BY updated DESC, task_id LIMIT 50")
register("task_status_counts", lambda v: tasks.task_status_counts(v("task_events")),
         with_views("task_events") + " SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, status, count(*) AS events FROM task_events GROUP BY ALL")
_RANK = "CASE status WHEN 'extracting' THEN 3 WHEN 'translating' THEN 4 WHEN 'converting' THEN 4 WHEN 'completed' THEN 5 WHEN 'error' THEN 5 ELSE 0 END"
register(
    "phase_monotone", lambda v: tasks.phase_monotone(v("task_events")),
    with_views("task_events") + f""", r AS (SELECT *, {_RANK} AS rank FROM task_events),
  m AS (SELECT *, max(rank) OVER (PARTITION BY task_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r)
  SELECT task_id, event_id, status, rank FROM m WHERE status = 'error' OR rank >= coalesce(reached, 0)""",
)
register("incomplete_tasks", lambda v: _task_rows(tasks.incomplete_tasks(_state(v))), _TASKS + f" SELECT {_FIELDS} FROM task_rows WHERE status <> 'completed'")
register(
    "resumable_tasks",
    lambda v: tasks.resumable_tasks(_state(v).withColumn("source_file", F.concat(F.lit("c"), F.substring("task_id", 2, 20), F.lit(".pdf"))), v("source_files"))
    .select("task_id", "status", "source_file"),
    with_views("task_events", "source_files") + _LATEST + """ SELECT task_id, status, concat('c', substr(task_id, 2), '.pdf') AS source_file FROM task_rows
  WHERE status NOT IN ('processing', 'extracting', 'converting', 'translating', 'completed') AND concat('c', substr(task_id, 2), '.pdf') IN (SELECT name FROM source_files)""",
)
