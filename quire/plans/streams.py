"""Streams, sinks and table functions: queries and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunks
from quire.plans.layout import _ASSEMBLED
from quire.plans.operations import _COST, _LATEST, _RANK, _FIELDS, STAMP, _task_rows
from quire.plans.registry import register
from quire.plans.views import VIEWS, with_views
from quire.sources import sinks
from quire.streaming import progress


def _run(v, name: str, job, mode: str, rows: int | None = None) -> DataFrame:
    """What a job emits over a view of the events, replayed as a stream."""
    replay = progress.Replay(v("events"), rows or progress.ROWS_PER_BATCH)
    stream = VIEWS[name].build(lambda n: replay.stream if n == "events" else v(n))
    return progress.run_to_table(job(stream), mode, name, replay)


def _twice(df: DataFrame) -> DataFrame:
    """Every row delivered twice, by one source, so both come in one micro-batch."""
    return df.unionByName(df)


def _stamp(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, STAMP) for c in columns}).drop(progress.BATCH_COLUMN)


register(
    "stream_task_progress",
    lambda v: _task_rows(progress.last_update(_run(v, "task_events", progress.task_progress, "update"), ["task_id"])),
    with_views("task_events") + _LATEST + f" SELECT {_FIELDS} FROM task_rows",
)
register(
    "stream_phase_monotone",
    lambda v: _run(v, "task_events", progress.phase_monotone, "append").drop(progress.BATCH_COLUMN),
    with_views("task_events") + f""", r AS (SELECT *, {_RANK} AS rank FROM task_events),
  m AS (SELECT *, max(rank) OVER (PARTITION BY task_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r)
  SELECT task_id, event_id, status, rank FROM m WHERE status = 'error' OR rank >= coalesce(reached, 0)""",
)
register(
    "stream_rate_limit",
    lambda v: _stamp(progress.last_update(_run(v, "llm_usage", progress.rate_limit, "update"), ["model", "window_start"]), "window_start"),
    with_views("llm_usage") + """, w AS (SELECT model, make_timestamp((epoch_us(ts) // 10000000 - k) * 10000000) AS s FROM llm_usage, (SELECT unnest(range(0, 6)) AS k))
  SELECT model, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS requests, count(*) > 30 AS over_limit FROM w GROUP BY ALL""",
)
register(
    "stream_usage_cost",
    lambda v: _stamp(progress.last_update(_run(v, "llm_usage", lambda s: progress.usage_cost(s, v("pricing")), "update"), ["task_id", "hour"]), "hour"),
    with_views("llm_usage", "pricing") + _COST + """ SELECT task_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
    CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(round_even(a + b, 6)), 6) AS total_cost FROM cost GROUP BY ALL""",
)
# A session is emitted once the watermark, one minute behind the last event, has passed its end.
register(
    "stream_task_sessions",
    lambda v: _stamp(_run(v, "task_events", progress.task_sessions, "append"), "started", "closed"),
    with_views("task_events") + """, g AS (SELECT task_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS opens FROM task_events),
  s AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY task_id ORDER BY ts) AS n FROM g),
  c AS (SELECT task_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS closed, count(*) AS events FROM s GROUP BY task_id, n)
  SELECT task_id, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(closed, '%Y-%m-%d %H:%M:%S.%f') AS closed, events FROM c
  WHERE closed <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 MINUTE FROM task_events)""",
)
register(
    "stream_dedupe_requests",
    lambda v: _run(v, "task_events", lambda s: progress.dedupe_requests(_twice(s)).select("event_id", "task_id", "status"), "append")
    .drop(progress.BATCH_COLUMN),
    with_views("task_events") + " SELECT event_id, task_id, status FROM task_events",
)
register(
    "stream_task_ttl",
    lambda v: _run(v, "task_events", progress.task_ttl, "append").drop(progress.BATCH_COLUMN),
    # The next event of the task, or else the watermark one minute behind the last event of all, comes more than an hour later.
    with_views("task_events") + """, l AS (SELECT task_id, status, epoch_us(ts) AS updated_micros, epoch_us(lead(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id)) AS later FROM task_events)
  SELECT task_id, status, updated_micros FROM l WHERE status IN ('completed', 'error', 'failed') AND CASE WHEN later IS NOT NULL THEN later - updated_micros > 3600000000
  ELSE updated_micros // 1000 + 3600000 < (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM task_events) END""",
)

# ---- sinks -------------------------------------------------------------------------------------------------------


def _written(v) -> DataFrame:
    blocks = chunks.assemble_document(v("page_text"), v("page_results"))
    path = sinks.scratch(blocks.sparkSession, "documents")
    sinks.write_tex_corpus(blocks, path)
    lines = sinks.read_tex_corpus(blocks.sparkSession, path)
    return lines.groupBy("book").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


register(
    "write_tex_corpus", _written,
    with_views("page_text", "page_results") + _ASSEMBLED + """, l AS (SELECT book, unnest(string_split(concat(block, 'x'), chr(10))) AS line, generate_subscripts(string_split(concat(block, 'x'), chr(10)), 1) AS i,
    len(string_split(block, chr(10))) AS n FROM blocks)
  SELECT book, count(*) AS lines, CAST(sum(length(CASE WHEN i = n THEN '' ELSE line END)) AS BIGINT) AS chars FROM l GROUP BY book""",
)


def _reread(v) -> DataFrame:
    history = v("history").withColumn("total_cost", F.when(F.col("seq") % 3 > 0, F.col("total_tokens") / 1000000))
    path = sinks.scratch(history.sparkSession, "history")
    sinks.write_history_json(history, path)
    return _stamp(sinks.scan_history_json(history.sparkSession, path), "ts")


register(
    "scan_history_json", _reread,
    with_views("history") + """ SELECT seq, filename, model, template, translated, pages, quality_mode, output_file, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
    total_pages, processed_pages, total_tokens, processing_time, CASE WHEN seq % 3 > 0 THEN total_tokens / 1000000.0::DOUBLE END AS total_cost FROM history""",
)
