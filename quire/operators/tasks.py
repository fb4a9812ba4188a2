"""The task store: events folded to states, retention, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.blocks import with_running

# Status sets, ranks, retention, messages.
ACTIVE = ["processing", "extracting", "converting", "translating"]
TERMINAL = ["completed", "failed", "cancelled"]
MEMORY_TERMINAL = ["completed", "error", "failed"]
RANKS = {"preparing": 0, "uploading": 1, "processing": 2, "extracting": 3, "translating": 4, "converting": 4, "completed": 5, "error": 5}
TTL_SECONDS = 604_800
MEMORY_TTL_SECONDS = 3_600
MAX_TASKS = 200
LIST_LIMIT = 50
INTERRUPTED = "服务重启导致任务中断，请点击重试以继续。"


def percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(current / total * 100)).otherwise(0).cast("int")


def rank(status: Column) -> Column:
    value = F.lit(0)
    for name, number in RANKS.items():
        value = F.when(status == name, number).otherwise(value)
    return value


def task_latest_state(events: DataFrame) -> DataFrame:
    """One row per task: its last event, combined map-side."""
    fields = F.struct("status", "current_n", "total_n", F.col("ts").alias("updated_at"))
    folded = events.groupBy("task_id").agg(
        F.max_by(fields, F.struct("ts", "event_id")).alias("s"), F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("updates"))
    return folded.select("task_id", "s.status", "s.current_n", "s.total_n", percent(F.col("s.current_n"), F.col("s.total_n")).alias("percent"),
                         "created_at", "s.updated_at", "updates")


def task_interrupted(tasks: DataFrame) -> DataFrame:
    """Tasks caught at work by a restart become failed, so that they can be resumed."""
    active = F.col("status").isin(ACTIVE)
    return tasks.withColumns({"error": F.when(active, INTERRUPTED).otherwise(""), "status": F.when(active, "failed").otherwise(F.col("status"))})


def task_prune(
    tasks: DataFrame, as_of: str, ttl_seconds: int = TTL_SECONDS, max_tasks: int = MAX_TASKS, terminal: list[str] | None = None
) -> DataFrame:
    """Tasks that stay: expired terminal ones go, then the oldest terminal ones until ``max_tasks`` are left.

    The store keeps the newest ``max_tasks - active`` terminal tasks, so a top-k of ``max_tasks`` rows holds all
    that can stay; no ranking runs over the whole store.  A missing time counts as the oldest.
    """
    ended = F.col("status").isin(terminal or TERMINAL)
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    alive = tasks.where(~ended | (F.coalesce(age, F.lit(2**62)) <= ttl_seconds * 1_000_000))
    active = alive.where(~ended)
    newest = alive.where(ended).orderBy(F.desc_nulls_last("updated_at"), F.desc("task_id")).limit(max_tasks)
    order = F.sort_array(F.collect_list(F.struct("updated_at", "task_id")), asc=False)
    room = F.greatest(F.lit(0), F.lit(max_tasks) - active.agg(F.count(F.lit(1))).scalar())
    ranked = newest.agg(order.alias("ids")).select(F.posexplode_outer("ids").alias("i", "t")).select("i", "t.task_id")
    kept = newest.join(F.broadcast(ranked.where(F.col("i") < room).select("task_id")), "task_id", "left_semi")
    return active.unionByName(kept)


def task_list(tasks: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The most recently updated tasks."""
    return tasks.orderBy(F.desc("updated_at"), F.asc("task_id")).limit(max(1, limit))


def task_status_counts(events: DataFrame) -> DataFrame:
    """Events per hour and status."""
    hour = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    return events.groupBy(hour.alias("hour"), "status").agg(F.count(F.lit(1)).alias("events"))


def phase_monotone(events: DataFrame) -> DataFrame:
    """Events whose phase is not behind the furthest phase already reported; errors always pass."""
    ranked = events.withColumn("rank", rank(F.col("status")))
    seen = with_running(ranked, ["task_id"], "event_id", {"reached": (F.col("rank"), F.max)}, exclusive=True)
    passes = (F.col("status") == "error") | (F.col("rank") >= F.coalesce("reached", F.lit(0)))
    return seen.where(passes).select("task_id", "event_id", "status", "rank")


def incomplete_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") != "completed")


def resumable_tasks(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks that neither run nor are done and whose source file is still there."""
    idle = tasks.where(~F.col("status").isin([*ACTIVE, "completed"]))
    return idle.join(files.select(F.col("name").alias("source_file")).distinct(), "source_file", "left_semi")
