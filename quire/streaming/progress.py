"""Structured Streaming jobs over task events and requests.

Every job is a function from a streaming DataFrame to a streaming DataFrame.  ``run_to_table`` drives one until its
input is used up and keeps the result as a table, so nothing passes through the driver.  ``Replay`` turns a stored table into a stream
in order of event time.  Jobs with a state of their own keep it in a persistent state store, a few fields per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators import tasks, usage
from quire.operators.blocks import with_blocks
from quire.sources.sinks import scratch

# Lateness, window and gap lengths.
LATENESS = "1 minute"
RATE_WINDOW, RATE_SLIDE = "60 seconds", "10 seconds"
COST_WINDOW = "1 hour"
SESSION_GAP = "30 minutes"
DEDUPE_WITHIN = "1 hour"
BATCH_COLUMN = "batch_id"
# Rows that a replayed micro-batch holds, and seconds of event time after which a silent task leaves the state.
ROWS_PER_BATCH = 1_000_000
ROW_GROUP_BYTES = 4 << 20
PROGRESS_TTL_SECONDS = 30 * 86_400
# Parts into which tasks are dealt, each one key of the state; events of a part that wait in memory for the end of a micro-batch.
BUCKETS = 512
HELD_ROWS = 100_000
_FIRST = -(1 << 63)
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PERSISTENT = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replay:
    """A stored table of events as a stream, in order of event time, about ``rows`` rows a micro-batch.

    The part files of a table may each cover all of its time, so reading them in any order would make most rows late.  So the
    table is cut into slices of equal count by (``ts``, ``event_id``), each a folder of its own, and ``advance`` lets one slice
    after the other arrive in the folder that ``stream`` watches.  Neither the number of files nor their times matter.  A slice
    is one file and is moved there, hence it comes in one micro-batch.  Slices that have arrived already are skipped, so a replay that was
    interrupted goes on where it stood: make it with the ``path`` of the first one.
    Rows without a time come first.
    """

    def __init__(self, events: DataFrame, rows: int = ROWS_PER_BATCH, path: str | None = None):
        self.spark = events.sparkSession
        self.path = path or scratch(self.spark, "replay")
        if path is None:
            place = events.withColumn("__place", F.struct("ts", "event_id"))
            cut = with_blocks(place, [], "__place", rows).withColumnRenamed("__block", "slice").drop("__place", "__tie")
            # Several row groups, so that several tasks read the file of a slice.
            cut.repartition("slice").write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("slice").parquet(f"{self.path}/slices")
            # The watched folder exists from the start.
            events.limit(0).withColumn("slice", F.lit(-1)).write.parquet(f"{self.path}/arrived/slice=-1")
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
        watched = self.spark.readStream.schema(f"{self.schema}, slice int").parquet(f"{self.path}/arrived")
        self.stream = watched.drop("slice").withColumn("ts", F.col("ts").cast("timestamp"))

    def _slices(self, folder: str) -> set[int]:
        """Numbers of the slices in a folder; they are bounded in number."""
        found = self.spark.read.schema(f"{self.schema}, slice int").parquet(f"{self.path}/{folder}")
        return {r[0] for r in found.select("slice").distinct().collect()}

    def waiting(self) -> list[int]:
        """Slices that have not arrived, in order."""
        return sorted(self._slices("slices") - self._slices("arrived"))

    def advance(self, number: int) -> None:
        """Let one slice arrive: its folder, written by one task, changes its place."""
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        here, there = (paths(f"{self.path}/{folder}/slice={number}") for folder in ("slices", "arrived"))
        files = here.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.rename(here, there):
            raise OSError(f"slice {number} of {self.path} cannot arrive")


def run_to_table(stream: DataFrame, mode: str, name: str, replay: Replay | None = None, path: str | None = None, slices: int | None = None) -> DataFrame:
    """Process all input and return what was emitted, with the batch each row came from.

    With a ``replay`` its slices arrive one after the other (the next ``slices`` of them, if given); without one, what the source holds is processed.
    Each micro-batch writes its own folder, overwriting it when the batch is retried: the result is exactly-once.  With the
    ``path`` of an earlier run the job goes on from that run's checkpoint.
    """
    spark = stream.sparkSession
    first = path is None
    path = path or scratch(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{BATCH_COLUMN}={batch_id}")

    # An input without files runs no batch; the table then exists and is empty.
    if first:
        write(spark.createDataFrame([], stream.schema), -1)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, PERSISTENT)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write)
    try:
        if replay is None:
            writer.trigger(availableNow=True).start().awaitTermination()
        else:
            query = writer.start()
            try:
                for number in replay.waiting()[:slices]:
                    replay.advance(number)
                    query.processAllAvailable()
                query.processAllAvailable()
            finally:
                query.stop()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, {BATCH_COLUMN} bigint"
    return spark.read.schema(schema).parquet(f"{path}/rows")


def last_update(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The final value of each key from update-mode output."""
    values = [c for c in emitted.columns if c not in (*keys, BATCH_COLUMN)]
    folded = emitted.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH_COLUMN).alias("v"))
    return folded.select(*keys, "v.*")


class _Tasks(StatefulProcessor):
    """The tasks of one bucket, ``BUCKETS`` in all: one value holds a column per field, in which each task has its place.

    A key of its own for every task would cost several calls of the state store per task and micro-batch; a bucket costs a few for all its tasks.
    Tasks leave ``ttl_seconds`` of event time after their last event (the field ``updated``, microseconds).  A bucket has one timer, no later than
    the first of its tasks is due; when it fires, all that are due leave, and the next is set.
    """

    fields: dict[str, str]

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{name} array<{kind}>" for name, kind in self.fields.items())
        self.value = handle.getValueState("tasks", f"task_id array<string>, {columns}, timer bigint")

    def load(self) -> tuple[dict[str | None, tuple], int | None]:
        """The fields of each task, and the time of the timer."""
        if not self.value.exists():
            return {}, None
        ids, *columns, timer = self.value.get()
        return dict(zip(ids, zip(*columns))), timer

    def store(self, tasks: dict[str | None, tuple], timer: int | None, timers) -> None:
        if not tasks:
            self.value.clear()
            return
        columns = [list(column) for column in zip(*tasks.values())]
        due = max(min(columns[[*self.fields].index("updated")]) // 1000 + self.ttl, timers.getCurrentWatermarkInMs() + 1)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.value.update((list(tasks), *columns, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        tasks, _ = self.load()
        at, passed = [*self.fields].index("updated"), timerValues.getCurrentWatermarkInMs()
        self.store({task: last for task, last in tasks.items() if last[at] // 1000 + self.ttl >= passed}, None, timerValues)
        return iter(())

    def close(self) -> None:
        pass


def _int(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


_PROGRESS = ("task_id array<string>, status array<string>, current_n array<bigint>, total_n array<bigint>, updated array<bigint>, created array<bigint>, "
             "event_id array<bigint>, updates array<bigint>")


def _keep_progress(ttl: int):
    """Folds the events of a bucket into its tasks: a column per field in the state, in which each task has its place.  Numbers are never null, but ``_FIRST``.

    State and rows come in one Arrow batch, so a bucket costs no calls of the state store.  Tasks leave ``ttl`` milliseconds of event time after
    their last event (the field ``updated``, microseconds): a bucket has one timeout, when the first of its tasks is due.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tasks: dict[str | None, tuple] = {}
        if state.exists:
            ids, *columns = state.get
            tasks = dict(zip(ids, zip(*columns)))
        touched: dict[str | None, None] = {}
        watermark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            tasks = {task: last for task, last in tasks.items() if last[3] // 1000 + ttl >= watermark}
        else:
            for part in parts:
                columns = (part[c].tolist() for c in ("task_id", "event_id", "status", "current_n", "total_n", "at"))
                for task, event, status, current, total, at in zip(*columns):
                    last = tasks.get(task)
                    if last is None:
                        tasks[task] = (status, current, total, at, at, event, 1)
                    elif (at, event) >= (last[3], last[5]):
                        tasks[task] = (status, current, total, at, min(at, last[4]), event, last[6] + 1)
                    else:
                        tasks[task] = (*last[:4], min(at, last[4]), last[5], last[6] + 1)
                    touched[task] = None
        if not tasks:
            state.remove()
            return
        columns = [list(column) for column in zip(*tasks.values())]
        state.update((list(tasks), *columns))
        state.setTimeoutTimestamp(max(min(columns[3]) // 1000 + ttl, watermark, 1))
        if touched:
            status, current, total, updated, created, _, updates = zip(*[tasks[task] for task in touched])
            yield pd.DataFrame({"task_id": list(touched), "status": status, "current_n": current, "total_n": total, "created": created, "updated": updated, "updates": updates})

    return fold


def task_progress(events: DataFrame, ttl_seconds: int = PROGRESS_TTL_SECONDS) -> DataFrame:
    """Live state per task; update mode.

    The state is one row per task and leaves ``ttl_seconds`` of event time after the task's last event.  Events without a time are left out.
    """
    # An event without a number comes first among those of its time.  A column without nulls stays one of integers in pandas.
    number = {c: F.coalesce(F.col(c).cast(kind).cast("bigint"), F.lit(_FIRST)) for c, kind in (("event_id", "bigint"), ("current_n", "int"), ("total_n", "int"))}
    staged = events.withWatermark("ts", LATENESS).where("ts IS NOT NULL").select(
        _bucket(), "task_id", number["event_id"].alias("event_id"), "status", number["current_n"].alias("current_n"), number["total_n"].alias("total_n"), "ts",
        F.unix_micros("ts").alias("at"))
    folded = staged.groupBy("bucket").applyInPandasWithState(
        _keep_progress(ttl_seconds * 1000), "task_id string, status string, current_n bigint, total_n bigint, created bigint, updated bigint, updates bigint",
        _PROGRESS, "update", GroupStateTimeout.EventTimeTimeout)
    counts = {c: F.when(F.col(c) != _FIRST, F.col(c)).cast("int") for c in ("current_n", "total_n")}
    return folded.withColumns(counts).select("task_id", "status", "current_n", "total_n", tasks.percent(F.col("current_n"), F.col("total_n")).alias("percent"),
                         F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("updated").alias("updated_at"), "updates")


def rate_limit(requests: DataFrame, limit: int = usage.REQUESTS_PER_MINUTE) -> DataFrame:
    """Requests per model in sliding windows; update mode."""
    counted = requests.withWatermark("ts", LATENESS).groupBy("model", F.window("ts", RATE_WINDOW, RATE_SLIDE)).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("model", F.col("window.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("over_limit"))


def usage_cost(requests: DataFrame, pricing: DataFrame) -> DataFrame:
    """Tokens and cost per task and hour, priced by a static table; update mode."""
    priced = usage.usage_cost(requests.withWatermark("ts", LATENESS), pricing)
    summed = priced.groupBy("task_id", F.window("ts", COST_WINDOW)).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum("total_cost"), 6).alias("total_cost"))
    return summed.select("task_id", F.col("window.start").alias("hour"), "prompt_tokens", "completion_tokens", "total_cost")


def task_sessions(events: DataFrame) -> DataFrame:
    """Bursts of activity per task; a session that has closed is emitted once.  Append mode."""
    sessions = events.withWatermark("ts", LATENESS).groupBy("task_id", F.session_window("ts", SESSION_GAP)).agg(F.count(F.lit(1)).alias("events"))
    return sessions.select("task_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("closed"), "events")


def dedupe_requests(events: DataFrame) -> DataFrame:
    """Each event once, however often it is delivered within the watermark.  Append mode."""
    return events.withWatermark("ts", DEDUPE_WITHIN).dropDuplicatesWithinWatermark(["event_id"])


class _Phases(_Tasks):
    """Ranks are few, so what decides over an event is small: for each task and rank, the first event of this micro-batch that reaches it."""

    fields = {"reached": "int", "updated": "bigint"}
    ROW = ["task_id", "event_id", "status", "rank"]

    def __init__(self, ttl_seconds: int, held_rows: int):
        super().__init__(ttl_seconds)
        self.held_rows = held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.spilled = handle.getListState("spilled", "task_id string, event_id bigint, status string, rank int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        tasks, timer = self.load()
        first: dict[str | None, dict[int, int]] = {}
        held: list[tuple] = []
        spilled = False

        def passed(events: list[tuple]) -> list[tuple]:
            return [e for e in events if e[2] == "error" or e[3] >= reached.get(e[0], 0) and not any(
                rank > e[3] and (e[1] is None or event < e[1]) for rank, event in first[e[0]].items())]

        def frame(events: list[tuple]) -> pd.DataFrame:
            columns = dict(zip(self.ROW, map(list, zip(*events))))
            return pd.DataFrame(columns | {"event_id": pd.array(columns["event_id"], "Int64")})

        # An event that comes later may be an earlier one, so events wait for the end of the micro-batch.  Beyond
        # ``held_rows`` they wait in the state store.
        reached = {task: last[0] for task, last in tasks.items()}
        for part in rows:
            for task, event, status, rank, at in zip(*(part[c].tolist() for c in (*self.ROW, "at"))):
                event = _int(event)
                highest, latest = tasks.get(task, (0, at))
                tasks[task] = (max(highest, rank), max(latest, at))
                ranks = first.setdefault(task, {})
                if event is not None and event < ranks.get(rank, event + 1):
                    ranks[rank] = event
                held.append((task, event, status, rank))
            if len(held) > self.held_rows:
                held = passed(held)
            if len(held) > self.held_rows:
                self.spilled.appendList(held)
                held, spilled = [], True
        if spilled:
            kept: list[tuple] = []
            for row in self.spilled.get():
                kept.append(tuple(row))
                if len(kept) == 10_000:
                    if kept := passed(kept):
                        yield frame(kept)
                    kept = []
            held = [*kept, *held]
            self.spilled.clear()
        if held := passed(held):
            yield frame(held)
        self.store(tasks, timer, timerValues)


def phase_monotone(events: DataFrame, ttl_seconds: int = tasks.TTL_SECONDS, held_rows: int = HELD_ROWS) -> DataFrame:
    """Events not behind the furthest phase of their task, in the order of ``event_id`` inside a micro-batch.  Append mode.

    The state is one rank per task; it expires by event time, ``ttl_seconds`` after the task's last event.  Events without a time are left out.
    More than ``held_rows`` events of a bucket of tasks in one micro-batch wait in the state store.
    """
    ranked = events.withWatermark("ts", LATENESS).where("ts IS NOT NULL").select(
        _bucket(), "task_id", "event_id", "status", "ts", tasks.rank(F.col("status")).alias("rank"), F.unix_micros("ts").alias("at"))
    return ranked.groupBy("bucket").transformWithStateInPandas(
        _Phases(ttl_seconds, held_rows), "task_id string, event_id bigint, status string, rank int", "Append", "EventTime")


def task_ttl(events: DataFrame, ttl_seconds: int = tasks.MEMORY_TTL_SECONDS, terminal: list[str] | None = None) -> DataFrame:
    """Each time that a task stays in a terminal state for longer than ``ttl_seconds`` of event time: its status and last update.

    A stretch of activity of a task is a session that ends with an event which nothing follows for ``ttl_seconds``; only its last event
    (by ``ts`` and ``event_id``) counts.  A task that comes back after that begins anew.  Append mode; events without a time are left out.
    """
    staged = events.withWatermark("ts", LATENESS).where("ts IS NOT NULL").select("task_id", "event_id", "status", "ts")
    # A stretch is over once the watermark is past its last event by more than the time to live.  Spark joins sessions that touch,
    # so an event a single microsecond later than the time to live still belongs to the stretch.
    gap = f"{ttl_seconds} seconds 1 microsecond"
    stretches = staged.groupBy("task_id", F.session_window("ts", gap)).agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.unix_micros(F.max("ts")).alias("updated_micros"))
    ended = F.col("status").isin(terminal or tasks.MEMORY_TERMINAL)
    return stretches.where(ended).select("task_id", "status", "updated_micros")
