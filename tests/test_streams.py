"""Streams fed in several micro-batches against their batch twins."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import check
from quire.functions.udtf import register_functions
from quire.operators import tasks, tex
from quire.plans.registry import QUERIES, run
from quire.plans.views import VIEWS, view
from quire.streaming import progress

FOLDER = "/root/testdata/sf0.001"
STREAMS = [n for n in QUERIES if n.startswith("stream_")]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """The events as folders of part files that each cover all of the time."""
    folder = tmp_path_factory.mktemp("mixed")
    for files in (1, 16, 17, 200):
        view(spark, FOLDER, "events").repartition(files, "event_id").write.parquet(f"{folder}/{files}/events.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def once(spark):
    """Every stream over the single file, in a single slice."""
    return {name: _checked(run(name, spark, FOLDER)) for name in STREAMS}


def _checked(df):
    return check.rows_of(df.columns, [tuple(r) for r in df.collect()])


def _rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def _events(spark):
    return view(spark, FOLDER, "task_events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(replay):
    return VIEWS["task_events"].build(lambda n: replay.stream)


@pytest.mark.parametrize("name", STREAMS)
def test_slices_in_micro_batches(spark, mixed, once, monkeypatch, name):
    """Part files in no order of time, replayed in four slices: no row is late, and all ends as in one slice."""
    monkeypatch.setattr(progress, "ROWS_PER_BATCH", 250)
    assert once[name] and _checked(run(name, spark, f"{mixed}/17")) == once[name]


@pytest.mark.parametrize("files", [1, 16, 200])
def test_any_number_of_files(spark, mixed, once, files):
    assert _checked(run("stream_phase_monotone", spark, f"{mixed}/{files}")) == once["stream_phase_monotone"]


def test_streams_equal_batch(spark):
    """Four slices; rows of a task come in several parts, so that those of one micro-batch wait in the state store."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        replay = progress.Replay(view(spark, FOLDER, "events"), 250)
        assert len(replay.waiting()) >= 3
        emitted = progress.run_to_table(progress.task_progress(_stream(replay)), "update", "t", replay)
        assert replay.waiting() == [] and emitted.select(progress.BATCH_COLUMN).distinct().count() >= 4
        assert _rows(progress.last_update(emitted, ["task_id"])) == _rows(tasks.task_latest_state(_events(spark)))
        replay = progress.Replay(view(spark, FOLDER, "events").repartition(5, "event_id"), 500)
        phases = progress.run_to_table(progress.phase_monotone(_stream(replay)), "append", "p", replay).drop(progress.BATCH_COLUMN)
        assert _rows(phases) == _rows(tasks.phase_monotone(_events(spark)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("job, mode", [(progress.phase_monotone, "append"), (progress.task_progress, "update"), (progress.task_ttl, "append")])
def test_restart_from_the_checkpoint(spark, tmp_path, job, mode):
    """Stopped after two slices, a job goes on with the state that it had."""
    whole = progress.Replay(view(spark, FOLDER, "events"), 200)
    want = progress.run_to_table(job(_stream(whole)), mode, "w", whole)
    half = progress.Replay(view(spark, FOLDER, "events"), 200)
    stream = job(_stream(half))
    path = f"{tmp_path}/job"
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/{progress.BATCH_COLUMN}=-1")
    before = progress.run_to_table(stream, mode, "h", half, path, slices=2).count()
    again = progress.Replay(view(spark, FOLDER, "events"), 200, half.path)
    assert len(again.waiting()) == len(progress.Replay(view(spark, FOLDER, "events"), 200).waiting()) - 2
    found = progress.run_to_table(job(_stream(again)), mode, "h", again, path)
    assert found.count() > before
    last = (lambda df: progress.last_update(df, ["task_id"])) if mode == "update" else lambda df: df.drop(progress.BATCH_COLUMN)
    assert _rows(last(found)) == _rows(last(want))


def test_silent_tasks_leave_the_state(spark):
    """A task without events for longer than its time to live starts anew when it returns; the others go on counting.

    No other task is silent for as long, and the time to live is longer than a slice.
    """
    replay = progress.Replay(view(spark, FOLDER, "events"), 100)
    silent = _stream(replay).where("NOT (task_id = 't2' AND event_id BETWEEN 250 AND 499)")
    last = progress.last_update(progress.run_to_table(progress.task_progress(silent, ttl_seconds=302_400), "update", "t", replay), ["task_id"])
    events = {r.task_id: r["count"] for r in view(spark, FOLDER, "task_events").where("NOT (task_id = 't2' AND event_id BETWEEN 250 AND 499)").groupBy("task_id").count().collect()}
    found = {r.task_id: r.updates for r in last.collect()}
    assert found.pop("t2") < events.pop("t2") and found == events


def test_events_without_a_time_and_no_events(spark):
    events = view(spark, FOLDER, "events").limit(40).withColumn("ts", F.when(F.col("event_id") % 4 > 0, F.col("ts")))
    replay = progress.Replay(events, 10)
    found = progress.last_update(progress.run_to_table(progress.task_progress(_stream(replay)), "update", "t", replay), ["task_id"])
    timed = VIEWS["task_events"].build(lambda n: events).where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    assert _rows(found) == _rows(tasks.task_latest_state(timed))
    nothing = progress.Replay(events.limit(0))
    assert progress.run_to_table(progress.phase_monotone(_stream(nothing)), "append", "n", nothing).count() == 0


def test_expiry_is_a_session_without_python_state(spark, capsys):
    """A stretch ends more than the time to live after its last event: an event at that very moment still belongs to it."""
    rows = [("a", 1, "click", "0:00:00"), ("a", 2, "purchase", "0:10:00"), ("a", 3, "purchase", "1:10:00"), ("a", 4, "error", "2:10:00.000002"),
            ("b", 5, "purchase", "0:05:00"), ("b", 6, "view", "0:05:00"), ("c", 7, "view", "9:00:00")]
    schema = "task_id string, event_id bigint, event_type string, at string"
    events = spark.createDataFrame(rows, schema).selectExpr(
        "event_id", "CAST(concat('2024-01-01 ', at) AS TIMESTAMP) AS ts", "ascii(task_id) AS user_id", "event_type", "1.0D AS value", "'{}' AS props")
    replay = progress.Replay(events, 3)
    job = progress.task_ttl(_stream(replay))
    job.explain()
    plan = capsys.readouterr().out
    assert "session_window" in plan and "TransformWithState" not in plan
    found = progress.run_to_table(job, "append", "x", replay).drop(progress.BATCH_COLUMN)
    start = 1704067200000000
    assert _rows(found) == [("completed", "t97", str(start + 4_200_000_000)), ("error", "t97", str(start + 7_800_000_002))]


def test_tasks_share_buckets_of_state(spark, monkeypatch):
    """Two keys of state for all tasks; events that wait for the end of a micro-batch go through the state store."""
    monkeypatch.setattr(progress, "BUCKETS", 2)
    replay = progress.Replay(view(spark, FOLDER, "events"), 250)
    emitted = progress.run_to_table(progress.task_progress(_stream(replay)), "update", "t", replay)
    assert _rows(progress.last_update(emitted, ["task_id"])) == _rows(tasks.task_latest_state(_events(spark)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        replay = progress.Replay(view(spark, FOLDER, "events").repartition(5, "event_id"), 500)
        phases = progress.run_to_table(progress.phase_monotone(_stream(replay), held_rows=4), "append", "p", replay).drop(progress.BATCH_COLUMN)
        assert _rows(phases) == _rows(tasks.phase_monotone(_events(spark)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_slices_move_and_state_comes_with_its_rows(spark, capsys):
    """A slice is not written twice; numbers beyond those of a double keep their order beside an event without one."""
    big = 1 << 53
    rows = [(big + 1, "purchase"), (big, "view"), (None, "click")]
    schema = "event_id bigint, event_type string"
    events = spark.createDataFrame(rows, schema).coalesce(1).selectExpr(
        "event_id", "TIMESTAMP '2024-01-01 00:00:01' AS ts", "7L AS user_id", "event_type", "1.0D AS value", """'{"k": 5}' AS props""")
    replay = progress.Replay(events, 10)
    files = [f.name for f in Path(replay.path, "slices").rglob("part-*.parquet")]
    job = progress.task_progress(_stream(replay))
    job.explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
    found = progress.last_update(progress.run_to_table(job, "update", "m", replay), ["task_id"])
    assert files and files == [f.name for f in Path(replay.path, "arrived").rglob("part-*.parquet") if f.parent.name != "slice=-1"]
    assert _rows(found) == _rows(tasks.task_latest_state(VIEWS["task_events"].build(lambda n: events)))


def test_table_function(spark):
    register_functions(spark)
    pages = spark.createDataFrame([("b", 0, "\\begin{x} {a} % {hidden\n\\end{x}\\(")], "book string, page_num int, tex string")
    pages.createOrReplaceTempView("tex_page_rows")
    lateral = spark.sql("SELECT t.* FROM tex_page_rows p, LATERAL tex_tokens(p.tex) t")
    assert _rows(lateral) == _rows(tex.tex_tokens(pages).select("token_no", "line", "token"))
