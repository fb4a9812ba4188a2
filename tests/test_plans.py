"""Shapes of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import extraction, margins, pagetext, scoring, structure, tex
from quire.plans.registry import QUERIES, run
from quire.plans.views import view

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", [scoring.page_scores, scoring.tex_statistics, tex.brace_balance, tex.findings_report, tex.repair_display_math])
def test_page_operators_do_not_shuffle(spark, operator):
    docs = view(spark, FOLDER, "documents")
    pages = docs.select(F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page_num"), F.col("text").alias("tex"))
    assert "Exchange" not in plan(operator(pages))


@pytest.mark.parametrize("operator", [structure.page_blocks, structure.formula_blocks])
def test_pages_are_cut_in_their_row(spark, operator):
    pages = view(spark, FOLDER, "documents").select(F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page_num"), "text")
    assert "Exchange" not in plan(operator(pages))


def test_log_errors_are_found_in_the_row(spark):
    logs = view(spark, FOLDER, "documents").selectExpr("doc_id AS log_id", "text AS log")
    assert "Exchange" not in plan(structure.compile_log_errors(logs))


@pytest.fixture
def shuffled(spark):
    """Plans as they are for large tables: nothing is broadcast, and equal exchanges are shared when the plan is made."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def text_exchanges(df):
    """The keys of the exchanges that move the text."""
    lines = plan(df).split("\n")
    return [line[line.index("Exchange"):] for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line and "Reused" not in line and re.search(r"\btext#", below)]


def test_extraction_moves_the_text_once(shuffled):
    pages = view(shuffled, FOLDER, "extraction_inputs")
    assert len(text_exchanges(extraction.extract_pages(pages))) == 1


def test_margins_never_deal_the_text_by_book(shuffled):
    pages = view(shuffled, FOLDER, "documents").select(F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page_num"), "text")
    moved = text_exchanges(margins.strip_repeated_margins(pages))
    assert moved and all("__block" in keys for keys in moved)


def test_scan_reads_only_needed_columns(spark):
    text = plan(run("file_fingerprint", spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "text:string" not in plan(run("fixed_chunks", spark, FOLDER))


def test_history_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(run("history_page", spark, FOLDER))


def test_windows_never_take_a_whole_book(spark):
    """Windows over page tables are partitioned by block as well; the carry runs over one row per block."""
    for name in ("scan_corpus", "usage_by_task", "phase_monotone"):
        for line in plan(run(name, spark, FOLDER)).split("\n"):
            if "Window [" in line and "__carry" not in line:
                assert "__block" in line, (name, line)


def test_margin_keys_are_bounded(spark):
    pages = spark.createDataFrame([("b", p, "\n".join(f"{w} title" for w in "abcdefgh")) for p in range(40)], "book string, page_num int, text string")
    keys = margins.repeated_margin_lines(pages).count()
    assert keys <= 2 * margins.VOTING_LINES / margins.MIN_RATIO


# Queries that need results of their own input while they are built: streams and sinks run, a few write what several steps read,
# and the list of page ranges is replayed in rounds.
EAGER = {"preference_flags", "write_tex_corpus", "scan_history_json", "chapter_boundaries", "chapter_chunks", "route_pages", "split_difficult", "stitch_cross_page_formulas"}


def test_building_runs_no_jobs(spark):
    """Reading a table's schema is the one job that building a query may run per table."""
    tracker, started = spark.sparkContext.statusTracker(), {}
    for name in QUERIES:
        if name in EAGER or name.startswith("stream_"):
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        run(name, spark, FOLDER)
        started[name] = len(tracker.getJobIdsForGroup(f"build-{name}"))
    spark.sparkContext.setJobGroup("after", "after")
    assert {n: k for n, k in started.items() if k > 8} == {}


def test_extraction_looks_for_needles_as_they_are(spark):
    """Rules that heed case need no lower-case copy of the text, and lines without a slash no cast of an empty match."""
    pages = view(spark, FOLDER, "extraction_inputs")
    text = plan(extraction.extract_pages(pages))
    assert "contains(lower(" not in text and "try_cast" not in re.sub(r"CASE WHEN .*? END", "", text)
    rows = spark.createDataFrame([("x.T y T z .t a.t A.t X^2 \\tag{1} \\TAG{2} v T",)], "text string")
    found = pagetext.math_rewrite(rows, "extract").first()
    assert [found[f"n_{rule}"] for rule in ("dot_transpose", "space_transpose", "lower_transpose", "power", "tag")] == [1, 2, 1, 1, 1]
