"""Inputs that once gave wrong answers."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import blocks, chunks, extraction, features, linefilters, margins, naming, pagetext, structure, tex, usage
from quire.sources import corpus, sinks

PAGE = "book string, page_num int"


@pytest.mark.parametrize("kind", ["dense", "sparse", "hashed"])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_keeps_every_row(spark, kind, exclusive):
    """NULL groups and keys, sparse and 64-bit hashed keys; blocks of four rows, so that both levels carry."""
    draw = random.Random(kind)
    keys = draw.sample({"dense": range(300), "sparse": range(0, 3_000_000_000, 7_777_777), "hashed": range(-(1 << 63), (1 << 63) - 1, 1 << 40)}[kind], 200)
    rows = [(draw.choice(["a", "a", "a", "b", None]), k, draw.randint(-5, 9)) for k in keys] + [("a", None, 3), (None, None, 2)]
    df = spark.createDataFrame(rows, "g string, k bigint, v int")
    found = {(r.g, r.k): (r.total, r.top) for r in blocks.with_running(df, ["g"], "k", {"total": (F.col("v"), F.sum), "top": (F.col("v"), F.max)}, width=4, exclusive=exclusive).collect()}
    assert len(found) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        for i, r in enumerate(own):
            seen = [x[2] for x in own[: i if exclusive else i + 1]]
            assert found[g, r[1]] == ((sum(seen), max(seen)) if seen else (None, None))


KEYS = {
    "outlier": "CASE WHEN id = 29999 THEN 1L << 60 ELSE id END",
    "hashed": "xxhash64(id)",
    "hashed beside dense": "CASE WHEN id % 2 = 0 THEN xxhash64(id) ELSE id END",
    "bursts": "floor(id / 10000) * 1000000000000000 + id % 10000",
    "without a key": "CASE WHEN id % 3 > 0 THEN id END",
}


@pytest.mark.parametrize("kind", list(KEYS))
@pytest.mark.parametrize("sampled", [False, True])
def test_blocks_hold_equal_counts_whatever_the_keys(spark, monkeypatch, kind, sampled):
    """One book has two thirds of the rows.  With a small limit on the blocks, cuts come from a sample, as on a large table."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("g"), F.expr(KEYS[kind]).alias("k"), "id")
    width, most = 500, 1000
    if sampled:
        monkeypatch.setattr(blocks, "MOST_BLOCKS", 16)
        width, most = 1, 2 * 30_000 // 16
    cut = blocks.with_blocks(rows, ["g"], "k", width)
    sizes = cut.groupBy("__block").agg(F.count(F.lit(1)).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] < most
    # Blocks grow with the key inside a group, so the numbers are right too.
    found = blocks.number_rows(rows, ["g"], "k", "n", width)
    if kind != "without a key":
        assert found.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("k"))).where("n <> want").count() == 0
    assert found.groupBy("g").agg(F.max("n").alias("most"), F.countDistinct("n").alias("all"), F.count(F.lit(1)).alias("rows")).where("most <> all OR all <> rows").count() == 0


def test_running_over_nothing(spark):
    none = spark.createDataFrame([], "g string, k bigint")
    assert blocks.number_rows(none, ["g"], "k", "n").collect() == []


def test_group_total_keeps_null_groups(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "g string")
    assert sorted((r.g or "", r.n) for r in blocks.with_group_total(df, ["g"], "n").collect()) == [("", 1), ("a", 2), ("a", 2)]


def test_corpus_keeps_null_keys(spark):
    docs = spark.createDataFrame([("s", 4, "en", "x"), (None, 5, "en", "y"), ("s", None, "en", "z")], "source string, doc_id bigint, lang string, text string")
    assert sorted(r.text for r in corpus.scan_corpus(docs).collect()) == ["x", "y", "z"]


def test_simultaneous_arrivals(spark):
    df = spark.range(100).select(F.col("id").alias("request_id"), F.lit("m").alias("model"), F.timestamp_micros(F.lit(1_000_000)).alias("ts"))
    rows = usage.rate_limit_windows(df, limit=30).orderBy("request_id").collect()
    assert [r.wait_seconds for r in rows] == [60.0 * (i // 30) for i in range(100)] and sum(r.admitted for r in rows) == 30


def test_references_after_wide_characters(spark):
    text = "𝑥𝑦𝑧 body 😀\nReferences\n[1] A. Author, 2001."
    (row,) = structure.split_references(spark.createDataFrame([("b", 0, text)], f"{PAGE}, text string")).collect()
    assert row.rule == "heading" and row.main == "𝑥𝑦𝑧 body 😀" and row.references.startswith("References\n[1]")


def test_table_grid_and_several_tables(spark):
    cells = [(7, 1, 1, 1, "a"), (7, 1, 1, 3, "c"), (7, 1, 2, 2, "e"), (8, 2, 1, 1, "z")]
    df = spark.createDataFrame(cells, "table_id bigint, table_no int, row_no int, col_no int, cell string")
    texts = {r.table_id: r.table_text for r in structure.table_context(df).collect()}
    assert texts[7] == "[TABLE 1] cols=3\nROW 1: a | <EMPTY> | c\nROW 2: <EMPTY> | e | <EMPTY>"
    assert texts[8] == "[TABLE 2] cols=1\nROW 1: z"
    pages = spark.createDataFrame([("b", 0, "body"), ("b", 1, "none")], f"{PAGE}, text string")
    tables = structure.table_context(df).withColumns({"book": F.lit("b"), "page_num": F.lit(0)}).drop("table_id")
    found = {r.page_num: r.text for r in pagetext.attach_table_context(pages, tables, ["book", "page_num"]).collect()}
    assert len(found) == 2 and found[1] == "none"
    assert found[0].endswith(f"{texts[7]}\n\n{texts[8]}") and found[0].startswith("body\n\n")


def test_backfill_takes_the_later_section(spark):
    first = spark.createDataFrame([("b", 0, "z old", 1), ("b", 0, "a new", 2)], f"{PAGE}, text string, section int")
    none = first.limit(0)
    assert [r.text for r in chunks.backfill_pages(first, none).collect()] == ["a new"]
    again = spark.createDataFrame([("b", 0, "redone", 1)], first.schema)
    assert [(r.text, r["pass"]) for r in chunks.backfill_pages(first, again).collect()] == [("redone", 2)]


def test_account_failure_stops_the_job(spark):
    def refused(text):
        raise RuntimeError("401 unauthorized" if text == "x" else "timeout")

    pages = spark.createDataFrame([("b", 0, "y")], f"{PAGE}, text string")
    assert [r.error for r in chunks.map_pages(pages, refused).collect()] == ["timeout"]
    with pytest.raises(Exception, match="401 unauthorized"):
        chunks.map_pages(spark.createDataFrame([("b", 0, "x")], pages.schema), refused).collect()


def test_history_as_one_array(spark, tmp_path):
    (tmp_path / "history.json").write_text('[{"seq": 2, "filename": "a.pdf", "stats": {"total_pages": 3, "cost": {"pricing_configured": true, "total_cost": 0.5}}},\n {"seq": 1, "stats": {"cost": null}}]')
    rows = sinks.scan_history_json(spark, str(tmp_path / "history.json"), multi_line=True).orderBy("seq").collect()
    assert [(r.seq, r.filename, r.total_pages, r.total_cost) for r in rows] == [(1, None, None, None), (2, "a.pdf", 3, 0.5)]


def test_page_geometry(spark):
    """Margins and densities follow the size of the page; a page of a few glyphs has no chapter."""
    line = lambda page, n, text, size, y, height: ("b", page, n, text, size, y, height)
    lines = [x for page, height in ((0, 842.0), (1, 792.0)) for x in (line(page, 0, "Chapter 2 Methods", 18.0, 780.0, height), line(page, 1, "body text of the page", 10.0, 300.0, height), line(page, 2, "more of it", 10.0, 320.0, height))]
    lines += [line(5, 0, "第1章", 18.0, 300.0, 842.0), line(5, 1, "ab", 10.0, 310.0, 842.0), line(5, 2, "c", 10.0, 320.0, 842.0)]
    df = spark.createDataFrame(lines, f"{PAGE}, line_no int, text string, size double, y0 double, page_height double")
    assert [r.page_num for r in structure.chapter_boundaries(df).collect()] == [0]
    pages = spark.createDataFrame([("b", 0, "x"), ("b", 1, "x")], f"{PAGE}, text string")
    regions = spark.createDataFrame([("b", 0, 1, 0.0, 0.0, 100.0, 100.0, 200.0, 200.0), ("b", 1, 2, 0.0, 0.0, 100.0, 100.0, 400.0, 100.0)],
                                    f"{PAGE}, region_id bigint, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert [r.image_density for r in features.page_features(pages, regions).orderBy("page_num").collect()] == [0.25, 0.25]


def test_sink_uses_output_names(spark, tmp_path):
    """Two sources of one name, one of them translated: each document has a folder of its own."""
    sources = spark.createDataFrame([(1, "paper.pdf", True), (2, "paper.docx", True), (3, "paper.pdf", False)], "upload_id bigint, filename string, translate boolean")
    names = naming.unique_output_names(sources).select(F.concat(F.lit("b"), F.col("upload_id").cast("string")).alias("book"), "output_name")
    blocks_ = spark.createDataFrame([(f"b{i}", p, f"text {i} {p}") for i in (1, 2, 3, 4) for p in (0, 1)], f"{PAGE}, block string")
    sinks.write_tex_corpus(blocks_, f"{tmp_path}/out", names=names)
    found = {r.book for r in sinks.read_tex_corpus(spark, f"{tmp_path}/out").collect()}
    assert found == {"paper_cn.tex", "paper_cn_2.tex", "paper.tex", "b4"}


def test_failed_pages_are_findings(spark):
    """A page without LaTeX failed; a page with errors alone still converted."""
    pages = spark.createDataFrame([("b", 0, None), ("b", 1, "fine"), ("b", 2, "\\[ x"), ("b", 3, "\\[ = \\]"), (None, 4, None)], f"{PAGE}, tex string")
    assert [(r.page_num, r.code, r.severity, r.line) for r in tex.page_diagnostics(pages).orderBy("page_num").collect()] == [
        (0, "conversion_failed", "error", 1), (2, "unbalanced_display_math", "error", 1), (3, "isolated_math_fragment", "warning", 1), (4, "conversion_failed", "error", 1)]
    assert [(r.status, r.valid, r.errors_count, r.warnings_count) for r in tex.page_status(pages).orderBy("page_num").collect()] == [
        ("error", False, 1, 0), ("success", True, 0, 0), ("success", False, 1, 0), ("warning", True, 0, 1), ("error", False, 1, 0)]
    assert {tuple(r) for r in tex.page_diagnostic_counts(pages).collect()} == {("b", 1, 1, 2), (None, 0, 0, 1)}


def test_extraction_equals_its_steps(spark):
    """The chain against the operators of its steps, one after the other, on pages with mixed edges, notes and tables; blocks of three pages."""
    draw = random.Random(5)
    words = ["Running Title", "Page 3 of 9", "12", "W.T x^2", "a (cid:4) b", "smallprint here", "正文 内容", "", "  \t", "■■■", "Chapter 2 Some Title"]
    rows = []
    for k in range(120):
        text = "".join(draw.choice(words) + draw.choice(["\n", "\r\n", "\r"]) for _ in range(draw.randint(0, 14)))
        rows.append((draw.choice(["a", "a", "a", "b", "c"]), k * k, text, ["smallprinthere"] if k % 3 == 0 else None, "ROW 1: x | y" if k % 5 == 0 else None))
    docs = spark.createDataFrame(rows, "source string, doc_id bigint, text string, notes array<string>, table_text string")
    whole = {r.doc_id: r for r in extraction.extract_pages(docs, 0.3, width=3).collect()}

    pages = corpus.scan_corpus(docs.withColumn("lang", F.lit("en"))).join(docs.select("doc_id", "notes", "table_text"), "doc_id")
    pages = blocks.with_group_total(pages, ["book"], "total_pages")
    pages = pagetext.normalize_page_text(pages)
    pages = pages.withColumn("text", structure.without_notes(F.col("text"), F.col("notes")))
    tables = docs.where("table_text IS NOT NULL").select("doc_id", F.col("table_text").alias("table_text"))
    pages = pagetext.attach_table_context(pages.drop("table_text"), tables, ["doc_id"])
    pages = pagetext.normalize_page_text(linefilters.cleanup_pagination(pages))
    pages = pagetext.math_rewrite(pages, "extract")
    steps = {r.doc_id: r for r in margins.strip_repeated_margins(pages, 0.3).collect()}
    assert len(whole) == len(rows)
    assert {k: (r.book, r.page_num, r.text) for k, r in whole.items()} == {k: (r.book, r.page_num, r.text) for k, r in steps.items()}
    assert any("Running Title" in r[2] for r in rows) and not all("Running Title" in r.text for r in whole.values() if r.book == "a")


def test_extraction_of_odd_rows(spark):
    """NULLs, a reading that replaces or joins a poor layer, a backup, columns that clash; a table without the optional columns."""
    kind = "source string, doc_id bigint, text string, notes array<string>, reading string, table_text string, has_images boolean, backup string, book string"
    good = "a machine read these words"
    rows = [
        ("s", 1, None, None, None, None, None, " spare\nPage 2 ", "x"), ("s", 2, "", None, good + " alone", None, False, "b", "x"),
        ("s", 3, "■■■■■■■■■■■■", None, good, None, False, None, "x"), ("s", 4, "■■■■■■■■■■■■", None, "■", None, False, None, "x"),
        ("s", 5, "plain text of a page", ["notthere", None], good, None, True, None, "x"), (None, 6, "no book", None, None, "ROW 1: a", False, None, "x"),
        ("s", None, "no number", None, None, None, False, None, "x"),
    ]
    found = {r.doc_id: (r.book, r.page_num, r.origin, r.text) for r in extraction.extract_pages(spark.createDataFrame(rows, kind)).collect()}
    assert found == {
        1: ("s", 1, "text-layer", "spare"), 2: ("s", 2, "ocr", good + " alone"), 3: ("s", 3, "ocr", good), 4: ("s", 4, "ocr", "■"),
        5: ("s", 5, "text-layer", "plain text of a page"), 6: (None, 0, "text-layer", "no book\n\n[STRUCTURED_TABLE_CONTEXT]\nROW 1: a"),
        None: ("s", 0, "text-layer", "no number"),
    }
    bare = spark.createDataFrame([("s", 1, "x\r\ny")], "source string, doc_id bigint, text string")
    assert [r.text for r in extraction.extract_pages(bare).collect()] == ["x\ny"]
    assert extraction.extract_pages(bare.where("false")).collect() == []


def test_log_events_in_a_row(spark):
    """A bare error takes the line before it, else one that follows at once; wrapped messages join; odd logs give nothing."""
    logs = [
        ("a", "! First\nl.5 x\n! Second\nfoo\nd.tex:9: Undefined con\ntrol\n\n! Third"), ("b", None), ("c", ""), ("d", "x\ny"),
        ("e", "\n".join(f"d.tex:{k}: message {k}" for k in range(30))), ("f", "d.tex:99999999999: too large\n! after"),
    ]
    found = [tuple(r) for r in structure.compile_log_errors(spark.createDataFrame(logs, "log_id string, log string")).orderBy("log_id", "error_no").collect()]
    assert [r for r in found if r[0] == "a"] == [("a", 1, 5, "First"), ("a", 2, 5, "Second"), ("a", 3, 9, "Undefined control"), ("a", 4, 9, "Third")]
    assert [r for r in found if r[0] == "e"] == [("e", k + 1, k, f"message {k}") for k in range(10)]
    assert [r for r in found if r[0] == "f"] == [("f", 1, None, "too large"), ("f", 2, None, "after")]
    assert {r[0] for r in found} == {"a", "e", "f"}


def test_grid_of_wide_and_repeated_columns(spark):
    cells = [(1, 1, 1, "a"), (1, 1, 4, "d"), (1, 2, 2, "b"), (1, 2, 2, "a"), (1, 3, 5, None)]
    text = structure.table_context(spark.createDataFrame(cells, "table_id int, row_no int, col_no int, cell string")).first().table_text
    e = "<EMPTY>"
    assert text.split("\n") == ["[TABLE 1] cols=5", f"ROW 1: a | {e} | {e} | d | {e}", f"ROW 2: {e} | a | {e} | {e} | {e}", f"ROW 3: {e} | {e} | {e} | {e} | {e}"]
