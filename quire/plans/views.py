"""Working views over the raw tables, with one definition for Spark and for the SQL oracle.

A view is a select list over another view.  The select lists are plain SQL that both engines read alike (a
backslash is ``chr(92)``, a line feed ``chr(10)``); a few views need one form per engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.blocks import with_group_total
from quire.sources.corpus import scan_corpus, scan_lines, table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@dataclass(frozen=True)
class View:
    needs: tuple[str, ...]
    sql: str
    build: Callable[[Callable[[str], DataFrame]], DataFrame]
    columns: tuple[str, ...] = field(default=())


VIEWS: dict[str, View] = {}


def select(name: str, source: str, *columns: str, where: str | None = None, distinct: bool = False) -> None:
    sql = f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(columns)} FROM {source}" + (f" WHERE {where}" if where else "")

    def build(view: Callable[[str], DataFrame]) -> DataFrame:
        df = view(source)
        df = df.where(where) if where else df
        df = df.selectExpr(*columns)
        return df.distinct() if distinct else df

    VIEWS[name] = View((source,), sql, build)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Build a view (or read a raw table) as a DataFrame."""
    if name in TABLES:
        return table(spark, folder, name)
    return VIEWS[name].build(lambda n: view(spark, folder, n))


def with_views(*names: str) -> str:
    """The ``WITH`` clause that defines ``names`` and all they need, in order; further CTEs may follow it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for need in VIEWS[name].needs:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].sql})" for n in ordered)


VIEWS["page_text"] = View(
    ("documents",),
    "SELECT source AS book, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page_num, "
    "doc_id, lang, text FROM documents",
    lambda v: scan_corpus(v("documents")),
)

VIEWS["sized_pages"] = View(
    ("page_text",),
    "SELECT *, count(*) OVER (PARTITION BY book) AS total_pages FROM page_text",
    lambda v: with_group_total(v("page_text"), ["book"], "total_pages"),
)

VIEWS["lines"] = View(
    ("page_text",),
    "SELECT book, page_num, CAST(u.i - 1 AS INT) AS line_no, u.line FROM page_text, LATERAL (SELECT "
    "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u",
    lambda v: scan_lines(v("page_text")),
)

TEX = """concat_ws(chr(10),
  concat('% ===== 第 ', CAST(page_num + 1 AS STRING), ' 页 ====='),
  CASE WHEN doc_id % 5 <> 0 THEN concat(chr(92), 'section{Page ', CAST(page_num + 1 AS STRING), '}') END,
  text,
  CASE CAST(doc_id % 7 AS INT)
    WHEN 0 THEN concat(chr(92), 'begin{equation}', chr(10), 'x_{1} = y + 1', chr(10), chr(92), 'end{equation}')
    WHEN 1 THEN concat(chr(92), 'begin{equation} a = b')
    WHEN 2 THEN concat('the value $x = ', CAST(page_num AS STRING), '$ inline')
    WHEN 3 THEN '$ broken'
    WHEN 4 THEN concat(chr(92), '[', chr(92), '[ z = 1 ', chr(92), ']')
    WHEN 5 THEN concat(chr(92), '[ q = 2 ', chr(92), ']')
    ELSE 'open {brace % }' END,
  concat(chr(92), 'label{eq:', CAST(page_num AS STRING), '}'),
  CASE WHEN doc_id % 3 = 0 THEN concat('see ', chr(92), 'ref{eq:', CAST(page_num + 1 AS STRING), '}')
       WHEN doc_id % 3 = 1 THEN concat('see ', chr(92), 'ref{eq:', CAST(page_num AS STRING), '}') END,
  CASE WHEN doc_id % 4 = 0 THEN concat(chr(92), 'begin{tabular}{|c|c|c|}', chr(10), 'A & B ', chr(92), chr(92), chr(10), '1 & 2 & 3 & 4 ', chr(92), chr(92), chr(10), chr(92), 'hline', chr(10), 'u & v & w ', chr(92), chr(92), chr(10), chr(92), 'end{tabular}') END,
  CASE WHEN doc_id % 6 = 0 THEN concat(chr(92), 'begin{figure}', chr(10), 'no picture', chr(10), chr(92), 'end{figure}') END,
  CASE WHEN doc_id % 8 = 0 THEN CAST(page_num + 10 AS STRING) END,
  CASE WHEN doc_id % 9 = 0 THEN concat(chr(92), 'hrule') END)"""

select("tex_pages", "page_text", "book", "page_num", "doc_id", f"{TEX} AS tex")

select("math_pages", "page_text", "book", "page_num", """concat_ws(chr(10),
  CASE WHEN page_num % 4 = 1 THEN 'y^2 = z^2' END,
  text,
  CASE WHEN page_num % 3 = 0 THEN concat('Q(u) = u^2 +', chr(10), 'y^2 + z^2') END,
  split_part(text, chr(10), 2),
  CASE WHEN page_num % 4 = 0 THEN 'H(t) = t^3 +' END) AS text""")

select("ref_pages", "page_text", "book", "page_num", """concat(text, chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('𝑥𝑦𝑧 and 😀', chr(10)) ELSE '' END,
  CASE CAST(doc_id % 4 AS INT)
    WHEN 0 THEN concat('References', chr(10), '[1] A. Author, 2001.', chr(10), '[2] B. Writer, 2002.')
    WHEN 1 THEN concat('[1] a', chr(10), '[2] b', chr(10), '[3] c', chr(10), '[4] d', chr(10), '[5] e', chr(10), '[6] f')
    WHEN 2 THEN concat('1. Smith, J. 1999', chr(10), '2. Lee, K. 2004', chr(10), chr(10), '3. Roy, P. 2010', chr(10), '4. Kim, D. 2015')
    ELSE 'no references here' END) AS text""")

select("page_requests", "documents", "source AS book", """CASE CAST(length(source) + ascii(right(source, 1)) AS INT) % 6
    WHEN 0 THEN '1-3,5,7-9' WHEN 1 THEN '' WHEN 2 THEN '5-3' WHEN 3 THEN '2,2,1-2' WHEN 4 THEN '0' ELSE '1,a' END AS expr""",
       distinct=True)

select("regions", "page_text", "book", "page_num", "doc_id AS region_id", "CAST(0 AS DOUBLE) AS x0", "CAST(0 AS DOUBLE) AS y0",
       "CAST(100 + doc_id % 400 AS DOUBLE) AS x1", "CAST(50 + doc_id % 300 AS DOUBLE) AS y1",
       # Letter and A4 pages.
       "CAST(CASE WHEN doc_id % 2 = 0 THEN 612 ELSE 595 END AS DOUBLE) AS page_width", "CAST(CASE WHEN doc_id % 2 = 0 THEN 792 ELSE 842 END AS DOUBLE) AS page_height",
       where="doc_id % 3 = 0")

select("task_events", "events", "event_id", "ts", "concat('t', CAST(user_id AS STRING)) AS task_id",
       "CASE event_type WHEN 'signup' THEN 'extracting' WHEN 'view' THEN 'translating' WHEN 'click' THEN 'converting' "
       "WHEN 'purchase' THEN 'completed' ELSE 'error' END AS status",
       "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS current_n",
       "CASE WHEN event_id % 50 = 0 THEN 0 ELSE 100 END AS total_n")

select("llm_usage", "events", "event_id AS request_id", "ts", "concat('t', CAST(user_id AS STRING)) AS task_id",
       "concat('m', CAST(user_id % 4 AS STRING)) AS model", "event_type <> 'error' AS ok",
       "CAST(floor(value * 1000) AS BIGINT) - 500 AS prompt_tokens",
       "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 10 AS completion_tokens", "1 + event_id % 12 AS pages",
       "value AS seconds")

# Requests that arrive many at a time: all of one model and day at three instants.
select("bursty_usage", "llm_usage", "request_id", "model",
       "CAST(date_trunc('day', ts) AS TIMESTAMP) + (CAST(request_id % 3 AS INT) * INTERVAL '20' SECOND) AS ts")

PRICING = ("SELECT * FROM (VALUES ('m0', CAST(1.0 AS DOUBLE), CAST(2.0 AS DOUBLE), 'CNY'), "
           "('m1', CAST(2.0 AS DOUBLE), CAST(4.0 AS DOUBLE), 'CNY'), "
           "('m2', CAST(-1.0 AS DOUBLE), CAST(2.0 AS DOUBLE), 'CNY')) "
           "AS t(model, input_per_million, output_per_million, currency)")
VIEWS["pricing"] = View((), PRICING, lambda v: v("events").sparkSession.sql(PRICING))

select("history", "orders", "o_orderkey AS seq", "concat('c', CAST(o_custkey AS STRING), '.pdf') AS filename",
       "o_orderpriority AS model",
       "CASE WHEN o_orderkey % 2 = 0 THEN 'article' WHEN o_orderkey % 5 = 0 THEN 'beamer' END AS template",
       "o_orderstatus = 'F' AS translated",
       "CASE WHEN o_orderkey % 3 = 0 THEN 'all' ELSE concat('1-', CAST(2 + o_orderkey % 9 AS STRING)) END AS pages",
       "CASE WHEN o_orderkey % 10 = 0 THEN 'high' WHEN o_orderkey % 10 < 6 THEN 'standard' END AS quality_mode",
       "concat('/out/c', CAST(o_custkey AS STRING), '.tex') AS output_file", "1 + o_orderkey % 40 AS total_pages",
       "1 + o_orderkey % 20 AS processed_pages", "CAST(floor(o_totalprice / 10) AS BIGINT) AS total_tokens",
       "o_totalprice / 1000 AS processing_time", "o_orderdate AS ts")

select("uploads", "customer", "c_custkey AS upload_id", "CAST(floor(c_custkey / 7) AS BIGINT) AS batch_id",
       "concat(CASE WHEN c_custkey % 4 = 0 THEN 'A:b*c ' ELSE '' END, 'Paper ', CAST(c_custkey % 11 AS STRING), "
       "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '' ELSE '.pdf' END) AS filename",
       "CAST(floor(abs(c_acctbal) * 10000) AS BIGINT) AS size_bytes")

VIEWS["cache"] = View(
    ("documents", "events"),
    "SELECT concat(md5(d.text), CASE WHEN d.doc_id % 4 = 0 THEN '_tr' ELSE '' END) AS cache_key, e.ts AS stored_at, CAST(length(d.text) AS BIGINT) AS size_bytes, d.doc_id AS seq "
    "FROM documents d JOIN events e ON d.doc_id = e.event_id WHERE d.doc_id % 2 = 0",
    lambda v: v("documents").where("doc_id % 2 = 0")
    .select(F.expr("concat(md5(CAST(text AS BINARY)), CASE WHEN doc_id % 4 = 0 THEN '_tr' ELSE '' END)").alias("cache_key"), F.length("text").cast("long").alias("size_bytes"), F.col("doc_id").alias("seq"))
    .join(v("events").select(F.col("event_id").alias("seq"), F.col("ts").alias("stored_at")), "seq"),
)

select("error_msgs", "events", "event_id", """CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'Request timeout' WHEN 1 THEN 'connect failed'
    WHEN 2 THEN 'HTTP 429 too many requests' WHEN 3 THEN '401 unauthorized' WHEN 4 THEN '404 not found'
    WHEN 5 THEN '503 server error' WHEN 6 THEN 'author missing' WHEN 7 THEN 'connect timeout' ELSE 'weird' END AS message""",
       "1 + event_id % 30 AS page", "event_id % 4 <> 0 AS recoverable")

CELL = ("CASE WHEN l_returnflag = 'N' AND col_no = 2 THEN NULL ELSE concat(l_returnflag, chr(10), ' ', l_linestatus) END AS cell")
VIEWS["cells"] = View(
    ("lineitem",),
    f"SELECT l_orderkey AS table_id, l_linenumber AS row_no, col_no, {CELL} FROM (SELECT l_orderkey, l_linenumber, "
    "l_returnflag, l_linestatus, unnest(range(1, 2 + l_linenumber % 3)) AS col_no FROM lineitem) WHERE NOT (l_returnflag = 'R' AND col_no = 2)",
    lambda v: v("lineitem")
    .selectExpr("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "explode(sequence(1, 1 + l_linenumber % 3)) AS col_no")
    .where("NOT (l_returnflag = 'R' AND col_no = 2)")
    .selectExpr("l_orderkey AS table_id", "l_linenumber AS row_no", "col_no", CELL),
)

select("tex_logs", "documents", "doc_id AS log_id", """concat_ws(chr(10), 'This is TeX', text,
    CASE WHEN doc_id % 2 = 0 THEN concat('C:/tmp/document.tex:', CAST(1 + doc_id % 90 AS STRING), ': Undefined control', chr(10), ' sequence.') END,
    CASE WHEN doc_id % 3 = 0 THEN concat('! Extra }, or forgotten $.', chr(10), 'l.8 x') END,
    CASE WHEN doc_id % 5 = 0 THEN 'a.tex:9: Fatal error occurred' END) AS log""")

select("furniture_pages", "sized_pages", "book", "page_num", "total_pages", """concat_ws(chr(10),
    CASE CAST(page_num % 6 AS INT) WHEN 0 THEN concat('Page ', CAST(page_num + 1 AS STRING), ' of 50')
      WHEN 1 THEN concat(CAST(page_num + 1 AS STRING), ' / ', CAST(total_pages AS STRING))
      WHEN 2 THEN concat('第 ', CAST(page_num + 1 AS STRING), ' 页') WHEN 3 THEN 'Chapter 1 Introduction'
      WHEN 4 THEN '8    2. 线性方程组求解' END,
    CASE WHEN page_num % 7 < 2 THEN concat('Running Title', chr(10), 'Running Title') END,
    text, CAST(page_num + 1 + page_num % 2 AS STRING)) AS text""")

select("boundaries", "page_text", "book", "page_num", "concat('Chapter ', CAST(page_num AS STRING)) AS title",
       where="page_num % 11 = 3")

select("cache_requests", "documents", "doc_id", "text", "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN '3,1,2' WHEN 1 THEN '5' END AS pages",
       "doc_id % 2 = 0 AS translate")

select("candidates", "documents", "doc_id", "CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('v1 ', text) END AS v1",
       "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('v2 ', text) END AS v2",
       "concat('orig ', text) AS original",
       """CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '{"winner": 1, "score1": 8.5}' WHEN 1 THEN concat('```json', chr(10), '{"winner": 2}', chr(10), '```')
    WHEN 2 THEN 'winner is 2, no json' WHEN 3 THEN 'noise "winner" : 2 tail' END AS judge""")

BODY = """concat('{"choices":[{"finish_reason":"', CASE WHEN turn % 3 = 0 THEN 'length' ELSE 'stop' END, '","message":{"content":"',
    replace(replace(replace(text, chr(92), ''), '"', ''), chr(10), ' '), '"}}],"usage":{"prompt_tokens":', CAST(length(text) AS STRING), '}}')"""
select("chat_responses", "conversations", "conv_id", "turn", f"{BODY} AS body", where="role = 'assistant'")

# Answers of the other response format: an output list whose texts carry link annotations.
OUTPUT_BODY = """concat('{"output":[{"type":"reasoning"},{"type":"message","content":[{"type":"output_text","text":"',
    replace(replace(replace(text, chr(92), ''), '"', ''), chr(10), ' '), '","annotations":[{"type":"url_citation","url":"http://a/', CAST(conv_id AS STRING),
    '","title":"T', CAST(turn AS STRING), '","start_index":0,"end_index":', CAST(length(text) AS STRING),
    '},{"type":"file","url":"x"},{"type":"url_citation","url":"http://b/', CAST(turn AS STRING), '","title":"U","start_index":1,"end_index":2}]}]}]}')"""
select("output_responses", "conversations", "conv_id", "turn", f"{OUTPUT_BODY} AS body", where="role = 'assistant'")

select("term_events", "events", "event_id AS seq",
       "concat(CASE WHEN event_id % 2 = 0 THEN ' Term' ELSE 'term' END, CAST(event_id % 40 AS STRING), ' ') AS source",
       "CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('译', CAST(event_id % 7 AS STRING)) END AS target",
       "event_id % 23 = 0 AS deleted")

select("page_warnings", "events", "1 + event_id % 45 AS page", "props AS message", where="event_type = 'view'")
select("output_files", "customer", "concat('c', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '_cn' ELSE '' END, '.tex') AS name")
select("source_files", "orders", "concat('c', CAST(o_custkey AS STRING), '.pdf') AS name", distinct=True)
select("corrections", "documents", "doc_id", "concat('原文 ', text, ' 术语', CASE WHEN doc_id % 2 = 0 THEN '甲' ELSE '乙' END) AS original",
       "concat('译文 ', text, ' 术语甲 新词') AS corrected")

# Settings edits arrive as events: the key and value follow from the event.
select("preference_updates", "events", "event_id AS seq", """CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'quality_mode' WHEN 1 THEN 'quality_mode'
    WHEN 2 THEN 'default_translate' WHEN 3 THEN 'common_page_ranges' ELSE 'nope' END AS pref_key""",
       """CASE CAST(event_id % 5 AS INT) WHEN 0 THEN (CASE WHEN value > 10 THEN 'high' ELSE 'standard' END) WHEN 1 THEN 'ultra'
    WHEN 2 THEN (CASE WHEN value > 20 THEN 'true' ELSE 'false' END) WHEN 3 THEN '1-3' ELSE 'x' END AS pref_value""")

# The heading of each page as a PDF reader reports it, with size and position.
HEAD = ("CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Chapter 2 Methods' WHEN 1 THEN '2.1.3 Methods' WHEN 2 THEN '1. Introduction' "
        "WHEN 3 THEN 'References' ELSE 'x = 1 + 2' END")
select("glyph_lines", "page_text", "book", "page_num", "doc_id", f"{HEAD} AS head",
       "CAST(12 + doc_id % 12 AS DOUBLE) AS head_size", "CAST(10 AS DOUBLE) AS body_size",
       "CAST(60 + (doc_id % 20) * 38 AS DOUBLE) AS head_y")

# Pages as a reader delivers them: mixed line ends, padded lines and unmapped-glyph residue.
select("raw_pages", "page_text", "book", "page_num",
       "concat('  (cid:3) ', replace(text, ', ', concat(' cid:12 , ', chr(13), chr(10), '  ')), chr(13), 'tail (CID:7)  ', chr(10)) AS text",
       "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'table' WHEN 1 THEN 'code' ELSE 'text' END AS hint")

# Documents as an extraction meets them: a running title, page numbers, residue, small print, some unreadable layers and empty
# pages, beside what a machine read, the tables of the page and another text layer.
select("extraction_inputs", "documents", "source", "doc_id",
       """CASE WHEN doc_id % 23 = 0 THEN CAST(NULL AS STRING) WHEN doc_id % 17 = 0 THEN '   ' ELSE concat('Running Title', chr(13), chr(10),
    CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('Page ', CAST(doc_id % 90 AS STRING), ' of 90') WHEN 1 THEN 'Chapter 1 Introduction' WHEN 2 THEN '第 3 页' ELSE '  (cid:3) ' END, chr(10),
    CASE WHEN doc_id % 7 = 0 THEN translate(text, 'abcdefghijklmnopqrstu', '▓▓▓▓▓▓▓▓▓▓▓▓▓▓▓▓▓▓▓▓▓') WHEN doc_id % 19 = 0 THEN '■□' ELSE replace(text, ', ', concat(' cid:12 W.T x^2 ', chr(13), chr(10), '  A T (')) END,
    chr(10), 'Set in Small  Print ', CAST(doc_id % 3 AS STRING), chr(10), chr(92), 'tag{', CAST(doc_id % 9 AS STRING), '} w^2', chr(13), CAST(1 + doc_id % 40 AS STRING)) END AS text""",
       "CASE WHEN doc_id % 4 = 1 THEN array('smallprint1', 'nowhere') ELSE CAST(NULL AS ARRAY<STRING>) END AS notes",
       "CASE WHEN doc_id % 14 = 7 THEN '■▓' WHEN doc_id % 3 = 0 THEN concat('  ', text, ' (cid:1)', chr(13)) WHEN doc_id % 3 = 1 THEN '' ELSE CAST(NULL AS STRING) END AS reading",
       "CASE WHEN doc_id % 6 = 0 THEN concat('[TABLE 1] cols=2', chr(10), 'ROW 1: a | ', CAST(doc_id AS STRING)) END AS table_text",
       "doc_id % 2 = 0 AS has_images", "CASE WHEN doc_id % 46 = 0 THEN concat('Page 7', chr(10), ' spare ', text) END AS backup")
_extraction = VIEWS["extraction_inputs"]
VIEWS["extraction_inputs"] = View(_extraction.needs, _extraction.sql.replace("array('smallprint1', 'nowhere')", "['smallprint1', 'nowhere']").replace("ARRAY<STRING>", "VARCHAR[]"), _extraction.build)

select("algorithm_pages", "page_text", "book", "page_num",
       "concat(CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('Algorithm 1 Search', chr(10), 'Input: x', chr(10)) "
       "WHEN 1 THEN concat('算法 2', chr(10), '输出 y', chr(10)) WHEN 2 THEN concat('Algorithm 3', chr(10)) ELSE '' END, text) AS text")

select("wrapped_pages", "tex_pages", "book", "page_num",
       """concat(chr(92), 'documentclass[12pt]{article}', chr(10), chr(92), 'usepackage[a]{b}', chr(92), 'usepackage{c}', chr(10), chr(92),
       'begin{document}', chr(10), chr(92), 'title{T}', chr(10), chr(92), 'author{A}', chr(10), chr(92), 'date{D}', chr(10), chr(92), 'maketitle',
       chr(10), chr(10), chr(10), tex, chr(10), chr(92), 'end{document}', chr(10)) AS tex""")

# Prose with characters that TeX reserves, and short formulas inside it.
select("marked_pages", "page_text", "book", "page_num",
       "concat('100% of x_y & z {', chr(92), 'a} ~^ $#', chr(10), replace(text, ', ', concat(' ', chr(92), '(a_1 = ', CAST(page_num AS STRING), chr(92), ') ')), "
       "chr(92), '(open_ ', chr(10), chr(92), ')') AS text")

# A second reading of some pages, with noise in part of them.
select("second_reading", "page_text", "book", "page_num",
       "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN concat(text, ' ■■■■ □□□□ ') "
       "ELSE translate(text, 'aeiourn', '▓▓▓▓▓▓▓') END AS text")
# Some pages have no second reading at all.
select("partial_reading", "page_text", "book", "page_num",
       "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN concat(text, ' ■■■■ □□□□ ') "
       "ELSE translate(text, 'aeiourn', '▓▓▓▓▓▓▓') END AS text", where="doc_id % 11 <> 0")

select("requested_names", "uploads", "upload_id", "filename", "upload_id % 2 = 0 AS translate")

# Pages known to hold a table: an order with line items whose number is the document's.
VIEWS["page_tables"] = View(
    ("page_text", "lineitem"),
    "SELECT DISTINCT book, page_num FROM page_text JOIN lineitem ON doc_id = l_orderkey",
    lambda v: v("page_text").select("book", "page_num", F.col("doc_id").alias("l_orderkey")).join(
        v("lineitem").select("l_orderkey"), "l_orderkey", "left_semi").select("book", "page_num"),
)
VIEWS["furniture_lines"] = View(
    ("furniture_pages",),
    "SELECT book, page_num, CAST(u.i - 1 AS INT) AS line_no, u.line FROM furniture_pages, LATERAL (SELECT "
    "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u",
    lambda v: scan_lines(v("furniture_pages")),
)
VIEWS["tex_lines"] = View(
    ("tex_pages",),
    "SELECT book, page_num, CAST(u.i - 1 AS INT) AS line_no, u.line FROM tex_pages, LATERAL (SELECT "
    "unnest(string_split(tex, chr(10))) AS line, generate_subscripts(string_split(tex, chr(10)), 1) AS i) u",
    lambda v: scan_lines(v("tex_pages"), "tex"),
)
VIEWS["math_lines"] = View(
    ("math_pages",),
    "SELECT book, page_num, CAST(u.i - 1 AS INT) AS line_no, u.line FROM math_pages, LATERAL (SELECT "
    "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u",
    lambda v: scan_lines(v("math_pages")),
)

select("gappy_pages", "tex_pages", "book", "page_num",
       "replace(replace(tex, concat(chr(10), chr(92), 'label'), concat(chr(10), chr(10), chr(10), chr(10), chr(92), 'label')), "
       "concat(chr(10), 'see'), concat(chr(10), '}', chr(10), 'a &', chr(10), 'b &', chr(10), 'c', chr(10), chr(10), chr(10), chr(10), chr(10), 'see')) AS tex")

# Eight pages make one part of a document, so a part stays small whatever the length of the book.
PART = "CAST(floor(page_num / 8) AS INT)"
VIEWS["tex_docs"] = View(
    ("tex_pages",),
    f"SELECT book, {PART} AS part, string_agg(tex, chr(10) ORDER BY page_num) AS tex FROM tex_pages GROUP BY ALL",
    lambda v: v("tex_pages").groupBy("book", F.expr(PART).alias("part")).agg(
        F.expr("listagg(tex, '\\n') WITHIN GROUP (ORDER BY page_num)").alias("tex")),
)
select("template_requests", "tex_docs", "book", "part", "tex",
       "CASE CAST(part % 5 AS INT) WHEN 0 THEN 'article' WHEN 1 THEN 'report' WHEN 2 THEN 'book' WHEN 3 THEN 'beamer' ELSE 'cn-article' END AS template",
       "part % 2 = 0 AS chinese")

# One row per character, laid out in rows of 80; the last 40 characters of a page are small print at its foot.
_GLYPH = ("CAST(g_idx % 80 * 6 AS DOUBLE) AS x0, CAST(CASE WHEN n > 80 AND g_idx >= n - 40 THEN 120 + 14 * ceil(n / 80.0) "
          "ELSE 40 + floor(g_idx / 80) * 14 END AS DOUBLE) AS top, CAST(CASE WHEN n > 80 AND g_idx >= n - 40 THEN 7 ELSE 10 END AS DOUBLE) AS size, "
          "CAST(140 + 14 * ceil(n / 80.0) AS DOUBLE) AS page_height")
VIEWS["glyphs"] = View(
    ("page_text",),
    f"SELECT book, page_num, g_idx, ch, {_GLYPH} FROM (SELECT book, page_num, length(text) AS n, unnest(string_split(text, '')) AS ch, "
    "CAST(generate_subscripts(string_split(text, ''), 1) - 1 AS INT) AS g_idx FROM page_text)",
    lambda v: v("page_text").select("book", "page_num", F.length("text").alias("n"), F.posexplode_outer(F.split("text", "")).alias("g_idx", "ch"))
    .selectExpr("book", "page_num", "g_idx", "ch", *_GLYPH.split(", ")),
)
# A heading above all lines of the page, each with its own size and position.
HEIGHT = "CAST(CASE WHEN page_num % 2 = 0 THEN 792 ELSE 842 END AS DOUBLE) AS page_height"
HEAD_LINE = ["book", "page_num", "0 AS line_no", "head AS text", "head_size AS size", "head_y AS y0", HEIGHT]
BODY_LINE = ["book", "page_num", "line_no + 1 AS line_no", "line AS text", "CAST(10 AS DOUBLE) AS size", "CAST(100 + line_no AS DOUBLE) AS y0", HEIGHT]
VIEWS["layout_lines"] = View(
    ("glyph_lines", "lines"),
    f"SELECT {', '.join(HEAD_LINE)} FROM glyph_lines UNION ALL SELECT {', '.join(BODY_LINE)} FROM lines",
    lambda v: v("glyph_lines").selectExpr(*HEAD_LINE).unionByName(v("lines").selectExpr(*BODY_LINE)),
)
# Requested pages of every stretch of 16 pages of a book, as a list; some stretches ask for all.
VIEWS["page_lists"] = View(
    ("page_text",),
    "SELECT min(doc_id) AS doc_id, string_agg(CASE WHEN page_num // 16 % 5 <> 4 AND (page_num * 7 + doc_id) % 5 <> 0 THEN CAST(page_num + 1 AS VARCHAR) END, ',' ORDER BY page_num) AS pages "
    "FROM page_text GROUP BY book, page_num // 16",
    lambda v: v("page_text").groupBy("book", F.expr("page_num div 16").alias("part")).agg(
        F.min("doc_id").alias("doc_id"),
        F.expr("listagg(CASE WHEN (page_num div 16) % 5 <> 4 AND (page_num * 7 + doc_id) % 5 <> 0 THEN CAST(page_num + 1 AS STRING) END, ',') WITHIN GROUP (ORDER BY page_num)").alias("pages"))
    .select("doc_id", "pages"),
)
RESPONSE = "concat('[PAGE ', CAST(page_num + 1 AS STRING), ']', chr(10), '[DUPLICATE_HEADER]x[/DUPLICATE_HEADER]译 ', text)"
VIEWS["batch_responses"] = View(
    ("page_text",),
    f"SELECT book, CAST(floor(page_num / 4) AS INT) AS chunk, string_agg({RESPONSE}, chr(10) ORDER BY page_num) AS content "
    "FROM page_text WHERE doc_id % 9 <> 0 GROUP BY ALL",
    lambda v: v("page_text").where("doc_id % 9 <> 0").groupBy("book", F.expr("CAST(floor(page_num / 4) AS INT)").alias("chunk")).agg(
        F.expr(f"listagg({RESPONSE}, '\\n') WITHIN GROUP (ORDER BY page_num)").alias("content")),
)
# Page results of a conversion (some failed), and single pages done again (some for pages that do not exist).
select("page_results", "tex_pages", "book", "page_num", "tex AS latex", where="doc_id % 10 <> 3")
select("document_blocks", "tex_pages", "book", "page_num", "tex AS block", where="doc_id % 10 <> 3")
select("replacement_blocks", "tex_pages", "book", "CASE WHEN doc_id % 20 = 0 THEN page_num + 1000000 ELSE page_num END AS page_num",
       "concat(tex, chr(10), 'again  ', chr(10)) AS block", where="doc_id % 10 = 0")
