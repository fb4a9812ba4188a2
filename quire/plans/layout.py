"""Structure, chunks and assembly: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunks, features, pagetext, ranges, structure
from quire.plans import sql as S
from quire.plans.registry import register
from quire.plans.scores import FEATURES_SQL, IS_MATH, SQUEEZED, _CONVERTED, page_features
from quire.plans.textops import _ESCAPES, _PARSED, ALGORITHM
from quire.plans.views import with_views

# ---- headers -----------------------------------------------------------------------------------------------------

register(
    "running_headers", lambda v: structure.running_headers(v("furniture_pages")),
    with_views("furniture_lines", "furniture_pages") + f""", f AS (SELECT book, page_num, coalesce(arg_min({S.strip('line')}, line_no) FILTER ({S.strip('line')} <> ''), '') AS first_line
    FROM furniture_lines GROUP BY ALL)
  SELECT book, page_num, first_line, first_line <> '' AND count(*) OVER (PARTITION BY book, first_line) >= 2 AS is_running_header FROM f""",
)
# Repeats of the line before, within a text given as (keys, line_no, line).
def _marked(keys: str, source: str) -> str:
    return f""", m1 AS (SELECT *, lag(s) OVER (PARTITION BY {keys} ORDER BY line_no) AS p FROM (SELECT *, {S.strip('line')} AS s FROM {source})),
  m2 AS (SELECT *, s <> '' AND length(s) < 60 AND coalesce(s = p, false) AS r FROM m1),
  m3 AS (SELECT *, row_number() OVER (PARTITION BY {keys}, r, s ORDER BY line_no) AS k FROM m2),
  marked AS (SELECT {keys}, string_agg(CASE WHEN r THEN concat('[DUPLICATE_HEADER]', s, '[/DUPLICATE_HEADER]') ELSE line END, chr(10) ORDER BY line_no) AS text
    FROM m3 WHERE NOT r OR k = 1 GROUP BY {keys})"""


register(
    "mark_duplicate_headers", lambda v: v("furniture_pages").select("book", "page_num", structure.mark_duplicate_headers(F.col("text")).alias("text")),
    with_views("furniture_lines") + _marked("book, page_num", "furniture_lines") + " SELECT book, page_num, text FROM marked",
)

# ---- glyphs ------------------------------------------------------------------------------------------------------

def _sq(value: str) -> str:
    return f"lower(regexp_replace({value}, '{S.SPACE}+', '', 'g'))"


register(
    "remove_bottom_small_text", lambda v: structure.remove_bottom_small_text(v("page_text"), v("glyphs")).select("book", "page_num", "text"),
    with_views("glyphs", "lines") + f""", inked AS (SELECT * FROM glyphs WHERE {S.strip('ch')} <> ''),
  med AS (SELECT book, page_num, list_sort(list(size))[count(*) // 2 + 1] AS median, count(*) AS n FROM inked GROUP BY ALL),
  small AS (SELECT book, page_num, round_even(top / 2, 0) AS r, string_agg(ch, '' ORDER BY x0, g_idx) AS t FROM inked JOIN med USING (book, page_num)
    WHERE n >= 10 AND top >= page_height * 0.84 AND size <= median * 0.78 GROUP BY ALL),
  notes AS (SELECT book, page_num, {_sq('t')} AS t FROM small WHERE length({_sq('t')}) >= 3),
  gone AS (SELECT DISTINCT l.book, l.page_num, l.line_no FROM lines l JOIN notes n ON l.book = n.book AND l.page_num = n.page_num AND contains({_sq('l.line')}, n.t)),
  kept AS (SELECT l.book, l.page_num, string_agg(line, chr(10) ORDER BY l.line_no) AS t FROM lines l ANTI JOIN gone g ON l.book = g.book AND l.page_num = g.page_num AND l.line_no = g.line_no GROUP BY ALL)
  SELECT p.book, p.page_num, CASE WHEN (p.book, p.page_num) IN (SELECT (book, page_num) FROM notes) THEN {S.strip("coalesce(t, '')")} ELSE p.text END AS text
  FROM page_text p LEFT JOIN kept USING (book, page_num)""",
)
# In the given layout all rows are further apart than the tolerance, so every height is a line.
register(
    "glyphs_to_lines", lambda v: structure.glyphs_to_lines(v("glyphs")),
    with_views("glyphs") + f""", r AS (SELECT book, page_num, top, string_agg(ch, '' ORDER BY x0, g_idx) AS t, avg(size) AS size, min(x0) AS x0 FROM glyphs GROUP BY ALL)
  SELECT book, page_num, row_number() OVER (PARTITION BY book, page_num ORDER BY top) - 1 AS line_no, {S.strip('t')} AS text, round(size, 6) AS size, top AS y0, x0 FROM r""",
)

# ---- chapters ----------------------------------------------------------------------------------------------------


def _level(ratio: str) -> str:
    return f"""CASE WHEN {ratio} > 2 THEN 1 WHEN regexp_matches(text, '^(Chapter|CHAPTER|第\\s*[\\x{{4e00}}-\\x{{9fff}}0-9]+\\s*章)') THEN 1
    WHEN regexp_matches(text, '^(Section|SECTION|第\\s*[\\x{{4e00}}-\\x{{9fff}}0-9]+\\s*节)') THEN 2
    WHEN regexp_matches(text, '^[0-9]+(\\.[0-9]+)+') THEN least(3, 1 + length(regexp_replace(regexp_extract(text, '^[0-9]+(\\.[0-9]+)+'), '[^.]', '', 'g')))
    WHEN regexp_matches(text, '^[0-9]+\\.') THEN 2 WHEN {ratio} > 1.6 THEN 1 ELSE 2 END"""


register(
    "heading_levels", lambda v: v("layout_lines").select("book", "page_num", "line_no", "text", structure.heading_level(F.col("text"), F.col("size"), F.lit(10.0)).alias("level")),
    with_views("layout_lines") + f" SELECT book, page_num, line_no, text, {_level('size / 10')} AS level FROM layout_lines",
)
register(
    "chapter_boundaries", lambda v: structure.chapter_boundaries(v("layout_lines")),
    with_views("layout_lines").replace("WITH ", "WITH RECURSIVE ", 1) + f""", med AS (SELECT book, page_num, list_sort(list(size))[count(*) // 2 + 1] AS median FROM layout_lines GROUP BY ALL HAVING sum(length(text)) >= 10),
  cand AS (SELECT l.*, {S.strip('text')} AS s, median FROM layout_lines l JOIN med USING (book, page_num)),
  ok AS (SELECT book, page_num, text, size, {_level('size / median')} AS level, row_number() OVER (PARTITION BY book ORDER BY page_num, line_no) AS i FROM cand
    WHERE size > median * 1.25 AND size < median * 3 AND length(text) BETWEEN 2 AND 80 AND regexp_matches(text, '\\p{{L}}') AND y0 BETWEEN page_height * 0.05 AND page_height * (1 - 0.05)
      AND regexp_matches(text, '^(Chapter \\d|\\d+(\\.\\d+)* [A-Z]|\\d+\\. [A-Z]|References)')),
  fold AS (SELECT book, i, page_num, text, size, level, true AS fresh FROM ok WHERE i = 1 UNION ALL
    SELECT n.book, n.i, CASE WHEN d AND NOT n.size > f.size THEN f.page_num ELSE n.page_num END, CASE WHEN d AND NOT n.size > f.size THEN f.text ELSE n.text END,
      CASE WHEN d AND NOT n.size > f.size THEN f.size ELSE n.size END, CASE WHEN d AND NOT n.size > f.size THEN f.level ELSE n.level END, NOT d
    FROM fold f JOIN ok n ON n.book = f.book AND n.i = f.i + 1, LATERAL (SELECT f.text = n.text AND n.page_num - f.page_num <= 1 AS d)),
  ends AS (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY book ORDER BY i), true) AS final FROM fold)
  SELECT book, page_num, text AS title, level, round(size, 2) AS font_size, length(text) AS char_count FROM ends WHERE final""",
)

# ---- formulas ----------------------------------------------------------------------------------------------------


def _open(x: str) -> str:
    return " OR ".join(f"length(replace({x}, '{b}', '')) < length(replace({x}, '{a}', ''))" for a, b in ("{}", "()", "[]"))


def _ends(x: str) -> str:
    return f"regexp_matches({x}, '(?:[=+*/^_({{\\[]|\\\\(?:frac|sum|int|prod|left|begin\\{{[^}}]+\\}}))\\s*$')"


def _heads(x: str) -> str:
    return f"regexp_matches({x}, '^(?:[+*/=,)\\]}}]|\\\\frac|\\\\sum|\\\\int|\\\\prod|\\\\sqrt|\\\\right|\\\\end\\{{|[A-Za-z]\\s*(?:[_^=]|\\())')"


_STITCH = f""", c AS (SELECT book, page_num, line_no, {S.strip('line')} AS s FROM math_lines WHERE {S.strip('line')} <> '' AND NOT (starts_with({S.strip('line')}, '[') AND ends_with({S.strip('line')}, ']'))),
  e AS (SELECT book, page_num, count(*) AS n, arg_min(s, line_no) AS head, arg_max(s, line_no) AS tail, min(line_no) AS hl, max(line_no) AS tl FROM c GROUP BY ALL),
  j AS (SELECT a.*, b.head AS nh, b.head IS NOT NULL AND ({_ends('a.tail')} OR {_open('a.tail')}) AND {_heads('b.head')} AS joins
    FROM e a LEFT JOIN e b ON a.book = b.book AND a.page_num + 1 = b.page_num),
  s AS (SELECT *, n >= 2 OR NOT joins OR coalesce(lag(page_num) OVER (PARTITION BY book ORDER BY page_num) <> page_num - 1, true) AS settled FROM j),
  r AS (SELECT *, max(CASE WHEN settled THEN page_num END) OVER w AS sp, max(CASE WHEN settled THEN page_num * 2 + CAST(joins AS INT) END) OVER w % 2 = 1 AS sj
    FROM s WINDOW w AS (PARTITION BY book ORDER BY page_num)),
  k AS (SELECT *, sj <> ((page_num - sp) % 2 <> 0) AS link FROM r),
  touched AS (SELECT x.*, coalesce(y.link, false) AS gave FROM k x LEFT JOIN k y ON x.book = y.book AND y.page_num = x.page_num - 1),
  m AS (SELECT l.book, l.page_num, bool_or(link OR gave) AS stitched, {S.strip("string_agg(CASE WHEN link AND line_no = tl THEN concat(" + S.strip('line') + ", ' ', nh) ELSE line END, chr(10) ORDER BY line_no) FILTER (NOT (gave AND line_no = hl))")} AS t
    FROM math_lines l JOIN touched USING (book, page_num) GROUP BY ALL),
  stitched AS (SELECT p.book, p.page_num, CASE WHEN stitched THEN coalesce(t, '') ELSE text END AS text, coalesce(stitched, false) AS stitched FROM math_pages p LEFT JOIN m USING (book, page_num))"""
register("stitch_cross_page_formulas", lambda v: structure.stitch_cross_page_formulas(v("math_pages")),
         with_views("math_lines", "math_pages") + _STITCH + " SELECT book, page_num, text, stitched FROM stitched")

# Classification by a run of the line before: a recursion in words, a running maximum in SQL.
_CONT = ("(p <> '' AND s <> '' AND (regexp_matches(p, '(?:[=+*/^_({\\[]|\\\\(?:frac|sum|int|prod|left))\\s*$') OR " + _open('p')
         + ") AND regexp_matches(s, '^(?:[+*/=,)}\\]]|\\\\[A-Za-z]+|[A-Za-z0-9({\\[])'))")
_CLASSES = f""", b0 AS (SELECT book, page_num, line_no, line, {S.strip('line')} AS s, {SQUEEZED} AS c FROM math_lines WHERE NOT (starts_with({S.strip('line')}, '[') AND ends_with({S.strip('line')}, ']'))),
  b1 AS (SELECT *, s <> '' AND ({_CONVERTED}) AS heading, lag(s) OVER (PARTITION BY book, page_num ORDER BY line_no) AS p FROM b0),
  b2 AS (SELECT *, NOT heading AND ({IS_MATH}) AS math, NOT heading AND coalesce({_CONT}, false) AS cont, coalesce(lag(heading) OVER (PARTITION BY book, page_num ORDER BY line_no), true) AS ph FROM b1),
  b3 AS (SELECT *, sum(CASE WHEN heading OR NOT cont OR ph THEN 1 ELSE 0 END) OVER (PARTITION BY book, page_num ORDER BY line_no) AS seg FROM b2),
  b4 AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN heading THEN 'heading' WHEN max(CAST(math AS INT)) OVER (PARTITION BY book, page_num, seg ORDER BY line_no) = 1 THEN 'math' ELSE 'prose' END AS kind FROM b3),
  b5 AS (SELECT *, kind = 'heading' OR (kind = 'math' AND NOT cont) OR coalesce(lag(kind) OVER (PARTITION BY book, page_num ORDER BY line_no) <> kind, true) AS starts FROM b4),
  b6 AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY book, page_num ORDER BY line_no) AS blk FROM b5)"""
register("formula_blocks", lambda v: structure.formula_blocks(v("math_pages")),
         with_views("math_lines") + _CLASSES + """ SELECT book, page_num, min(line_no) AS first_line, count(*) AS lines, string_agg(s, ' ' ORDER BY line_no) AS formula
  FROM b6 WHERE kind = 'math' GROUP BY book, page_num, blk""")


def _chars(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {_ESCAPES}), '')"


# Long formulas break after top-level signs: depth per bracket never falls below zero, and the next break is the
# last one 30 to 110 characters on.  No line of the view holds an inline formula.
def _depth(a: str, b: str) -> str:
    change = f"CASE ch WHEN '{a}' THEN 1 WHEN '{b}' THEN -1 ELSE 0 END"
    return f"sum({change}) OVER w AS d{ord(a)}"


_LONG = f""", lf AS (SELECT * FROM g WHERE kind = 'math' AND length(t) > 140),
  ch0 AS (SELECT book, page_num, blk, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM lf),
  ch1 AS (SELECT *, lag(ch) OVER w AS pc, {_depth('{', '}')}, {_depth('(', ')')}, {_depth('[', ']')} FROM ch0 WINDOW w AS (PARTITION BY book, page_num, blk ORDER BY i)),
  ch2 AS (SELECT *, d123 - least(0, min(d123) OVER w) + d40 - least(0, min(d40) OVER w) + d91 - least(0, min(d91) OVER w) AS depth FROM ch1
    WINDOW w AS (PARTITION BY book, page_num, blk ORDER BY i)),
  pts AS (SELECT book, page_num, blk, list(i ORDER BY i) AS p FROM ch2 WHERE ch IN ('+', '-') AND depth = 0 AND i > 1 AND pc NOT IN ('^', '_') GROUP BY ALL),
  lp AS (SELECT book, page_num, blk, t, coalesce(p, []) AS p FROM lf LEFT JOIN pts USING (book, page_num, blk)),
  walk AS (SELECT book, page_num, blk, t, p, 0 AS a, 0 AS k FROM lp
    UNION ALL SELECT book, page_num, blk, t, p, list_max(list_filter(p, lambda x: x BETWEEN a + 30 AND a + 110)), k + 1 FROM walk
    WHERE length(t) - a > 140 AND len(list_filter(p, lambda x: x BETWEEN a + 30 AND a + 110)) > 0),
  cuts AS (SELECT *, lead(a) OVER (PARTITION BY book, page_num, blk ORDER BY k) AS b, count(*) OVER (PARTITION BY book, page_num, blk) AS n FROM walk),
  broken AS (SELECT book, page_num, blk, concat(chr(92), '[', chr(10), chr(92), 'begin{{aligned}}', chr(10), string_agg(concat(CASE WHEN k = 0 THEN '& ' ELSE concat('&', chr(92), 'quad ') END,
      {S.strip('substr(t, a + 1, coalesce(b - a, length(t)))')}, CASE WHEN k < n - 1 THEN concat(' ', chr(92), chr(92)) ELSE '' END), chr(10) ORDER BY k), chr(10), chr(92), 'end{{aligned}}', chr(10), chr(92), ']') AS t
    FROM cuts WHERE n > 1 GROUP BY ALL)"""
_LINE = f"""CASE WHEN regexp_matches(g.t, '^(\\\\begin\\{{|\\\\end\\{{|\\\\\\[|\\\\\\]|\\\\\\(|\\\\\\)|\\$)') THEN g.t
    WHEN regexp_full_match(g.t, '([√∑∫∏±∓≈≠≤≥=+\\-*/·.,:;()\\[\\]{{}}|]|{S.SPACE})+') THEN ''
    WHEN regexp_matches(g.t, '[$^_=]|\\\\[a-zA-Z]+') OR (regexp_matches(g.t, '[∑∫√≤≥≈∞α-ωΑ-Ω]') AND regexp_matches(g.t, '[A-Za-z0-9]'))
      THEN concat(chr(92), '[', chr(10), g.t, chr(10), chr(92), ']') ELSE g.t END"""
register(
    "page_blocks", lambda v: structure.page_blocks(v("math_pages")),
    with_views("math_lines", "math_pages").replace("WITH ", "WITH RECURSIVE ", 1) + _CLASSES
    + ", g AS (SELECT book, page_num, blk, kind, string_agg(s, ' ' ORDER BY line_no) AS t FROM b6 WHERE kind <> 'blank' GROUP BY ALL)" + _LONG + f""",
  h AS (SELECT g.book, g.page_num, g.blk, CASE kind WHEN 'heading' THEN concat(chr(92), 'section*{{', {_chars('g.t')}, '}}') WHEN 'prose' THEN {_chars('g.t')}
      ELSE coalesce(broken.t, {_LINE}) END AS t FROM g LEFT JOIN broken USING (book, page_num, blk)),
  y AS (SELECT book, page_num, string_agg(t, chr(10) || chr(10) ORDER BY blk) AS latex FROM h WHERE {S.strip('t')} <> '' GROUP BY ALL)
  SELECT book, page_num, coalesce(latex, '') AS latex FROM math_pages LEFT JOIN y USING (book, page_num)""",
)

# ---- references and tables ---------------------------------------------------------------------------------------

_REF_LINE = (f"(regexp_matches(s, '^(\\[\\d+\\]|\\(\\d+\\)|\\d+\\.)\\s+.') OR (regexp_matches(s, '(^|{S.NOT_WORD})(19|20)\\d{{2}}({S.NOT_WORD}|$)') "
             f"AND regexp_matches(s, '(?i),\\s*[A-Z][a-zA-Z\\-'']+|(^|{S.NOT_WORD})(et\\s+al\\.|vol\\.|pp\\.)')))")
register(
    "split_references", lambda v: structure.split_references(v("ref_pages")),
    with_views("ref_pages") + f""", l AS ({S.exploded('ref_pages', 'text', 'book, page_num')}),
  f AS (SELECT book, page_num, line_no, line, {S.strip('line')} AS s, sum(length(line) + 1) OVER (PARTITION BY book, page_num ORDER BY line_no) - length(line) - 1 AS off,
    count(*) OVER (PARTITION BY book, page_num) AS n FROM l),
  g AS (SELECT *, CASE WHEN s = '' THEN 'b' WHEN {_REF_LINE} THEN 'r' ELSE 'n' END AS k, regexp_matches(s, '^\\[\\d+\\]') AS br,
    regexp_matches(s, '(?i)^(\\d*\\.?\\s*)?(references|bibliography|works\\s+cited|参考文献|参考资料|文献)\\s*[:：]?$') AS hd FROM f),
  rn AS (SELECT *, sum(CASE WHEN k = 'n' THEN 1 ELSE 0 END) OVER (PARTITION BY book, page_num ORDER BY line_no) AS run,
    sum(CASE WHEN br THEN 0 ELSE 1 END) OVER (PARTITION BY book, page_num ORDER BY line_no) AS brun FROM g),
  t1 AS (SELECT book, page_num, run, min(line_no) FILTER (k <> 'n') AS a, arg_min(k, line_no) FILTER (k <> 'n') AS ka, any_value(n) AS n FROM rn GROUP BY ALL HAVING count(*) FILTER (k = 'r') >= 4),
  t2 AS (SELECT book, page_num, arg_max(CASE WHEN ka = 'b' THEN a + 1 ELSE a END, run) AS a, any_value(n) AS n FROM t1 GROUP BY ALL),
  tail AS (SELECT t2.book, t2.page_num, f.off FROM t2 JOIN f ON t2.book = f.book AND t2.page_num = f.page_num AND f.line_no = t2.a WHERE a / CAST(t2.n AS DOUBLE) >= 0.6),
  b1 AS (SELECT book, page_num, brun, min(off) AS off FROM rn WHERE br GROUP BY ALL HAVING count(*) >= 5),
  brk AS (SELECT book, page_num, min(off) AS off FROM b1 JOIN ref_pages USING (book, page_num) WHERE off / CAST(length(text) AS DOUBLE) > 0.5 GROUP BY ALL),
  hdg AS (SELECT book, page_num, min(off) AS off FROM g WHERE hd GROUP BY ALL),
  cut AS (SELECT p.book, p.page_num, text, CASE WHEN h.off IS NOT NULL THEN 'heading' WHEN t.off IS NOT NULL THEN 'tail' WHEN b.off IS NOT NULL THEN 'brackets' ELSE '' END AS rule,
    CAST(coalesce(h.off, t.off, b.off) AS BIGINT) AS off FROM ref_pages p LEFT JOIN hdg h USING (book, page_num) LEFT JOIN tail t USING (book, page_num) LEFT JOIN brk b USING (book, page_num))
  SELECT book, page_num, rule, CASE WHEN off IS NULL THEN text ELSE {S.rstrip('substr(text, 1, off)')} END AS main,
    CASE WHEN off IS NULL THEN '' ELSE ltrim(substr(text, off + 1), chr(10)) END AS references FROM cut""",
)
_TABLES = f""", cc AS (SELECT table_id, row_no, col_no, coalesce(nullif(regexp_replace({S.strip("replace(cell, chr(10), ' ')")}, '{S.SPACE}+', ' ', 'g'), ''), '<EMPTY>') AS t FROM cells),
  cm AS (SELECT table_id, row_no, col_no, min(t) AS t FROM cc GROUP BY ALL),
  wide AS (SELECT table_id, max(col_no) AS cols FROM cm GROUP BY table_id),
  grid AS (SELECT r.table_id, r.row_no, unnest(range(1, cols + 1)) AS col_no FROM (SELECT DISTINCT table_id, row_no FROM cm) r JOIN wide USING (table_id)),
  rr AS (SELECT table_id, row_no, list(coalesce(t, '<EMPTY>') ORDER BY col_no) AS row FROM grid LEFT JOIN cm USING (table_id, row_no, col_no) GROUP BY ALL),
  tt AS (SELECT table_id, max(len(row)) AS cols, list(row ORDER BY row_no) AS rows FROM rr GROUP BY table_id),
  tables AS (SELECT table_id, concat('[TABLE 1] cols=', cols, chr(10), array_to_string(list_transform(range(1, len(rows) + 1), lambda i:
    concat('ROW ', i, ': ', array_to_string(rows[i], ' | '))), chr(10))) AS table_text, rows, cols FROM tt)"""
register("table_context", lambda v: structure.table_context(v("cells")), with_views("cells") + _TABLES + " SELECT table_id, table_text FROM tables")
register(
    "table_rows_from_context", lambda v: structure.table_rows_from_context(structure.table_context(v("cells"))),
    with_views("cells") + _TABLES + """ SELECT table_id, concat(chr(92), 'begin{tabular}{|', repeat('l|', cols), '}', chr(10), chr(92), 'hline', chr(10),
    array_to_string(list_transform(rows, lambda r: concat(array_to_string(r, ' & '), ' ', chr(92), chr(92), chr(10), chr(92), 'hline')), chr(10)),
    chr(10), chr(92), 'end{tabular}') AS tabular FROM tables""",
)
register(
    "attach_table_context",
    lambda v: pagetext.attach_table_context(v("page_text").select("book", "page_num", "doc_id", "text"),
                                            structure.table_context(v("cells").withColumn("table_no", F.col("table_id") % 2 + 1))
                                            .withColumn("doc_id", F.floor(F.col("table_id") / 2)).drop("table_id"), ["doc_id"]).select("book", "page_num", "text"),
    with_views("page_text", "cells") + _TABLES + f""", per_page AS (SELECT table_id // 2 AS page_doc, string_agg(replace(table_text, '[TABLE 1] cols', concat('[TABLE ', 1 + table_id % 2, '] cols')), chr(10) || chr(10) ORDER BY table_id) AS table_text
    FROM tables GROUP BY ALL) SELECT book, page_num, CASE WHEN table_text IS NULL THEN {S.strip('text')}
    WHEN {S.strip('text')} = '' THEN concat('[STRUCTURED_TABLE_CONTEXT]', chr(10), table_text)
    ELSE concat({S.strip('text')}, chr(10), chr(10), '[STRUCTURED_TABLE_CONTEXT]', chr(10), table_text) END AS text FROM page_text LEFT JOIN per_page ON doc_id = page_doc""",
)

# ---- marked text -------------------------------------------------------------------------------------------------

register(
    "page_block_split", lambda v: structure.page_block_split(v("tex_docs"), ["book", "part"]),
    with_views("tex_docs", "tex_pages") + f""" SELECT book, CAST(floor(page_num / 8) AS INT) AS part, page_num + 1 AS page, {S.strip("substr(tex, instr(tex, chr(10)) + 1)")} AS block FROM tex_pages""",
)
_CHUNKS = ", chunks AS (SELECT book, page_num, doc_id, text, CAST(floor(page_num / 4) AS INT) AS chunk FROM page_text)"
_RESPONSES = _CHUNKS + f""", parsed AS (SELECT book, chunk, page_num, 1 AS x, {S.strip("concat('译 ', text)")} AS text FROM chunks WHERE doc_id % 9 <> 0)"""


def _first_pass(v):
    return structure.parse_batch_response(v("batch_responses"), chunks.fixed_chunks(v("page_text"), dense=True))


register("parse_batch_response", lambda v: _first_pass(v),
         with_views("page_text") + _RESPONSES + " SELECT book, chunk, page_num, row_number() OVER (PARTITION BY book, chunk ORDER BY page_num) - 1 AS section_no, text FROM parsed")
register("missing_pages", lambda v: chunks.missing_pages(v("page_text"), _first_pass(v)),
         with_views("page_text") + f" SELECT book, page_num FROM page_text WHERE doc_id % 9 = 0 AND {S.strip('text')} <> ''")


def _redone(v):
    missing = chunks.missing_pages(v("page_text"), _first_pass(v))
    return v("page_text").join(missing, ["book", "page_num"], "left_semi").select("book", "page_num", F.concat(F.lit("again "), "text").alias("text"))


register("backfill_pages", lambda v: chunks.backfill_pages(_first_pass(v), _redone(v)),
         with_views("page_text") + _RESPONSES + """ SELECT book, page_num, text, 1 AS pass FROM parsed
  UNION ALL SELECT book, page_num, concat('again ', text), 2 FROM page_text WHERE doc_id % 9 = 0""")
_ERRORS = """, l AS (""" + S.exploded("tex_logs", "log", "log_id") + f"""), s AS (SELECT *, {S.strip('line')} AS s FROM l),
  b AS (SELECT *, s = '' OR regexp_matches(s, '\\.tex:\\d+:|^! |^l\\.') AS bound FROM s),
  g AS (SELECT *, sum(CAST(bound AS INT)) OVER (PARTITION BY log_id ORDER BY line_no) AS seg FROM b),
  h AS (SELECT log_id, seg, arg_min(line, line_no) AS first, string_agg(s, '' ORDER BY line_no) AS whole FROM g WHERE seg > 0 GROUP BY ALL),
  e AS (SELECT log_id, seg, CASE WHEN regexp_matches(first, '\\.tex:\\d+:') THEN whole ELSE first END AS t FROM h),
  k AS (SELECT *, CASE WHEN regexp_matches(t, '\\.tex:\\d+:\\s*.+') THEN (CASE WHEN contains(t, 'Fatal error') THEN 'skip' ELSE 'file' END)
    WHEN regexp_matches(t, '^l\\.\\d+') THEN 'line' WHEN starts_with(t, '! ') THEN 'bang' ELSE 'skip' END AS kind FROM e),
  q AS (SELECT *, CASE kind WHEN 'file' THEN CAST(regexp_extract(t, '\\.tex:(\\d+):', 1) AS INT) WHEN 'line' THEN CAST(regexp_extract(t, '^l\\.(\\d+)', 1) AS INT) END AS num FROM k WHERE kind <> 'skip'),
  r AS (SELECT *, last_value(num IGNORE NULLS) OVER w AS known, lead(kind) OVER w AS nk, lead(num) OVER w AS nn FROM q WINDOW w AS (PARTITION BY log_id ORDER BY seg)),
  x AS (SELECT log_id, seg, CASE WHEN kind = 'file' THEN num ELSE coalesce(known, CASE WHEN nk = 'line' THEN nn END) END AS line,
    {S.strip("CASE WHEN kind = 'file' THEN regexp_extract(t, '" + chr(92) + ".tex:" + chr(92) + "d+:" + chr(92) + "s*(.+)', 1) ELSE substr(t, 3) END")} AS message FROM r WHERE kind <> 'line'),
  n AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seg) AS error_no FROM x)
  SELECT log_id, error_no, line, message FROM n WHERE error_no <= 10"""
register("compile_log_errors", lambda v: structure.compile_log_errors(v("tex_logs")), with_views("tex_logs") + _ERRORS)

# ---- chunks and assembly -----------------------------------------------------------------------------------------

register(
    "display_positions", lambda v: chunks.display_positions(ranges.select_pages(v("page_text"), v("page_requests"))),
    with_views("page_text", "page_requests") + _PARSED + """, chosen AS (SELECT book, page_num FROM page_text SEMI JOIN single USING (book, page_num)
  UNION ALL SELECT book, page_num FROM page_text WHERE book IN (SELECT book FROM page_requests WHERE expr = ''))
  SELECT book, page_num, row_number() OVER (PARTITION BY book ORDER BY page_num) - 1 AS display_idx FROM chosen""",
)
register("fixed_chunks", lambda v: chunks.fixed_chunks(v("page_text")), with_views("page_text") + _CHUNKS + " SELECT book, page_num, chunk FROM chunks")
register(
    "chapter_chunks", lambda v: chunks.chapter_chunks(v("page_text"), v("boundaries"), dense=True),
    with_views("page_text", "boundaries") + """, s AS (SELECT p.book, p.page_num, max(CASE WHEN b.page_num IS NOT NULL OR p.page_num = 0 THEN p.page_num END) OVER (PARTITION BY p.book ORDER BY p.page_num) AS f
    FROM page_text p LEFT JOIN boundaries b USING (book, page_num))
  SELECT book, page_num, dense_rank() OVER (PARTITION BY book ORDER BY f, (page_num - f) // 8) - 1 AS chunk FROM s""",
)
register(
    "char_budget_chunks", lambda v: chunks.char_budget_chunks(v("page_text")),
    # Chunk by chunk: the next one begins with the first page that no longer fits, or with the next page.
    with_views("page_text").replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT book, page_num, length(text) AS chars, sum(length(text)) OVER (PARTITION BY book ORDER BY page_num) AS e FROM page_text),
  s AS (SELECT book, min(page_num) AS p, 0 AS chunk FROM e GROUP BY book
    UNION ALL SELECT s.book, (SELECT min(n.page_num) FROM e n WHERE n.book = s.book AND n.page_num > s.p AND n.e - f.e + f.chars > 80000), s.chunk + 1 FROM s JOIN e f ON f.book = s.book AND f.page_num = s.p)
  SELECT book, page_num, CAST(chars AS BIGINT) AS chars, (SELECT CAST(max(chunk) AS BIGINT) FROM s WHERE s.book = e.book AND s.p <= e.page_num) AS chunk FROM e""",
)
register(
    "build_batch_prompts", lambda v: chunks.build_batch_prompts(v("furniture_pages"), dense=True),
    with_views("furniture_pages") + f""", pc AS (SELECT book, CAST(floor(page_num / 4) AS INT) AS chunk, count(*) AS pages,
    string_agg(concat('[PAGE ', page_num + 1, ']', chr(10), text), concat(chr(10), '---', chr(10)) ORDER BY page_num) AS prompt FROM furniture_pages WHERE {S.strip('text')} <> '' GROUP BY ALL),
  pl AS ({S.exploded('pc', 'prompt', 'book, chunk')})""" + _marked("book, chunk", "pl") + " SELECT book, chunk, pages, text AS prompt FROM marked JOIN pc USING (book, chunk)",
)
register(
    "route_pages",
    lambda v: features.route_pages(page_features(v), structure.stitch_cross_page_formulas(v("math_pages")).where("stitched"),
                                   v("algorithm_pages").where(pagetext.has_algorithm(F.col("text")))),
    FEATURES_SQL + _STITCH + f""", algo AS (SELECT book, page_num, concat(CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('Algorithm 1 Search', chr(10), 'Input: x', chr(10))
    WHEN 1 THEN concat('算法 2', chr(10), '输出 y', chr(10)) WHEN 2 THEN concat('Algorithm 3', chr(10)) ELSE '' END, text) AS text FROM page_text),
  routed AS (SELECT book, page_num, 'formula' AS reason FROM features WHERE formula_density >= 0.20 UNION ALL SELECT book, page_num, 'stitched' FROM stitched WHERE stitched
    UNION ALL SELECT book, page_num, 'algorithm' FROM algo WHERE {ALGORITHM})
  SELECT book, page_num, string_agg(reason, ',' ORDER BY reason) AS reasons FROM routed GROUP BY ALL""",
)
_MARKER = "concat('% ===== 第 ', page_num + 1, ' 页 =====')"
register(
    "upsert_page_block", lambda v: chunks.upsert_page_block(v("document_blocks"), v("replacement_blocks")),
    with_views("document_blocks", "replacement_blocks") + f""", j AS (SELECT book, page_num, o.block AS old, n.block AS new, {_MARKER} AS m, {S.strip('n.block')} AS c
    FROM document_blocks o FULL JOIN replacement_blocks n USING (book, page_num))
  SELECT book, page_num, CASE WHEN old IS NULL THEN 'missing' WHEN new IS NULL THEN 'kept' ELSE 'replaced' END AS status,
    CASE WHEN old IS NULL THEN NULL WHEN new IS NULL THEN old ELSE concat(m, chr(10), {S.rstrip("CASE WHEN starts_with(c, m) THEN ltrim(substr(c, length(m) + 1), chr(13) || chr(10)) ELSE c END")}, chr(10), chr(10)) END AS block FROM j""",
)
register(
    "merge_documents",
    lambda v: chunks.merge_documents(v("tex_pages").withColumn("request", F.floor(F.col("page_num") / chunks.MERGE_FILES)), ["book", "request"], "page_num"),
    with_views("tex_pages") + f""", r AS (SELECT book, page_num // 5 AS request, page_num, tex, row_number() OVER (PARTITION BY book, page_num // 5 ORDER BY page_num) AS i FROM tex_pages)
  SELECT book, request, count(*) AS files, {S.strip("string_agg(concat('% ===== 合并文档 ', i, ' =====', chr(10), tex, chr(10), chr(92), 'clearpage', chr(10)), chr(10) ORDER BY page_num)")} AS tex FROM r GROUP BY ALL""",
)
_ASSEMBLED = f""", blocks AS (SELECT p.book, p.page_num, CASE WHEN latex IS NULL THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN latex IS NULL THEN concat('% 第 ', p.page_num + 1, ' 页转换失败', chr(10)) ELSE concat('% ===== 第 ', p.page_num + 1, ' 页 =====', chr(10), latex, chr(10)) END AS block
    FROM page_text p LEFT JOIN page_results r USING (book, page_num))"""
register("assemble_document", lambda v: chunks.assemble_document(v("page_text"), v("page_results")),
         with_views("page_text", "page_results") + _ASSEMBLED + " SELECT * FROM blocks")
register(
    "map_pages", lambda v: chunks.map_pages(v("second_reading")),
    with_views("second_reading") + f""", w AS (SELECT book, page_num, text, {S.strip('text')} <> '' AS ok, len(list_filter(regexp_split_to_array(text, '{S.SPACE}+'), lambda x: x <> '')) AS words FROM second_reading)
  SELECT book, page_num, CASE WHEN ok THEN concat('% ', words, ' words', chr(10), text) ELSE '' END AS text, CASE WHEN ok THEN length(text) // 4 ELSE 0 END AS prompt_tokens,
    CASE WHEN ok THEN words ELSE 0 END AS completion_tokens, ok, CASE WHEN ok THEN '' ELSE 'empty page' END AS error FROM w""",
)
