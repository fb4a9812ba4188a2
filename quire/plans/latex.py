"""LaTeX cleaning and checks: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import latex as L
from quire.operators import tex
from quire.plans import sql as S
from quire.plans.registry import register
from quire.plans.textops import _TRANSPOSE
from quire.plans.views import with_views

_TEX = with_views("tex_pages")


def _at(pattern: str, keep: str = "true") -> str:
    """(book, page_num, line, m) for each match of a pattern in tex: lines counted over the text before the match."""
    return (f"SELECT book, page_num, m, 1 + CAST(list_sum(list_transform(range(1, k + 1), lambda j: length(p[j]) - length(replace(p[j], chr(10), '')))) "
            "+ coalesce(list_sum(list_transform(range(1, k), lambda j: length(ms[j]) - length(replace(ms[j], chr(10), '')))), 0) AS INT) AS line, k "
            f"FROM (SELECT book, page_num, p, ms, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT book, page_num, regexp_split_to_array(tex, '{pattern}') AS p, "
            f"regexp_extract_all(tex, '{pattern}') AS ms FROM tex_in)) WHERE {keep}")


# The only complete environment of the pages, with two rows and without marks, and what becomes of it.
_ALIGN = "replace(replace(tex, '{equation}', '{align*}'), 'x_{1} = y + 1', concat('x_{1} = y + 1', chr(10), 'w = 2'))"
register(
    "align_to_aligned", lambda v: tex.align_to_aligned(v("tex_pages").select("book", "page_num", F.expr(_ALIGN).alias("tex"))),
    _TEX + f""" SELECT book, page_num, replace({_ALIGN}, concat(chr(92), 'begin{{align*}}', chr(10), 'x_{{1}} = y + 1', chr(10), 'w = 2', chr(10), chr(92), 'end{{align*}}'),
    concat(chr(92), '[', chr(10), chr(92), 'begin{{aligned}}', chr(10), 'x_{{1}} &= y + 1 ', chr(92), chr(92), chr(10), 'w &= 2', chr(10), chr(92), 'end{{aligned}}', chr(10), chr(92), ']')) AS tex FROM tex_pages""",
)
_RENDER = f"""CASE WHEN regexp_replace(body, '{S.SPACE}+', '', 'g') = '' THEN '' ELSE concat(chr(92), '[', chr(10), body, chr(10), chr(92), ']') END"""
register(
    "repair_display_math", lambda v: tex.repair_display_math(v("tex_pages")).select("book", "page_num", "tex"),
    _TEX + f""", p AS (SELECT book, page_num, regexp_split_to_array(tex, '(?s)\\\\\\[.*?\\\\\\]') AS o, regexp_extract_all(tex, '(?s)\\\\\\[(.*?)\\\\\\]', 1) AS b FROM tex_pages),
  r AS (SELECT book, page_num, list_transform(o, lambda x: regexp_replace(x, '\\\\[\\[\\]]', '', 'g')) AS o,
    list_transform(list_transform(b, lambda x: {S.strip("regexp_replace(x, '" + chr(92)*2 + "[" + chr(92) + "[" + chr(92) + "]]', '', 'g')")}), lambda body: {_RENDER}) AS b FROM p)
  SELECT book, page_num, array_to_string(list_transform(range(1, len(o) + 1), lambda i: concat(o[i], coalesce(b[i], ''))), '') AS tex FROM r""",
)
# The tables of the view are known: a short row, a surplus row, and a good one.
register(
    "repair_tabular_rows", lambda v: tex.repair_tabular_rows(v("tex_pages")).select("book", "page_num", "tex"),
    _TEX + """ SELECT book, page_num, replace(replace(tex, concat(chr(10), 'A & B ', chr(92), chr(92), chr(10)), concat(chr(10), 'A & B & -- ', chr(92), chr(92), chr(10))),
    concat(chr(10), '1 & 2 & 3 & 4 ', chr(92)), concat(chr(10), '1 & 2 & 3 ', chr(92), '& 4 ', chr(92))) AS tex FROM tex_pages""",
)
_TOKENS = _TEX + ", tex_in AS (SELECT book, page_num, tex FROM tex_pages)"
# The steps of the chain that find something to do in these pages, one CTE each.
_TRANSPOSED = ", ".join(
    f"x{k + 1} AS (SELECT book, page_num, regexp_replace(tex, '{pattern}', '{replacement}', 'g') AS tex FROM x{k})"
    for k, (_, pattern, replacement) in enumerate(_TRANSPOSE))
register(
    "sanitize_tex", lambda v: tex.sanitize_tex(v("gappy_pages")),
    with_views("gappy_pages") + f""", a AS (SELECT book, page_num, {S.strip('tex')} AS tex FROM gappy_pages),
  p AS (SELECT book, page_num, regexp_split_to_array(tex, '(?s)\\\\\\[.*?\\\\\\]') AS o, regexp_extract_all(tex, '(?s)\\\\\\[(.*?)\\\\\\]', 1) AS b FROM a),
  r AS (SELECT book, page_num, list_transform(o, lambda x: regexp_replace(x, '\\\\[\\[\\]]', '', 'g')) AS o,
    list_transform(list_transform(b, lambda x: {S.strip("regexp_replace(x, '" + chr(92)*2 + "[" + chr(92) + "[" + chr(92) + "]]', '', 'g')")}), lambda body: {_RENDER}) AS b FROM p),
  x0 AS (SELECT book, page_num, array_to_string(list_transform(range(1, len(o) + 1), lambda i: concat(o[i], coalesce(b[i], ''))), '') AS tex FROM r),
  {_TRANSPOSED},
  tb AS (SELECT book, page_num, replace(replace(tex, concat(chr(10), 'A & B ', chr(92), chr(92), chr(10)), concat(chr(10), 'A & B & -- ', chr(92), chr(92), chr(10))),
    concat(chr(10), '1 & 2 & 3 & 4 ', chr(92)), concat(chr(10), '1 & 2 & 3 ', chr(92), '& 4 ', chr(92))) AS tex FROM x{len(_TRANSPOSE)}),
  kept AS (SELECT book, page_num, array_to_string(list_filter(string_split(tex, chr(10)), lambda l: NOT regexp_full_match({S.strip('l')}, '[0-9]{{2,4}}') AND {S.strip('l')} <> '\\hrule'), chr(10)) AS tex FROM tb)
  SELECT book, page_num, {S.strip("regexp_replace(tex, '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS tex FROM kept""",
)
register("tex_tokens", lambda v: tex.tex_tokens(v("tex_pages")),
         _TOKENS + ", a AS (" + _at("%[^\\n]*|\\\\(?:begin|end)\\{[^}]*\\}|\\\\[()\\[\\]]|[{}]", "NOT starts_with(m, '%')")
         + ") SELECT book, page_num, row_number() OVER (PARTITION BY book, page_num ORDER BY k) - 1 AS token_no, line, m AS token FROM a")
_BRACES = """, c AS (SELECT book, page_num, string_split(regexp_replace(regexp_replace(tex, '%[^\\n]*', '', 'g'), '[^{}]+', '', 'g'), '') AS c FROM tex_in),
  b AS (SELECT book, page_num, unnest(c) AS ch, generate_subscripts(c, 1) AS i FROM c),
  d AS (SELECT book, page_num, sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY book, page_num ORDER BY i) AS s FROM b),
  mn AS (SELECT book, page_num, least(0, min(s)) AS low FROM d GROUP BY ALL),
  tot AS (SELECT book, page_num, sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) AS s FROM b GROUP BY ALL),
  braces AS (SELECT book, page_num, CAST(-coalesce(low, 0) AS INT) AS missing_open, CAST(coalesce(s, 0) - coalesce(low, 0) AS INT) AS unclosed
    FROM tex_in LEFT JOIN mn USING (book, page_num) LEFT JOIN tot USING (book, page_num))"""
register("brace_balance", lambda v: tex.brace_balance(v("tex_pages")), _TOKENS + _BRACES + " SELECT * FROM braces")
_KNOWN = ", ".join(f"'{n}'" for n in tex.KNOWN_ENVIRONMENTS)
# Depth never falls below zero; tokens of one depth then pair up in order.
_ENVS = ", a AS (" + _at("%[^\\n]*|\\\\(?:begin|end)\\{[^}]*\\}?", "NOT starts_with(m, '%')") + f"""),
  t AS (SELECT *, starts_with(m, '\\begin') AS opens, regexp_extract(m, '\\{{([^}}]*)', 1) AS name FROM a),
  u AS (SELECT *, rtrim(name, '*') IN ({_KNOWN}) AS known FROM t), w AS (SELECT * FROM u WHERE NOT opens OR known),
  s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER o AS s FROM w WINDOW o AS (PARTITION BY book, page_num ORDER BY k)),
  q AS (SELECT *, s - least(0, min(s) OVER o) AS depth FROM s WINDOW o AS (PARTITION BY book, page_num ORDER BY k)),
  v AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY book, page_num ORDER BY k), 0) AS before FROM q),
  z AS (SELECT *, CASE WHEN opens THEN depth ELSE before END AS level FROM v WHERE opens OR before > 0),
  y AS (SELECT *, lead(opens) OVER l AS next_opens, lag(name) OVER l AS open_name FROM z WINDOW l AS (PARTITION BY book, page_num, level ORDER BY k)),
  env AS (SELECT book, page_num, 'extra_end' AS problem, 'warning' AS severity, line, name FROM v WHERE NOT opens AND before = 0 AND known
    UNION ALL SELECT book, page_num, 'mismatch', 'error', line, name FROM y WHERE NOT opens AND open_name <> name
    UNION ALL SELECT book, page_num, 'unclosed', 'error', line, name FROM y WHERE opens AND next_opens IS NULL)"""
register("environment_pairing", lambda v: tex.environment_pairing(v("tex_pages")), _TOKENS + _ENVS + " SELECT * FROM env")
# One step per token: a closer takes the top of the stack away only when it fits.
_STACK = """, tk AS (SELECT book, page_num, list_filter(regexp_extract_all(tex, '%[^\\n]*|\\\\\\p{L}[^ \\n{}]*|\\\\[()\\[\\]]'),
    lambda t: length(t) = 2 AND t[2] IN ('(', ')', '[', ']')) AS t FROM tex_pages),
  st AS (SELECT book, page_num, t, 0 AS i, '' AS open, 0 AS mismatched, 0 AS extra FROM tk UNION ALL
    SELECT book, page_num, t, i + 1, CASE WHEN c IN ('(', '[') THEN open || c WHEN fits THEN left(open, length(open) - 1) ELSE open END,
      mismatched + CASE WHEN c IN (')', ']') AND NOT fits AND open <> '' THEN 1 ELSE 0 END, extra + CASE WHEN c IN (')', ']') AND open = '' THEN 1 ELSE 0 END
    FROM (SELECT *, t[i + 1][2] AS c, open <> '' AND right(open, 1) = (CASE t[i + 1][2] WHEN ')' THEN '(' WHEN ']' THEN '[' END) AS fits FROM st WHERE i < len(t)))"""
_DELIMITERS = with_views("tex_pages").replace("WITH ", "WITH RECURSIVE ", 1) + _STACK + " SELECT book, page_num, mismatched, extra, length(open) AS left_open FROM st WHERE i = len(t)"
register("math_delimiter_balance", lambda v: tex.math_delimiter_balance(v("tex_pages")), _DELIMITERS)
_GAPPY = with_views("gappy_pages") + ", tex_in AS (SELECT book, page_num, tex FROM gappy_pages)"
register("common_format_findings", lambda v: tex.common_format_findings(v("gappy_pages")),
         _GAPPY + ", a AS (" + _at("\\n{4,}") + ") SELECT book, page_num, 'info' AS severity, line, length(m) AS feeds FROM a")
register(
    "findings_report", lambda v: tex.findings_report(v("gappy_pages")),
    (_GAPPY + _BRACES + _ENVS).replace("WITH ", "WITH RECURSIVE ", 1) + _STACK.replace("tex_pages", "tex_in") + f""", e AS (SELECT book, page_num, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM env GROUP BY ALL),
  f AS (SELECT book, page_num, missing_open + unclosed + coalesce(errors, 0) AS errors_count, coalesce(warnings, 0) AS warnings FROM braces LEFT JOIN e USING (book, page_num)),
  mm AS (SELECT book, page_num, mismatched + extra AS bad FROM st WHERE i = len(t))
  SELECT book, page_num, errors_count = 0 AS valid, errors_count, warnings + bad AS warnings_count, {S.count('tex', chr(92) + 'n{4,}')} AS infos FROM f JOIN tex_in USING (book, page_num) JOIN mm USING (book, page_num)""",
)
_NESTED, _ESCAPED = "\\\\\\[\\s*\\\\\\[", "\\\\textbackslash\\{\\}\\s*\\\\?\\]"
_ISOLATED, _DISPLAY = "\\\\\\[\\s*[√∑∫∏±∓≈≠≤≥=+\\-*/·.,:;()\\[\\]{}|\\s]+\\s*\\\\\\]", "(?s)\\\\\\[.*?\\\\\\]"


def _unbalanced(code: str, a: str, b: str) -> str:
    return f"SELECT book, page_num, '{code}' AS code, 'error' AS severity, 1 AS line FROM tex_in WHERE {S.count('tex', a)} <> {S.count('tex', b)}"


_DIAGNOSTICS = f""", n AS ({_at(_NESTED)}), x AS ({_at(_ESCAPED)}), iso AS ({_at(_ISOLATED)}), dis AS ({_at(_DISPLAY)}), diag AS (
  {_unbalanced('unbalanced_display_math', chr(92) * 3 + '[', chr(92) * 3 + ']')} UNION ALL {_unbalanced('unbalanced_inline_math', chr(92) * 3 + '(', chr(92) * 3 + ')')}
  UNION ALL SELECT book, page_num, 'nested_display_math', 'error', line FROM n UNION ALL SELECT book, page_num, 'escaped_math_delimiter', 'error', line FROM x
  UNION ALL SELECT book, page_num, 'isolated_math_fragment', 'warning', line FROM iso
  UNION ALL SELECT book, page_num, 'prose_in_display_math', 'warning', line FROM dis WHERE length(m) >= 28 AND len(regexp_extract_all(m, '[\\x{{4e00}}-\\x{{9fff}}]')) >= 8)"""
# Two more kinds of damage: an escaped closer, and prose inside a display block.
_DAMAGED = """replace(replace(tex, ' q = 2 ', ' 这里是一段很长的中文说明文字而不是公式内容请改为正文段落 '), concat('$ broken'), concat(chr(92), 'textbackslash{} ', chr(92), '] ', chr(92), '[ = ', chr(92), ']'))"""
# Some pages have no LaTeX, as their conversion failed.
_MAYBE = f"CASE WHEN doc_id % 10 <> 3 THEN {_DAMAGED} END"
_DIAG_SQL = with_views("tex_pages") + f""", tex_all AS (SELECT book, page_num, {_MAYBE} AS tex FROM tex_pages), tex_in AS (SELECT * FROM tex_all WHERE tex IS NOT NULL){_DIAGNOSTICS},
  found AS (SELECT * FROM diag UNION ALL SELECT book, page_num, 'conversion_failed', 'error', 1 FROM tex_all WHERE tex IS NULL),
  g AS (SELECT book, page_num, tex IS NULL AS failed, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
    FROM tex_all LEFT JOIN found USING (book, page_num) GROUP BY ALL)"""


def _damaged(v):
    return v("tex_pages").select("book", "page_num", F.expr(_MAYBE).alias("tex"))


register("page_diagnostics", lambda v: tex.page_diagnostics(_damaged(v)), _DIAG_SQL + " SELECT * FROM found")
register(
    "page_status", lambda v: tex.page_status(_damaged(v)),
    _DIAG_SQL + """ SELECT book, page_num, CASE WHEN failed THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'success' END AS status, errors = 0 AS valid,
    CAST(errors AS INT) AS errors_count, CAST(warnings AS INT) AS warnings_count FROM g""",
)
register(
    "page_diagnostic_counts", lambda v: tex.page_diagnostic_counts(_damaged(v)),
    _DIAG_SQL + """ SELECT book, count(*) FILTER (errors = 0 AND warnings = 0) AS ok_pages, count(*) FILTER (errors = 0 AND warnings > 0) AS warning_pages,
    count(*) FILTER (errors > 0) AS failed_pages FROM g GROUP BY book""",
)
register("autofix_tex", lambda v: tex.autofix_tex(v("gappy_pages")).select("book", "page_num", "tex"),
         with_views("gappy_pages") + """, s AS (SELECT book, page_num, regexp_replace(tex, '\\n{3,}', chr(10) || chr(10), 'g') AS tex FROM gappy_pages)
  SELECT book, page_num, replace(replace(tex, concat(chr(10), '}', chr(10)), chr(10)), concat('a &', chr(10), 'b &', chr(10), 'c'), concat('a & b &', chr(10), 'c')) AS tex FROM s""")
_WRAPPED = f"""CASE template WHEN 'beamer' THEN (CASE WHEN contains(tex, '\\begin{{frame}}') THEN {S.strip('tex')} ELSE
    {S.strip("array_to_string(list_transform(range(1, len(bl) + 1), lambda i: concat(chr(92), 'begin{frame}[fragile]', chr(10), chr(92), 'frametitle{第 ', i, ' 页}', chr(10), bl[i], chr(10), chr(92), 'end{frame}', chr(10))), chr(10))")} END) ELSE tex END"""
register(
    "wrap_document", lambda v: v("template_requests").select("book", "part", L.wrap_document(F.col("tex"), F.col("template"), F.col("chinese")).alias("document")),
    with_views("template_requests") + f""", b AS (SELECT *, list_filter(list_transform(regexp_split_to_array(tex, '(?m)^\\s*%\\s*=+\\s*第\\s*\\d+\\s*页\\s*=+\\s*$'), lambda x: {S.strip('x')}), lambda x: x <> '') AS bl FROM template_requests)
  SELECT book, part, concat_ws(chr(10), CASE template WHEN 'report' THEN '\\documentclass[12pt]{{report}}' WHEN 'book' THEN '\\documentclass[12pt]{{book}}'
    WHEN 'beamer' THEN '\\documentclass{{beamer}}' ELSE '\\documentclass[12pt]{{article}}' END, '\\usepackage{{amsmath,amssymb,amsthm}}', '\\usepackage{{graphicx}}', '\\usepackage{{hyperref}}',
    CASE WHEN chinese OR template = 'cn-article' THEN '\\usepackage{{xeCJK}}' END, '', '\\begin{{document}}', '', {_WRAPPED}, '', '\\end{{document}}') AS document FROM b""",
)
