"""Line predicates, page features, LaTeX scores: queries and oracles."""

from __future__ import annotations

from quire.functions import quality as Q
from quire.operators import features, linefilters, scoring
from quire.plans import sql as S
from quire.plans.registry import register
from quire.plans.textops import quality_sql, vision_sql
from quire.plans.views import with_views

P, W, NW = S.SPACE, S.WORD, S.NOT_WORD

# ---- line predicates ---------------------------------------------------------------------------------------------

_PAGINATION = f"""CASE WHEN s = '' THEN false
    WHEN regexp_full_match(s, '[0-9]{{1,4}}') THEN CAST(s AS INT) = page_num + 1 OR (total_pages > 0 AND CAST(s AS INT) = total_pages)
    WHEN regexp_full_match(s, '[0-9]{{1,4}}{P}*/{P}*[0-9]{{1,4}}') AND CAST(regexp_extract(s, '^[0-9]+') AS INT) = page_num + 1
      AND CAST(regexp_extract(s, '[0-9]+$') AS INT) = total_pages THEN true
    WHEN regexp_full_match(s, '第{P}*[0-9]{{1,4}}{P}*页({P}*(/|共){P}*[0-9]{{1,4}}{P}*页?)?') THEN true
    WHEN regexp_full_match(s, '(?i)(page|p\\.){P}*[0-9]{{1,4}}({P}*(/|of){P}*[0-9]{{1,4}})?') THEN true
    WHEN regexp_full_match(s, '[0-9]{{1,2}}\\.{P}*[\\x{{4e00}}-\\x{{9fff}}]{{2,20}}') THEN true
    WHEN regexp_full_match(s, '第{P}*[0-9]+{P}*章{P}*[\\x{{4e00}}-\\x{{9fff}}]{{2,20}}') THEN true
    WHEN regexp_full_match(s, '[\\x{{4e00}}-\\x{{9fff}}]{{2,12}}{P}+[0-9]+\\.[0-9]+({P}+[\\x{{4e00}}-\\x{{9fff}}]{{1,12}})?') THEN true
    WHEN regexp_full_match(s, '[0-9]+{P}+[0-9]+(\\.[0-9]+)?\\.?{P}*[\\x{{4e00}}-\\x{{9fff}}]{{1,20}}') THEN true
    ELSE regexp_full_match(s, '(?i)(chapter|section){P}+[0-9]+(\\.[0-9]+)*{P}+.{{2,40}}') END"""
_FURNITURE = f""", l AS (SELECT book, page_num, total_pages, line_no, line, {S.strip('line')} AS s,
    row_number() OVER (PARTITION BY book, page_num ORDER BY line_no) AS head, row_number() OVER (PARTITION BY book, page_num ORDER BY line_no DESC) AS tail
    FROM furniture_lines JOIN furniture_pages USING (book, page_num)),
  f AS (SELECT *, {_PAGINATION} AS furniture FROM l)"""


def furniture_sql() -> str:
    """Lines of ``furniture_lines`` with their places from both ends and whether they are furniture, as ``f``."""
    return _FURNITURE


register("pagination_lines", lambda v: linefilters.pagination_lines(v("furniture_pages")),
         with_views("furniture_lines") + _FURNITURE + " SELECT book, page_num, line_no, line FROM f WHERE furniture")
register(
    "cleanup_pagination", lambda v: linefilters.cleanup_pagination(v("furniture_pages")).select("book", "page_num", "text"),
    with_views("furniture_lines") + _FURNITURE + f"""
  SELECT book, page_num, {S.strip("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT (furniture AND (head <= 4 OR tail <= 4))), '')")} AS text
  FROM f GROUP BY book, page_num""",
)


def _kept(condition: str) -> str:
    return (f" SELECT book, page_num, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT ({condition})), '') AS tex "
            "FROM tex_lines GROUP BY book, page_num")


register("standalone_page_numbers", lambda v: linefilters.standalone_page_numbers(v("tex_pages")).select("book", "page_num", "tex"),
         with_views("tex_lines") + _kept(f"regexp_full_match({S.strip('line')}, '[0-9]{{2,4}}')"))
register("excess_rules", lambda v: linefilters.excess_rules(v("tex_pages")).select("book", "page_num", "tex"),
         with_views("tex_lines") + _kept(f"{S.strip('line')} IN ('\\hrule', '\\HRule')"))

_EXTRACTED = " OR ".join(f"regexp_matches(s, '{p}')" for p in [
    f"^(Chapter|CHAPTER|Section|SECTION|Part|PART){P}+[0-9IVX]+",
    f"^(Abstract|ABSTRACT|Introduction|INTRODUCTION|Conclusion|CONCLUSION|References|REFERENCES|Bibliography|Acknowledgement|Appendix)({NW}|$)",
    f"^[0-9]+(\\.[0-9]+){{0,3}}\\.?{P}+[A-Z]({W}|{P}|[\\-:,()]){{2,60}}$", f"^[0-9]+\\.{P}+[A-Z][a-zA-Z]+",
    f"^第{P}*[\\x{{4e00}}-\\x{{9fff}}0-9]+{P}*[章节]",
    f"^(摘要|引言|前言|背景|相关工作|方法|实验|结果|讨论|结论|总结|参考文献|致谢|附录)({NW}|$)"])
_NS = "[^\\t-\\r\\x1c-\\x20\\x85\\p{Z}]"
_CONVERTED = ("length(s) <= 90 AND NOT regexp_matches(s, '[.,;:]$') AND (" + " OR ".join(f"regexp_matches(s, '{p}')" for p in [
    f"(?i)^(chapter|section){P}+[0-9]+({P}|[:.\\-])+{_NS}+", f"^[0-9]+(\\.[0-9]+){{0,3}}\\.?{P}+{_NS}+",
    f"(?i)^(摘要|引言|结论|参考文献|bibliography|references)({NW}|$)"]) + ")")
register(
    "heading_lines", lambda v: linefilters.heading_lines(v("furniture_lines")),
    with_views("furniture_lines") + f""", s AS (SELECT *, {S.strip('line')} AS s FROM furniture_lines),
  f AS (SELECT *, ({_EXTRACTED}) AS extracted, ({_CONVERTED}) AS converted FROM s)
  SELECT book, page_num, line_no, line, extracted, converted FROM f WHERE extracted OR converted""",
)
IS_MATH = f"""CASE WHEN s = '' THEN false WHEN regexp_full_match(s, '\\\\\\([^\\r\\n]+?\\\\\\)') THEN true
    WHEN regexp_matches(s, '\\\\[a-zA-Z]+|\\\\\\[|\\\\begin\\{{|\\$[^$]+\\$') THEN true
    WHEN regexp_matches(s, '\\\\\\([^\\r\\n]*?\\\\\\)') THEN false
    WHEN regexp_full_match(s, '([√∑∫∏±∓≈≠≤≥=+\\-*/·.,:;()\\[\\]{{}}|]|{P})+') THEN false
    WHEN regexp_matches(s, '[∑∫√≤≥≈∞α-ωΑ-Ω]') AND regexp_matches(s, '[A-Za-z0-9_^=+\\-*/]')
      AND (len(regexp_extract_all(s, '[A-Za-z0-9]')) >= 2 OR contains(s, '=')) THEN true
    WHEN regexp_full_match(c, '[A-Za-z](_[A-Za-z0-9]+)?(\\^[A-Za-z0-9{{}}+\\-]+)?') THEN true
    WHEN NOT regexp_full_match(c, '[A-Za-z0-9_{{}}().,+\\-*/^ ]+\\s*(=|<=|>=|<|>)\\s*[A-Za-z0-9_{{}}().,+\\-*/^ ]+') THEN false
    ELSE len(regexp_extract_all(c, '[A-Za-z]{{2,}}')) <= 2 AND NOT regexp_matches(c, '[A-Za-z]{{17,}}') AND NOT regexp_matches(c, '[;:!?]') END"""
SQUEEZED = f"regexp_replace({S.strip('line')}, '{P}+', ' ', 'g')"
register(
    "math_lines_predicate", lambda v: linefilters.math_lines(v("math_lines").unionByName(v("tex_lines"))),
    with_views("math_lines", "tex_lines") + f""", u AS (SELECT * FROM math_lines UNION ALL SELECT * FROM tex_lines),
  t AS (SELECT *, {S.strip('line')} AS s, {SQUEEZED} AS c FROM u)
  SELECT book, page_num, line_no, line FROM t WHERE {IS_MATH}""",
)
_FORMULA = "|".join([
    "\\$[^$]+\\$", "\\\\\\([^)]+\\\\\\)", "\\\\\\[[^\\]]+\\\\\\]", "\\\\begin\\{equation", "\\\\begin\\{align", f"\\\\frac({NW}|$)",
    f"\\\\(sum|int|prod)({NW}|$)", f"\\\\(partial|nabla)({NW}|$)", "\\\\(alpha|beta|gamma|theta|lambda|mu|sigma|omega)",
    "\\^[_a-zA-Z0-9{(]", "[_a-zA-Z0-9}]\\^"])
register("formula_lines", lambda v: linefilters.formula_lines(v("math_lines").unionByName(v("tex_lines"))),
         with_views("math_lines", "tex_lines") + f""", u AS (SELECT * FROM math_lines UNION ALL SELECT * FROM tex_lines)
  SELECT book, page_num, line_no, line FROM u WHERE regexp_matches(line, '{_FORMULA}')""")

# ---- features ----------------------------------------------------------------------------------------------------

_FEATURES = f""", d AS (SELECT book, page_num, CAST(greatest(1, count(*) FILTER ({S.strip('line')} <> '')) AS DOUBLE) AS total,
    count(*) FILTER ({S.strip('line')} <> '' AND regexp_matches(line, '{_FORMULA}')) AS f, count(*) FILTER (regexp_matches(line, '{_NS}{P}{{2,}}{_NS}{P}{{2,}}{_NS}')) AS t
    FROM math_lines GROUP BY book, page_num),
  i AS (SELECT book, page_num, sum((x1 - x0) * (y1 - y0)) / max(page_width * page_height) AS i FROM regions GROUP BY book, page_num),
  x AS (SELECT book, page_num, f / total AS f, t / total AS t, coalesce(i, 0) AS i FROM d LEFT JOIN i USING (book, page_num)),
  features AS (SELECT book, page_num, round_even(f, 3) AS formula_density, round_even(t, 3) AS table_density, round_even(i, 3) AS image_density,
    f > 0.30 OR t > 0.20 OR i > 0.15 AS is_difficult FROM x)"""
FEATURES_SQL = with_views("math_lines", "regions", "page_text") + _FEATURES


def page_features(v):
    return features.page_features(v("math_pages"), v("regions"))


register("page_features", page_features, FEATURES_SQL + " SELECT * FROM features")
register(
    "difficulty_rollup", lambda v: features.difficulty_rollup(page_features(v)),
    FEATURES_SQL + """ SELECT coalesce(book, '(all)') AS book, count(*) AS pages, count(*) FILTER (is_difficult) AS difficult_pages,
    round(avg(formula_density), 6) AS avg_formula_density, round(avg(table_density), 6) AS avg_table_density, round(avg(image_density), 6) AS avg_image_density
  FROM features GROUP BY ROLLUP (book)""",
)
register("split_difficult", lambda v: features.split_difficult(v("math_pages"), page_features(v)),
         FEATURES_SQL + f" SELECT book, page_num, is_difficult AS difficult FROM features JOIN page_text USING (book, page_num) WHERE {S.strip('text')} <> ''")
_CODE = "def|class|import|from|return|if|else|for|while|switch|case|function|public|private|printf|cout"
_ROUTING = f""", img AS (SELECT book, page_num, arg_max(x1 - x0, abs((x1 - x0) * (y1 - y0))) AS w, arg_max(y1 - y0, abs((x1 - x0) * (y1 - y0))) AS h FROM regions GROUP BY ALL),
  j AS (SELECT book, page_num, text, {quality_sql('text')} AS q, w, h, w IS NOT NULL AS images, t.book IS NOT NULL AS tabled
    FROM second_reading LEFT JOIN img USING (book, page_num) LEFT JOIN page_tables t USING (book, page_num)),
  r AS (SELECT *, CASE WHEN {S.strip('text')} = '' THEN 'empty' WHEN tabled AND NOT contains(text, chr(10)) AND q < 0.5 THEN 'flat_table'
      WHEN q < 0.28 AND (images OR tabled) THEN 'poor_with_regions' WHEN q < 0.18 THEN 'poor' ELSE '' END AS reason,
    CASE WHEN tabled THEN 'table' WHEN regexp_matches(text, '(?i)(^|{NW})(({_CODE})({NW}|$)|std::{W})') OR regexp_matches(text, '[{{}};<>]{{2,}}')
      OR coalesce(h > 0 AND w / h > 1.35, false) THEN 'code' ELSE 'text' END AS layout FROM j)"""
register("should_ocr", lambda v: features.ocr_routing(v("second_reading"), v("regions"), v("page_tables")).drop("layout"),
         with_views("second_reading", "regions", "page_tables") + _ROUTING + " SELECT book, page_num, reason <> '' AS should_ocr, reason FROM r")
register("layout_hint", lambda v: features.ocr_routing(v("second_reading"), v("regions"), v("page_tables")).select("book", "page_num", "layout"),
         with_views("second_reading", "regions", "page_tables") + _ROUTING + " SELECT book, page_num, layout FROM r")

# The same routing with another quality function put in.
register(
    "quality_fn", lambda v: features.ocr_routing(v("second_reading"), v("regions"), v("page_tables"), Q.vision_quality).drop("layout"),
    with_views("second_reading", "regions", "page_tables") + vision_sql("second_reading") + f""", img AS (SELECT DISTINCT book, page_num, true AS images FROM regions),
  j AS (SELECT book, page_num, text, quality AS q, coalesce(images, false) AS images, t.book IS NOT NULL AS tabled FROM vision LEFT JOIN img USING (book, page_num) LEFT JOIN page_tables t USING (book, page_num)),
  r AS (SELECT *, CASE WHEN {S.strip('text')} = '' THEN 'empty' WHEN tabled AND NOT contains(text, chr(10)) AND q < 0.5 THEN 'flat_table'
      WHEN q < 0.28 AND (images OR tabled) THEN 'poor_with_regions' WHEN q < 0.18 THEN 'poor' ELSE '' END AS reason FROM j)
  SELECT book, page_num, reason <> '' AS should_ocr, reason FROM r""",
)

# ---- LaTeX scores ------------------------------------------------------------------------------------------------

_ENVS = ("equation|equation\\*|eqnarray|eqnarray\\*|align|align\\*|gather|gather\\*|multline|multline\\*|flalign|flalign\\*|math|displaymath")
_STATS = {
    "math_env_count": f"\\\\begin\\{{({_ENVS})\\}}", "inline_math_count": "\\$[^$]+\\$", "tabular_count": "\\\\begin\\{tabular\\*?\\}",
    "figure_count": "\\\\begin\\{figure\\*?\\}", "reference_count": "\\\\ref\\{([^}]+)\\}", "label_count": "\\\\label\\{([^}]+)\\}",
    "section_count": "\\\\section\\{",
    "theorem_like_count": "(?i)\\\\begin\\{(theorem|lemma|proposition|corollary|definition|proof|example)\\*?\\}"}
_STAT_COLUMNS = ", ".join(f"{S.count('tex', p)} AS {n}" for n, p in _STATS.items())
register("tex_statistics", lambda v: scoring.tex_statistics(v("tex_pages")),
         with_views("tex_pages") + f" SELECT book, page_num, len(string_split(tex, chr(10))) AS total_lines, length(tex) AS total_chars, {_STAT_COLUMNS} FROM tex_pages")

_TABULAR = "(?i)\\\\begin\\{tabular\\*?\\}(?:\\[[^\\]]*\\])?\\{([^}]*)\\}([\\s\\S]*?)\\\\end\\{tabular\\*?\\}"
_ROWS = f""", tb AS (SELECT book, page_num, regexp_extract_all(tex, '{_TABULAR}', 1) AS specs, regexp_extract_all(tex, '{_TABULAR}', 2) AS bodies FROM tex_pages),
  t1 AS (SELECT book, page_num, unnest(range(0, len(specs))) AS table_no, specs, bodies FROM tb),
  t2 AS (SELECT book, page_num, table_no, specs[table_no + 1] AS spec, string_split(bodies[table_no + 1], chr(10)) AS l FROM t1),
  t3 AS (SELECT book, page_num, table_no, spec, l, unnest(range(0, len(l))) AS row_line FROM t2),
  t4 AS (SELECT book, page_num, table_no, spec, row_line, l[row_line + 1] AS line, {S.strip('l[row_line + 1]')} AS row FROM t3),
  trows AS (SELECT book, page_num, table_no, row_line, row, 1 + length(replace(replace(line, chr(92) || chr(92), ''), chr(92) || '&', ''))
      - length(replace(replace(replace(line, chr(92) || chr(92), ''), chr(92) || '&', ''), '&', '')) AS cells, len(regexp_extract_all(spec, '[clr]')) AS columns
    FROM t4 WHERE row <> '' AND NOT starts_with(row, '%') AND NOT regexp_matches(row, '^\\\\(hline|toprule|midrule|bottomrule|cmidrule)'))"""
register("tabular_rows", lambda v: scoring.tabular_rows(v("tex_pages")),
         with_views("tex_pages") + _ROWS + " SELECT book, page_num, table_no, row_line, row, cells, columns FROM trows")

_PAIR = "CASE WHEN {0} THEN 1 ELSE 0 END"
_ISSUES = _ROWS + f""", st AS (SELECT book, page_num, tex, {_STAT_COLUMNS},
    regexp_extract_all(tex, '\\\\label\\{{([^}}]+)\\}}', 1) AS labels, regexp_extract_all(tex, '\\\\ref\\{{([^}}]+)\\}}', 1) AS refs FROM tex_pages),
  bad AS (SELECT book, page_num, count(*) FILTER (cells <> columns) AS bad_rows FROM trows GROUP BY ALL),
  iss AS (SELECT book, page_num,
    {_PAIR.format("math_env_count + inline_math_count > 0 AND (length(tex) - length(replace(tex, '$', ''))) % 2 <> 0")} AS dollar,
    {_PAIR.format("math_env_count + inline_math_count > 0 AND " + S.count('tex', chr(92)*2 + chr(92) + '[') + " <> " + S.count('tex', chr(92)*2 + chr(92) + ']'))} AS display,
    {_PAIR.format("math_env_count + inline_math_count > 0 AND " + S.count('tex', '(?i)' + chr(92)*2 + 'begin' + chr(92) + '{equation' + chr(92) + '*?' + chr(92) + '}') + " <> " + S.count('tex', '(?i)' + chr(92)*2 + 'end' + chr(92) + '{equation' + chr(92) + '*?' + chr(92) + '}'))} AS equation,
    coalesce(bad_rows, 0) AS table_row,
    CASE WHEN contains(tex, '\\includegraphics') THEN 0 ELSE {S.count('tex', '(?i)' + chr(92)*2 + 'begin' + chr(92) + '{figure' + chr(92) + '*?' + chr(92) + '}[' + chr(92) + 's' + chr(92) + 'S]*?' + chr(92)*2 + 'end' + chr(92) + '{figure' + chr(92) + '*?' + chr(92) + '}')} END AS figure,
    CASE WHEN len(refs) = 0 THEN 0 ELSE least(5, len(list_filter(list_distinct(labels), lambda x: NOT list_contains(refs, x)))) END AS label,
    {_PAIR.format("contains(tex, '" + chr(92) + "begin{document}') <> contains(tex, '" + chr(92) + "end{document}')")} AS document,
    {_PAIR.format("section_count = 0")} AS section
    FROM st LEFT JOIN bad USING (book, page_num)),
  sc AS (SELECT book, page_num, greatest(0, 100 - 30 * dollar - 30 * display - 20 * equation) AS formula_score, greatest(0, 100 - 10 * table_row) AS table_score,
    greatest(0, 100 - 5 * figure) AS image_score, greatest(0, 100 - 3 * label) AS reference_score, greatest(0, 100 - 30 * document - 10 * section) AS structure_score FROM iss),
  tt AS (SELECT *, CAST(0 AS DOUBLE) + formula_score * CAST(0.30 AS DOUBLE) + table_score * CAST(0.20 AS DOUBLE) + image_score * CAST(0.15 AS DOUBLE)
    + reference_score * CAST(0.15 AS DOUBLE) + structure_score * CAST(0.20 AS DOUBLE) AS total FROM sc),
  scores AS (SELECT * EXCLUDE (total), CAST(round_even(total, 0) AS INT) AS score,
    CASE WHEN total >= 90 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C' WHEN total >= 40 THEN 'D' ELSE 'F' END AS grade FROM tt)"""
SCORES_SQL = with_views("tex_pages") + _ISSUES
register("quality_score", lambda v: scoring.page_scores(v("tex_pages")), SCORES_SQL + " SELECT * FROM scores")
for _name in ("formula", "table", "image", "reference", "structure"):
    register(f"score_{_name}", lambda v, c=f"{_name}_score": scoring.page_scores(v("tex_pages")).select("book", "page_num", c),
             SCORES_SQL + f" SELECT book, page_num, {_name}_score FROM scores")
register("grade_distribution", lambda v: scoring.grade_distribution(scoring.page_scores(v("tex_pages"))),
         SCORES_SQL + """ SELECT coalesce(book, '(all)') AS book, coalesce(grade, '(all)') AS grade, count(*) AS pages, round(avg(score), 6) AS avg_score
  FROM scores GROUP BY CUBE (book, grade)""")
_LONG = ", long AS (" + " UNION ALL ".join(
    f"SELECT book, page_num, '{n}' AS issue, '{c}' AS category, '{s}' AS severity, {n} AS n FROM iss WHERE {n} > 0" for n, (c, s) in scoring.ISSUES.items()) + ")"
register("quality_issues", lambda v: scoring.quality_issues(v("tex_pages")), SCORES_SQL + _LONG + " SELECT * FROM long")
register("issue_summary", lambda v: scoring.issue_summary(v("tex_pages")),
         SCORES_SQL + _LONG + " SELECT book, severity, CAST(sum(n) AS BIGINT) AS issues, count(*) AS page_kinds FROM long GROUP BY book, severity")
register("ref_label_integrity", lambda v: scoring.ref_label_integrity(v("tex_pages")),
         with_views("tex_pages") + """, r AS (SELECT DISTINCT book, unnest(regexp_extract_all(tex, '\\\\ref\\{([^}]+)\\}', 1)) AS name FROM tex_pages),
  l AS (SELECT DISTINCT book, unnest(regexp_extract_all(tex, '\\\\label\\{([^}]+)\\}', 1)) AS name FROM tex_pages)
  SELECT book, name, 'undefined_ref' AS problem FROM (SELECT * FROM r EXCEPT SELECT * FROM l)
  UNION ALL SELECT book, name, 'unused_label' AS problem FROM (SELECT * FROM l EXCEPT SELECT * FROM r)""")
