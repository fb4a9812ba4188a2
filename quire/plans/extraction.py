"""The extraction of whole books: query and oracle."""

from __future__ import annotations

from quire.operators import extraction
from quire.plans import sql as S
from quire.plans.corpus import MIN_RATIO, repeated_sql, stripped_sql
from quire.plans.registry import register
from quire.plans.scores import furniture_sql
from quire.plans.textops import EXTRACT, quality_sql
from quire.plans.views import with_views


def _normal(value: str) -> str:
    unified = f"regexp_replace(regexp_replace(coalesce({value}, ''), '\\r\\n?', chr(10), 'g'), '(?i)\\(?cid:\\d+\\)?', '', 'g')"
    return S.strip(f"array_to_string(list_transform(string_split({unified}, chr(10)), lambda x: {S.strip('x')}), chr(10))")


def _mended(value: str) -> str:
    for _, pattern, replacement in EXTRACT:
        value = f"regexp_replace({value}, '{pattern}', '{replacement}', 'g')"
    return value


_SQUEEZED = f"lower(regexp_replace(x, '{S.SPACE}+', '', 'g'))"
# The main text and the backup go through the page-number filter side by side.
_STEPS = f""", numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page_num,
    count(*) OVER (PARTITION BY source) AS total_pages, {_normal('text')} AS layer, {_normal('reading')} AS r FROM extraction_inputs),
  noted AS (SELECT * REPLACE (CASE WHEN notes IS NULL THEN layer ELSE {S.strip(
      "array_to_string(list_filter(string_split(layer, chr(10)), lambda x: NOT list_bool_or(list_transform(notes, lambda n: contains(" + _SQUEEZED + ", n)))), chr(10))")} END AS layer) FROM numbered),
  rated AS (SELECT *, {quality_sql('layer')} AS q1, {quality_sql('r')} AS q2 FROM noted),
  decided AS (SELECT *, r <> '' AND (layer = '' OR (table_text IS NOT NULL AND NOT contains(layer, chr(10)) AND q1 < 0.5)
    OR (q1 < 0.28 AND (has_images OR table_text IS NOT NULL)) OR q1 < 0.18) AS used FROM rated),
  read AS (SELECT *, CASE WHEN NOT used THEN layer WHEN layer = '' OR q2 >= q1 THEN r WHEN contains(layer, r) THEN layer
    ELSE concat(layer, chr(10), chr(10), '[OCR补充]', chr(10), r) END AS body FROM decided),
  tabled AS (SELECT *, CASE WHEN table_text IS NULL THEN body WHEN body = '' THEN concat('[STRUCTURED_TABLE_CONTEXT]', chr(10), table_text)
    ELSE concat(body, chr(10), chr(10), '[STRUCTURED_TABLE_CONTEXT]', chr(10), table_text) END AS body2 FROM read),
  twin AS (SELECT source AS book, page_num, total_pages, 0 AS part, body2 AS t FROM tabled UNION ALL SELECT source, page_num, total_pages, 1, backup FROM tabled),
  furniture_pages AS (SELECT concat(book, '/', part) AS book, page_num, total_pages FROM twin),
  furniture_lines AS ({S.exploded("(SELECT concat(book, '/', part) AS book, page_num, coalesce(t, '') AS t FROM twin)", "t", "book, page_num")})
  {furniture_sql()},
  cleaned AS (SELECT book, page_num, {S.strip("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT (furniture AND (head <= 4 OR tail <= 4))), '')")} AS t FROM f GROUP BY ALL),
  ready AS (SELECT book, page_num, {_normal('t')} AS t FROM cleaned),
  page_text AS (SELECT n.source AS book, n.page_num, n.doc_id, CASE WHEN used THEN 'ocr' ELSE 'text-layer' END AS origin,
    CASE WHEN {S.strip(_mended('a.t'))} <> '' THEN {_mended('a.t')} ELSE b.t END AS text
    FROM decided n JOIN ready a ON a.book = concat(n.source, '/0') AND a.page_num = n.page_num JOIN ready b ON b.book = concat(n.source, '/1') AND b.page_num = n.page_num),
  lines AS ({S.exploded('page_text', 'text', 'book, page_num')})"""

register(
    "extract_pages", lambda v: extraction.extract_pages(v("extraction_inputs"), MIN_RATIO),
    with_views("extraction_inputs") + _STEPS + repeated_sql() + stripped_sql("p.book, p.page_num, p.doc_id, p.origin"),
)
