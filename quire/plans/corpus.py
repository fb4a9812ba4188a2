"""Scans, margins: queries and oracles."""

from __future__ import annotations

from quire.operators import margins
from quire.plans import sql as S
from quire.plans.registry import register
from quire.plans.views import with_views
from quire.sources import corpus

# No margin key reaches the default share of pages in the given tables, so the queries ask for less.
MIN_RATIO = 0.05

register("scan_corpus", lambda v: v("page_text"), with_views("page_text") + " SELECT book, page_num, doc_id, lang, text FROM page_text")
register("scan_lines", lambda v: corpus.scan_lines(v("page_text")), with_views("lines") + " SELECT book, page_num, line_no, line FROM lines")
register(
    "file_fingerprint",
    lambda v: corpus.file_fingerprint(v("documents")),
    "SELECT doc_id, md5(text) AS fingerprint, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents",
)

_CANDIDATE = f"""(s <> '' AND NOT starts_with(s, '[') AND length(s) <= 120
    AND NOT (regexp_matches(s, '[。！？!?]\\s*$') AND length(s) > 40))"""
_KEY = f"lower(regexp_replace(regexp_replace(s, '{S.SPACE}+', ' ', 'g'), '\\p{{Nd}}+', '#', 'g'))"

register(
    "margin_noise_candidates",
    lambda v: margins.margin_noise_candidates(v("lines")),
    with_views("lines") + f""", stripped AS (SELECT book, page_num, line_no, {S.strip('line')} AS s FROM lines)
    SELECT book, page_num, line_no, {_KEY} AS margin_key FROM stripped WHERE {_CANDIDATE}""",
)

_REPEATED = f""", filled AS (
    SELECT book, page_num, line_no, line, {S.strip('line')} AS s,
      row_number() OVER (PARTITION BY book, page_num ORDER BY line_no) AS head,
      row_number() OVER (PARTITION BY book, page_num ORDER BY line_no DESC) AS tail
    FROM lines WHERE {S.strip('line')} <> ''),
  keyed AS (SELECT *, {_KEY} AS margin_key, {_CANDIDATE} AS candidate FROM filled),
  totals AS (SELECT book, count(*) AS total_pages FROM page_text GROUP BY book),
  repeated AS (
    SELECT k.book, margin_key, count(DISTINCT page_num) AS n_pages,
      greatest(2, CAST(floor(any_value(total_pages) * {MIN_RATIO} + 0.999) AS BIGINT)) AS threshold
    FROM keyed k JOIN totals USING (book) WHERE candidate AND (head <= 3 OR tail <= 3) GROUP BY k.book, margin_key
    HAVING count(DISTINCT page_num) >= greatest(2, CAST(floor(any_value(total_pages) * {MIN_RATIO} + 0.999) AS BIGINT)))"""


def repeated_sql() -> str:
    """Repeated margin keys of the tables ``lines`` and ``page_text``."""
    return _REPEATED


def stripped_sql(columns: str) -> str:
    """Pages without their repeated margins, after ``repeated_sql``."""
    return f""",
  dropped AS (SELECT k.book, k.page_num, k.line_no FROM keyed k JOIN repeated r USING (book, margin_key)
    WHERE candidate AND (head <= 4 OR tail <= 4)),
  kept AS (SELECT l.book, l.page_num, string_agg(l.line, chr(10) ORDER BY l.line_no) AS joined
    FROM lines l ANTI JOIN dropped d ON l.book = d.book AND l.page_num = d.page_num AND l.line_no = d.line_no
    GROUP BY l.book, l.page_num)
  SELECT {columns}, CASE WHEN p.book IN (SELECT book FROM repeated) THEN {S.strip("coalesce(joined, '')")} ELSE p.text END AS text
  FROM page_text p LEFT JOIN kept USING (book, page_num)"""


register(
    "repeated_margin_lines",
    lambda v: margins.repeated_margin_lines(v("page_text"), MIN_RATIO),
    with_views("lines") + _REPEATED + " SELECT book, margin_key, n_pages, threshold FROM repeated",
)
register(
    "strip_repeated_margins",
    lambda v: margins.strip_repeated_margins(v("page_text"), MIN_RATIO).select("book", "page_num", "text"),
    with_views("lines") + _REPEATED + stripped_sql("p.book, p.page_num"),
)
