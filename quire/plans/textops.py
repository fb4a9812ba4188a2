"""Page text, names, ranges, answers: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import latex as L
from quire.functions import quality as Q
from quire.operators import naming, pagetext, ranges, responses
from quire.plans import sql as S
from quire.plans.registry import register
from quire.plans.views import with_views

# ---- page ranges -------------------------------------------------------------------------------------------------

_PARSED = f""", parts AS (SELECT book, expr, list_filter(list_transform(string_split(expr, ','), lambda p: {S.strip('p')}), lambda p: p <> '') AS parts
    FROM page_requests),
  part AS (SELECT book, expr, i, parts[i] AS p FROM (SELECT book, expr, parts, unnest(range(1, len(parts) + 1)) AS i FROM parts)),
  ends AS (SELECT *, contains(p, '-') AS ranged, string_split(p, '-') AS e FROM part),
  numbers AS (SELECT *, TRY_CAST({S.strip('e[1]')} AS BIGINT) AS a, TRY_CAST({S.strip('e[2]')} AS BIGINT) AS b, TRY_CAST(p AS BIGINT) AS n,
    regexp_full_match(p, '[0-9]+{S.SPACE}*-{S.SPACE}*[0-9]+') AS is_range, regexp_full_match(p, '[0-9]+') AS is_page FROM ends),
  checked AS (SELECT *, CASE
      WHEN regexp_full_match(p, '-[0-9]+') OR regexp_full_match(p, '[0-9]+{S.SPACE}*-{S.SPACE}*-[0-9]+') THEN 'not_positive'
      WHEN ranged AND NOT is_range THEN 'bad_range'
      WHEN ranged AND (a <= 0 OR b <= 0) THEN 'not_positive' WHEN ranged AND a > b THEN 'reversed'
      WHEN ranged AND b - a + 1 > 5000 THEN 'range_too_long'
      WHEN NOT ranged AND NOT is_page THEN 'bad_page' WHEN NOT ranged AND n <= 0 THEN 'not_positive'
      WHEN NOT ranged AND n > 5000 THEN 'out_of_range' END AS err FROM numbers),
  errors AS (SELECT book, arg_min(err, i) FILTER (err IS NOT NULL) AS error FROM checked GROUP BY book),
  single AS (SELECT DISTINCT book, unnest(range(CASE WHEN ranged THEN a ELSE n END - 1, CASE WHEN ranged THEN b ELSE n END)) AS page_num
    FROM checked WHERE err IS NULL AND book IN (SELECT book FROM errors WHERE error IS NULL)),
  lists AS (SELECT book, string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) AS pages FROM single GROUP BY book)"""

register(
    "parse_page_ranges",
    lambda v: ranges.parse_page_ranges(v("page_requests")).select("book", "expr", "error", F.array_join("pages", ",").alias("pages")),
    with_views("page_requests") + _PARSED + """
  SELECT r.book, expr, error, pages FROM page_requests r LEFT JOIN errors USING (book) LEFT JOIN lists USING (book)""",
)
register(
    "select_pages",
    lambda v: ranges.select_pages(v("page_text"), v("page_requests")).select("book", "page_num", "text"),
    with_views("page_text", "page_requests") + _PARSED + """
  SELECT book, page_num, text FROM page_text SEMI JOIN single USING (book, page_num)
  UNION ALL SELECT book, page_num, text FROM page_text WHERE book IN (SELECT book FROM page_requests WHERE expr = '')""",
)
register(
    "compress_page_ranges",
    lambda v: v("page_lists").select("doc_id", ranges.compress_page_ranges(F.col("pages")).alias("pages")),
    with_views("page_lists") + """, cache_requests AS (SELECT * FROM page_lists), n AS (SELECT doc_id, unnest(list_transform(string_split(pages, ','), lambda p: TRY_CAST(p AS BIGINT))) AS p
    FROM cache_requests), g AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM n),
  r AS (SELECT doc_id, min(p) AS a, CASE WHEN min(p) = max(p) THEN CAST(min(p) AS VARCHAR) ELSE concat(min(p), '-', max(p)) END AS run FROM g GROUP BY doc_id, island),
  s AS (SELECT doc_id, string_agg(run, ',' ORDER BY a) AS pages FROM r GROUP BY doc_id)
  SELECT c.doc_id, coalesce(s.pages, '全部') AS pages FROM cache_requests c LEFT JOIN s USING (doc_id)""",
)

# ---- page text ---------------------------------------------------------------------------------------------------

_UNIFIED = "regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?i)\\(?cid:\\d+\\)?', '', 'g')"
register(
    "normalize_page_text",
    lambda v: pagetext.normalize_page_text(v("raw_pages"), "hint"),
    with_views("raw_pages") + f""", u AS (SELECT book, page_num, hint, string_split({_UNIFIED}, chr(10)) AS l FROM raw_pages)
  SELECT book, page_num, hint, CASE WHEN hint IN ('table', 'code')
      THEN trim(array_to_string(list_transform(l, lambda x: {S.rstrip('x')}), chr(10)), chr(10))
      ELSE {S.strip("array_to_string(list_transform(l, lambda x: " + S.strip('x') + "), chr(10))")} END AS text FROM u""",
)


def _rewrites(source: str, rules: list[tuple[str, str, str]]) -> str:
    """Apply rules one after the other and count the matches of each per book.  What a lookahead would test, the
    pattern takes along and the replacement puts back."""
    steps = [f", r0 AS ({source})"]
    for k, (name, pattern, replacement) in enumerate(rules):
        kept = ", ".join(["book", *[f"n_{n}" for n, _, _ in rules[:k]]])
        steps.append(f"r{k + 1} AS (SELECT {kept}, {S.count('text', pattern)} AS n_{name}, regexp_replace(text, '{pattern}', '{replacement}', 'g') AS text FROM r{k})")
    sums = ", ".join(f"CAST(sum(n_{n}) AS BIGINT) AS n_{n}" for n, _, _ in rules)
    return ",\n".join(steps) + f" SELECT book, {sums} FROM r{len(rules)} GROUP BY book"


_N = "([A-Za-z](?:_[a-zA-Z0-9]+)?)"
_T = "^{\\\\mathsf{T}}"
_END = f"({S.NOT_WORD}|$)"
_POWER = ("power", f"({S.WORD})\\^(\\d+)(\\d[}}a-zA-Z]|[^}}a-zA-Z0-9]|$)", "\\1^{\\2}\\3")
EXTRACT = [
    ("dot_transpose", f"{_N}\\.(T)", f"\\1{_T}"), ("space_transpose", f"{_N}{S.SPACE}+T([^a-zA-Z{{]|$)", f"\\1{_T}\\2"),
    ("lower_transpose", f"([A-Z])\\.t{_END}", f"\\1{_T}\\2"), _POWER, ("top", f"({S.WORD}){S.SPACE}*\\\\top{_END}", "\\1^{\\\\top}\\2"),
    ("tag", "\\\\tag\\{([^}]*)\\}", "\\\\qquad (\\1)"),
]
_TRANSPOSE = [
    ("dot_transpose", f"{_N}\\.(T)", f"\\1{_T}"), ("space_transpose", f"{_N}{S.SPACE}+T([^a-zA-Z.]|$)", f"\\1{_T}\\2"),
    ("lower_transpose", f"([A-Z])\\.t{_END}", f"\\1{_T}\\2"), ("top", f"({S.WORD}){S.SPACE}*\\\\top{_END}", "\\1^{\\\\top}\\2"),
    ("tab_top", f"({S.WORD})\\top{_END}", "\\1^{\\\\top}\\2"), ("mathsf", f"({S.WORD}){S.SPACE}*\\\\mathsf\\{{T\\}}", f"\\1{_T}"),
    ("letter_power", f"({S.WORD})\\^([A-Za-z])([^{{a-zA-Z]|$)", "\\1^{\\2}\\3"), ("hermitian", f"({S.WORD})\\.H{_END}", "\\1^{\\\\dagger}\\2"),
]
register(
    "math_rewrite",
    lambda v: pagetext.math_rewrite_counts(v("math_pages").unionByName(v("tex_pages").selectExpr("book", "page_num", "tex AS text")), "transpose"),
    with_views("math_pages", "tex_pages") + _rewrites("SELECT book, text FROM math_pages UNION ALL SELECT book, tex FROM tex_pages", _TRANSPOSE),
)
register("math_rewrite_extract", lambda v: pagetext.math_rewrite_counts(v("math_pages"), "extract"),
         with_views("math_pages") + _rewrites("SELECT book, text FROM math_pages", EXTRACT))
# Words and single other characters: a word counts unless a backslash or hyphen is next to it.
_WORD_COUNTS = ", ".join(
    [f"count(*) FILTER (w = '{k}' AND p = chr(92)) AS n_cmd_{k}" for k in L.COMMANDS]
    + [f"count(*) FILTER (w = '{k}' AND coalesce(p, '') NOT IN (chr(92), '-') AND coalesce(n, '') <> '-') AS n_word_{k}" for k in L.BARE_WORDS])
register(
    "math_rewrite_notation", lambda v: pagetext.math_rewrite_counts(v("math_pages"), "notation"),
    with_views("math_pages") + f""", t AS (SELECT book, page_num, regexp_extract_all(text, '{S.WORD}+|{S.NOT_WORD}') AS t FROM math_pages),
  u AS (SELECT book, lower(w) AS w, lag(w) OVER o AS p, lead(w) OVER o AS n FROM (SELECT book, page_num, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t)
    WINDOW o AS (PARTITION BY book, page_num ORDER BY i)),
  c AS (SELECT book, {_WORD_COUNTS} FROM u GROUP BY book),
  s AS (SELECT book, CAST(sum({S.count('text', _POWER[1])}) AS BIGINT) AS n_power FROM math_pages GROUP BY book)
  SELECT * FROM c JOIN s USING (book)""",
)

_ESCAPES = "CASE c " + " ".join(f"WHEN '{c}' THEN '\\{c}'" for c in "&%$#_{}") + (
    " WHEN '~' THEN '\\textasciitilde{}' WHEN '^' THEN '\\textasciicircum{}' WHEN '\\' THEN '\\textbackslash{}' ELSE c END")
register(
    "escape_tex",
    lambda v: v("marked_pages").select("book", "page_num", L.escape_tex(F.col("text")).alias("text")),
    with_views("marked_pages") + f"""
  SELECT book, page_num, array_to_string(list_transform(string_split(text, ''), lambda c: {_ESCAPES}), '') AS text FROM marked_pages""",
)
# Formula tokens and the text between them alternate, so the two lists zip back together.
_MATH = "\\\\\\([^\\r\\n]*?\\\\\\)"
register(
    "escape_tex_keep_math",
    lambda v: v("marked_pages").select("book", "page_num", L.escape_tex_keep_math(F.col("text")).alias("text")),
    with_views("marked_pages") + f""", s AS (SELECT book, page_num, regexp_split_to_array(text, '{_MATH}') AS plain,
    regexp_extract_all(text, '{_MATH}') AS math FROM marked_pages)
  SELECT book, page_num, array_to_string(list_transform(range(1, len(plain) + 1), lambda i:
    concat(array_to_string(list_transform(string_split(plain[i], ''), lambda c: {_ESCAPES}), ''), coalesce(math[i], ''))), '') AS text FROM s""",
)
_STRIPPED = "tex"
for _p in ["\\\\documentclass(\\[.*?\\])?\\{.*?\\}", "\\\\usepackage(\\[.*?\\])?\\{.*?\\}", "\\\\begin\\{document\\}", "\\\\end\\{document\\}",
           "\\\\title\\{.*?\\}", "\\\\author\\{.*?\\}", "\\\\date\\{.*?\\}", "\\\\maketitle"]:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_p}', '', 'g')"
_STRIPPED = f"regexp_replace({_STRIPPED}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
register(
    "strip_tex_wrapper",
    lambda v: v("wrapped_pages").select("book", "page_num", L.strip_wrapper(F.col("tex")).alias("tex")),
    with_views("wrapped_pages") + f" SELECT book, page_num, {S.strip(_STRIPPED)} AS tex FROM wrapped_pages",
)
_TITLE = f"(?i)(?:^|{S.NOT_WORD})algorithm{S.SPACE}*[0-9]+(?:{S.NOT_WORD}|$)|算法{S.SPACE}*[0-9]+"
_CONTROL = (f"(?i)(?:^|{S.NOT_WORD})(?:input|output|require|ensure|initialize|initialise|while|for|if|then|return|end)(?:{S.NOT_WORD}|$)"
            "|(?:输入|输出|初始化|当|循环|如果|则|返回|结束)")
ALGORITHM = f"(regexp_matches(text, '{_TITLE}') AND regexp_matches(text, '{_CONTROL}'))"
register(
    "attach_algorithm_context",
    lambda v: pagetext.attach_algorithm_context(v("algorithm_pages")),
    with_views("algorithm_pages") + f""" SELECT book, page_num, CASE WHEN {ALGORITHM} THEN concat('[ALGORITHM_CONTEXT]', chr(10), {S.strip('text')})
    ELSE {S.strip('text')} END AS text FROM algorithm_pages""",
)


def quality_sql(text: str) -> str:
    total = f"CAST(length({text}) AS DOUBLE)"
    readable = f"length(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}.,;:!?\\-()\\[\\]{{}}]+', '', 'g')) / {total}"
    weird = f"length(regexp_replace({text}, '[\\x{{0}}-\\x{{3e8}}\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')) / {total}"
    return (f"CASE WHEN length({S.strip(text)}) < 10 THEN CAST(0.0 AS DOUBLE) ELSE greatest(0.0, least(1.0, {readable} - {weird} * 2)) END")


register(
    "text_quality",
    lambda v: v("second_reading").select("book", "page_num", F.round(Q.text_quality("text"), 6).alias("quality")),
    with_views("second_reading") + f" SELECT book, page_num, round({quality_sql('text')}, 6) AS quality FROM second_reading",
)
register(
    "merge_extractions",
    lambda v: pagetext.merge_extractions(v("page_text"), v("partial_reading")),
    with_views("page_text", "partial_reading") + f""", j AS (SELECT book, page_num, {S.strip("coalesce(a.text, '')")} AS one,
    {S.strip("coalesce(b.text, '')")} AS two FROM page_text a FULL JOIN partial_reading b USING (book, page_num)),
  q AS (SELECT *, {quality_sql('one')} AS q1, {quality_sql('two')} AS q2 FROM j),
  c AS (SELECT *, CASE WHEN two = '' THEN 'primary' WHEN one = '' OR q2 >= q1 THEN 'secondary' WHEN contains(one, two) THEN 'primary' ELSE 'merged' END AS source FROM q)
  SELECT book, page_num, source, CASE source WHEN 'primary' THEN one WHEN 'secondary' THEN two
    ELSE concat(one, chr(10), chr(10), '[OCR补充]', chr(10), two) END AS text FROM c""",
)
_COMPACT = f"regexp_replace(text, '{S.SPACE}+', '', 'g')"


def vision_sql(source: str) -> str:
    return f""", c AS (SELECT book, page_num, text, {_COMPACT} AS compact FROM {source}),
  m AS (SELECT *, greatest(length(compact), 1) AS size, string_split(compact, '') AS ch,
    length(regexp_replace(compact, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS readable FROM c),
  f AS (SELECT *, len(list_filter(range(1, greatest(len(ch) - 4, 1)), lambda i: ch[i] = ch[i+1] AND ch[i] = ch[i+2] AND ch[i] = ch[i+3]
      AND ch[i] = ch[i+4] AND ch[i] = ch[i+5])) > 0 AS repeats, (length(compact) - readable) / CAST(size AS DOUBLE) AS symbols FROM m),
  s AS (SELECT book, page_num, text, CAST(0.35 AS DOUBLE) + least(length(compact) / CAST(120 AS DOUBLE), 1.0) * 0.25
      + least(readable / CAST(size AS DOUBLE), 0.9) * 0.35
      - CASE WHEN regexp_matches(text, '(?i)\\x{{fffd}}|\\(cid:\\s*\\d+\\)|cid:\\s*\\d+') THEN 0.30 ELSE 0 END
      - CASE WHEN repeats THEN 0.20 ELSE 0 END
      - CASE WHEN symbols > 0.45 AND NOT regexp_matches(text, '\\\\[a-zA-Z]+|\\$') THEN 0.20 ELSE 0 END
      + CASE WHEN regexp_matches(text, '\\\\[a-zA-Z]+|\\$[^$]+\\$') THEN 0.04 ELSE 0 END AS score FROM f),
  vision AS (SELECT book, page_num, text, CASE WHEN {S.strip('text')} = '' THEN 0.0 ELSE greatest(0.0, least(round_even(CAST(score AS DOUBLE), 3), 0.92)) END AS quality FROM s)"""


register(
    "vision_quality", lambda v: v("marked_pages").select("book", "page_num", F.round(Q.vision_quality("text"), 6).alias("quality")),
    with_views("marked_pages") + vision_sql("marked_pages") + " SELECT book, page_num, quality FROM vision",
)
_SIGNS = " + ".join(S.count("text", p) for p in ["[+\\-*/=<>∫∑∏√∂∇]", "\\\\[a-zA-Z]+", "\\^|\\{|\\}|_", "[α-ωΑ-Ω]", "\\d+[a-zA-Z]+\\d*"])
register(
    "content_type",
    lambda v: v("math_pages").select("book", "page_num", Q.content_type("text").alias("content_type")),
    with_views("math_pages") + f""", c AS (SELECT book, page_num, length({S.strip('text')}) AS size, {_SIGNS} AS signs FROM math_pages)
  SELECT book, page_num, CASE WHEN size = 0 THEN 'unknown' WHEN signs / CAST(size AS DOUBLE) > 0.3 THEN 'formula'
    WHEN signs / CAST(size AS DOUBLE) > 0.05 THEN 'mixed' ELSE 'text' END AS content_type FROM c""",
)

# ---- names -------------------------------------------------------------------------------------------------------

_CLEAN = "trim(translate({}, chr(47) || chr(92) || ':*?\"<>|' || chr(10) || chr(13) || chr(9), '____________'), '. ')"
SAFE_NAME = (
    "concat(left(coalesce(nullif(" + _CLEAN.format("CASE WHEN contains(filename, '.') THEN regexp_extract(filename, '(?s)^(.*)\\.[^.]*$', 1) ELSE filename END")
    + ", ''), 'unnamed'), 200), CASE WHEN contains(filename, '.') AND "
    + _CLEAN.format("regexp_extract(filename, '(?s)\\.([^.]*)$', 1)") + " <> '' THEN '.' || " + _CLEAN.format("regexp_extract(filename, '(?s)\\.([^.]*)$', 1)") + " ELSE '' END)"
)
register("safe_filename", lambda v: v("uploads").select("upload_id", naming.safe_filename(F.col("filename")).alias("safe_name")),
         with_views("uploads") + f" SELECT upload_id, {SAFE_NAME} AS safe_name FROM uploads")
register(
    "admit_uploads", lambda v: naming.admit_uploads(v("uploads")),
    with_views("uploads") + """, r AS (SELECT *, CASE WHEN NOT regexp_matches(filename, '(?i)\\.pdf$') THEN 'extension'
    WHEN size_bytes > 52428800 THEN 'size' ELSE '' END AS reason FROM uploads)
  SELECT upload_id, filename, size_bytes, reason = '' AS admitted, reason FROM r""",
)
register(
    "duplicate_names_in_batch", lambda v: naming.duplicate_names_in_batch(v("uploads")),
    with_views("uploads") + f""", n AS (SELECT batch_id, lower({SAFE_NAME}) AS name, count(*) AS copies FROM uploads GROUP BY ALL),
  b AS (SELECT batch_id, CAST(sum(copies) AS BIGINT) AS files, count(*) FILTER (copies > 1) AS repeated_names FROM n GROUP BY batch_id)
  SELECT *, CASE WHEN files > 5 THEN 'too_many_files' ELSE 'duplicate_name' END AS reason FROM b WHERE files > 5 OR repeated_names > 0""",
)
register(
    "unique_output_names", lambda v: naming.unique_output_names(v("requested_names")),
    with_views("requested_names") + f""", b AS (SELECT upload_id, concat({S.strip("regexp_replace(" + SAFE_NAME + ", '(.)[.][^.]*$', '" + chr(92) + "1')")},
    CASE WHEN translate THEN '_cn' ELSE '' END) AS base FROM requested_names),
  r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY upload_id) AS k FROM b)
  SELECT upload_id, base, concat(base, CASE WHEN k > 1 THEN concat('_', k) ELSE '' END, '.tex') AS output_name FROM r""",
)

# ---- answers -----------------------------------------------------------------------------------------------------

_BOTH = ("SELECT conv_id, turn, 'chat' AS kind, body FROM chat_responses UNION ALL "
         "SELECT conv_id, turn, 'output' AS kind, body FROM output_responses")
register(
    "llm_response_fields",
    lambda v: responses.llm_response_fields(
        v("chat_responses").withColumn("kind", F.lit("chat")).unionByName(v("output_responses").withColumn("kind", F.lit("output"))),
        ["conv_id", "turn", "kind"]),
    with_views("chat_responses", "output_responses") + f""", r AS ({_BOTH})
  SELECT conv_id, turn, kind, coalesce(json_extract_string(body, '$.choices[0].message.content'), '') AS content,
    coalesce(json_extract_string(body, '$.choices[0].message.reasoning_content'), '') AS reasoning,
    coalesce(json_extract_string(body, '$.choices[0].finish_reason'), '') AS finish_reason,
    coalesce(CAST(json_extract_string(body, '$.usage.prompt_tokens') AS BIGINT), 0) AS prompt_tokens,
    coalesce(CAST(json_extract_string(body, '$.usage.completion_tokens') AS BIGINT), 0) AS completion_tokens,
    coalesce(json_extract_string(body, '$.output[1].content[0].text'), '') AS output_text FROM r""",
)
register(
    "response_citations", lambda v: responses.response_citations(v("output_responses"), ["conv_id", "turn"]),
    with_views("output_responses") + """, a AS (SELECT conv_id, turn, unnest(json_extract(body, '$.output[*].content[*].annotations[*]')) AS a,
    generate_subscripts(json_extract(body, '$.output[*].content[*].annotations[*]'), 1) AS i FROM output_responses),
  l AS (SELECT conv_id, turn, a, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS citation_no FROM a WHERE json_extract_string(a, '$.type') = 'url_citation')
  SELECT conv_id, turn, citation_no, json_extract_string(a, '$.url') AS url, json_extract_string(a, '$.title') AS title,
    CAST(json_extract(a, '$.start_index') AS BIGINT) AS start_index, CAST(json_extract(a, '$.end_index') AS BIGINT) AS end_index FROM l""",
)
register(
    "continue_rounds", lambda v: responses.continue_rounds(v("chat_responses")),
    with_views("chat_responses") + """, f AS (SELECT conv_id, turn, json_extract_string(body, '$.choices[0].message.content') AS content,
    json_extract_string(body, '$.choices[0].finish_reason') = 'length' AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM chat_responses),
  g AS (SELECT *, coalesce(bool_and(cut) OVER (PARTITION BY conv_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS go FROM f WHERE round <= 10)
  SELECT conv_id, count(*) AS n_rounds, string_agg(content, '' ORDER BY round) AS content, NOT arg_max(cut, round) AS finished FROM g WHERE go GROUP BY conv_id""",
)
register(
    "pick_version", lambda v: responses.pick_version(v("candidates")),
    with_views("candidates") + """, j AS (SELECT *, regexp_replace(regexp_replace(coalesce(judge, ''), '^```(json)?\\s*', ''), '\\s*```$', '') AS bare FROM candidates),
  w AS (SELECT *, CASE WHEN json_valid(bare) THEN coalesce(CAST(json_extract_string(bare, '$.winner') AS INT), 1)
      WHEN regexp_extract(judge, '"winner"\\s*:\\s*([12])', 1) = '2' THEN 2 ELSE 1 END AS won FROM j),
  c AS (SELECT *, CASE WHEN v1 = '' AND v2 = '' THEN 0 WHEN v2 = '' THEN 1 WHEN v1 = '' THEN 2 WHEN won = 1 THEN 1 ELSE 2 END AS choice FROM w)
  SELECT doc_id, choice, CASE choice WHEN 0 THEN original WHEN 1 THEN v1 ELSE v2 END AS text FROM c""",
)
