"""Cleaning and checking LaTeX pages.  Everything here works inside one row: no exchange, whatever the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import latex as L
from quire.functions import text as T

# Names of known environments.
KNOWN_ENVIRONMENTS = (
    "document equation eqnarray align align* gather gather* multline multline* flalign flalign* tabular tabular* table figure "
    "center flushleft flushright quote quotation verse itemize enumerate description theorem lemma proof definition corollary "
    "proposition remark example exercise problem solution algorithm algorithmic frame columns column abstract titlepage part "
    "chapter section subsection subsubsection paragraph subparagraph bibliography thebibliography references verbatim listing "
    "minipage vbox hbox multicol sidebysideside caption label ref footnote marginpar hyperref href babel input include "
    "includegraphics centering raggedright raggedleft toprule midrule bottomrule cmidrule hline rowcolor cellcolor rowlines "
    "columncolor rotate scalebox resizebox phantom frac sqrt binom choose underbrace overbrace textbf textit texttt textsf "
    "scshape slshape series fontseries fontshape fontfamily text mbox fbox savebox parbox makebox rule raisebox settowidth "
    "settoheight"
).split()
# Patterns of the page checks, (code, severity, pattern).
POSITIONAL_CHECKS = [
    ("nested_display_math", "error", "\\\\\\[\\s*\\\\\\["),
    ("escaped_math_delimiter", "error", "\\\\textbackslash\\{\\}\\s*\\\\?\\]"),
    ("isolated_math_fragment", "warning", "\\\\\\[\\s*[√∑∫∏±∓≈≠≤≥=+\\-*/·.,:;()\\[\\]{}|\\s]+\\s*\\\\\\]"),
]
COUNT_CHECKS = [
    ("unbalanced_display_math", "\\\\\\[", "\\\\\\]"),
    ("unbalanced_inline_math", "\\\\\\(", "\\\\\\)"),
]
CONVERSION_FAILED = "conversion_failed"
PROSE_CHECK = ("prose_in_display_math", "warning", "(?s)\\\\\\[(.*?)\\\\\\]")
COMMENT = "%[^\\n]*"
ENVIRONMENT_TOKEN = "%[^\\n]*|\\\\(?:begin|end)\\{[^}]*\\}?"
MATH_TOKEN = "%[^\\n]*|\\\\\\p{L}[^ \\n{}]*|\\\\[()\\[\\]]"
BLANK_RUN = "\\n{4,}"
TOKEN = "%[^\\n]*|\\\\(?:begin|end)\\{[^}]*\\}|\\\\[()\\[\\]]|[{}]"
SHORT_LINE = 20


def sanitize_tex(pages: DataFrame, tex: str = "tex") -> DataFrame:
    """The whole cleaning chain.  One projection per step keeps each step's input computed once."""
    for step in L.CLEANING_STEPS:
        pages = pages.withColumn(tex, step(F.col(tex)))
    return pages


def repair_display_math(pages: DataFrame, tex: str = "tex") -> DataFrame:
    return pages.withColumn(tex, L.repair_display(F.col(tex)))


def align_to_aligned(pages: DataFrame, tex: str = "tex") -> DataFrame:
    return pages.withColumn(tex, L.align_to_aligned(F.col(tex)))


def repair_tabular_rows(pages: DataFrame, tex: str = "tex") -> DataFrame:
    for step in (L.repair_tabular_blocks, L.fill_empty_tables, L.repair_table_lines):
        pages = pages.withColumn(tex, step(F.col(tex)))
    return pages


def tex_tokens(pages: DataFrame, tex: str = "tex") -> DataFrame:
    """Delimiters, environments and braces outside comments, with their lines."""
    found = F.filter(T.match_lines(F.col(tex), TOKEN), lambda t: ~t["match"].startswith("%"))
    exploded = pages.select("book", "page_num", F.posexplode_outer(found).alias("token_no", "t")).where("t IS NOT NULL")
    return exploded.select("book", "page_num", "token_no", "t.line", F.col("t.match").alias("token"))


def _brace_counts(tex: Column) -> Column:
    braces = F.regexp_replace(F.regexp_replace(tex, COMMENT, ""), "[^{}]+", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("missing"))

    def step(state: Column, brace: Column) -> Column:
        return (
            F.when(brace == "{", F.struct((state["open"] + 1).alias("open"), state["missing"].alias("missing")))
            .when(state["open"] > 0, F.struct((state["open"] - 1).alias("open"), state["missing"].alias("missing")))
            .otherwise(F.struct(state["open"].alias("open"), (state["missing"] + 1).alias("missing")))
        )

    return F.aggregate(F.filter(F.split(braces, ""), lambda b: b != ""), start, step)


def brace_balance(pages: DataFrame) -> DataFrame:
    """Closers without an opener and openers without a closer; a percent sign hides the rest of its line."""
    counted = pages.select("book", "page_num", _brace_counts(F.col("tex")).alias("b"))
    return counted.select("book", "page_num", F.col("b.missing").alias("missing_open"), F.col("b.open").alias("unclosed"))


_FINDING = "array<struct<problem: string, severity: string, line: int, name: string>>"


def _environment_findings(tex: Column) -> Column:
    known = F.array(*[F.lit(n) for n in KNOWN_ENVIRONMENTS])
    tokens = F.filter(T.match_lines(tex, ENVIRONMENT_TOKEN), lambda t: ~t["match"].startswith("%"))
    parsed = F.transform(tokens, lambda t: F.struct(
        t["line"].alias("line"), t["match"].startswith("\\begin").alias("opens"),
        F.regexp_extract(t["match"], "(?s)\\{([^}]*)", 1).alias("name")))
    start = F.struct(F.array().cast("array<struct<line: int, name: string>>").alias("open"), F.array().cast(_FINDING).alias("found"))

    def finding(problem: str, severity: str, line: Column, name: Column) -> Column:
        return F.struct(F.lit(problem).alias("problem"), F.lit(severity).alias("severity"), line.alias("line"), name.alias("name"))

    def step(state: Column, t: Column) -> Column:
        is_known = F.array_contains(known, F.rtrim(t["name"], F.lit("*")))
        top = F.element_at(F.when(F.size(state["open"]) > 0, state["open"]), -1)
        depth = F.size(state["open"])
        opened = (
            F.when(t["opens"] & is_known, F.array_append(state["open"], F.struct(t["line"].alias("line"), t["name"].alias("name"))))
            .when(~t["opens"] & (depth > 0), F.slice(state["open"], F.lit(1), depth - 1)).otherwise(state["open"])
        )
        mismatch = ~t["opens"] & (depth > 0) & (top["name"] != t["name"])
        extra = ~t["opens"] & (depth == 0) & is_known
        found = (
            F.when(mismatch, F.array_append(state["found"], finding("mismatch", "error", t["line"], t["name"])))
            .when(extra, F.array_append(state["found"], finding("extra_end", "warning", t["line"], t["name"]))).otherwise(state["found"])
        )
        return F.struct(opened.alias("open"), found.alias("found"))

    def finish(state: Column) -> Column:
        return F.concat(state["found"], F.transform(state["open"], lambda o: finding("unclosed", "error", o["line"], o["name"])))

    return F.aggregate(parsed, start, step, finish)


def environment_pairing(pages: DataFrame) -> DataFrame:
    """Environments that do not pair up.  Only known names open; every end closes."""
    found = pages.select("book", "page_num", F.explode_outer(_environment_findings(F.col("tex"))).alias("f"))
    return found.where("f IS NOT NULL").select("book", "page_num", "f.*")


def _math_counts(tex: Column) -> Column:
    tokens = F.filter(F.regexp_extract_all(tex, F.lit(MATH_TOKEN), F.lit(0)), lambda t: t.rlike("\\A\\\\[()\\[\\]]\\z"))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("mismatched"), F.lit(0).alias("extra"))

    def step(state: Column, t: Column) -> Column:
        opens = t.isin("\\(", "\\[")
        depth = F.size(state["open"])
        wanted = F.when(t == "\\)", "\\(").otherwise("\\[")
        fits = (depth > 0) & (F.element_at(F.when(depth > 0, state["open"]), -1) == wanted)
        opened = F.when(opens, F.array_append(state["open"], t)).when(fits, F.slice(state["open"], F.lit(1), depth - 1)).otherwise(state["open"])
        return F.struct(
            opened.alias("open"), (state["mismatched"] + F.when(~opens & ~F.coalesce(fits, F.lit(False)) & (depth > 0), 1).otherwise(0)).alias("mismatched"),
            (state["extra"] + F.when(~opens & (depth == 0), 1).otherwise(0)).alias("extra"))

    return F.aggregate(tokens, start, step)


def math_delimiter_balance(pages: DataFrame) -> DataFrame:
    """Closers that do not fit or have nothing to close; a closer that does not fit closes nothing."""
    counted = pages.select("book", "page_num", _math_counts(F.col("tex")).alias("m"))
    return counted.select("book", "page_num", "m.mismatched", "m.extra", F.size("m.open").alias("left_open"))


def common_format_findings(pages: DataFrame) -> DataFrame:
    """Runs of four or more line feeds."""
    found = pages.select("book", "page_num", F.explode_outer(T.match_lines(F.col("tex"), BLANK_RUN)).alias("f")).where("f IS NOT NULL")
    return found.select("book", "page_num", F.lit("info").alias("severity"), "f.line", F.length("f.match").alias("feeds"))


def findings_report(pages: DataFrame) -> DataFrame:
    """Errors and warnings per page over all syntax checks; valid means no error."""
    tex = F.col("tex")
    staged = pages.select("book", "page_num", _brace_counts(tex).alias("b"), _environment_findings(tex).alias("e"), _math_counts(tex).alias("m"),
                          T.count_matches(tex, BLANK_RUN).alias("infos"))

    def of(severity: str) -> Column:
        return F.size(F.filter("e", lambda f: f["severity"] == severity))

    errors = F.col("b.missing") + F.col("b.open") + of("error")
    warnings = of("warning") + F.col("m.mismatched") + F.col("m.extra")
    return staged.select("book", "page_num", (errors == 0).alias("valid"), errors.alias("errors_count"), warnings.alias("warnings_count"), "infos")


def _findings() -> Column:
    """Findings of the page in ``tex``; a page without LaTeX is one that failed to convert, and has that one finding."""
    tex = F.col("tex")

    def entry(code: str, severity: str, line: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), line.cast("int").alias("line"))

    def entries(code: str, severity: str, matches: Column) -> Column:
        return F.transform(matches, lambda m: entry(code, severity, m["line"]))

    none = F.array().cast("array<struct<code: string, severity: string, line: int>>")
    found = [F.when(T.count_matches(tex, a) != T.count_matches(tex, b), F.array(entry(code, "error", F.lit(1)))).otherwise(none) for code, a, b in COUNT_CHECKS]
    for code, severity, pattern in POSITIONAL_CHECKS:
        found.append(entries(code, severity, T.match_lines(tex, pattern)))
    code, severity, pattern = PROSE_CHECK

    def is_prose(m: Column) -> Column:
        return (F.length(m["match"]) - 4 >= L.CJK_LENGTH) & (T.count_matches(m["match"], "[\\u4e00-\\u9fff]") >= L.CJK_CHARS)

    found.append(entries(code, severity, F.filter(T.match_lines(tex, pattern), is_prose)))
    return F.when(tex.isNull(), F.array(entry(CONVERSION_FAILED, "error", F.lit(1)))).otherwise(F.concat(*found))


def page_diagnostics(pages: DataFrame) -> DataFrame:
    """Delimiter and formula problems of each page, one row per finding; pages without LaTeX (null ``tex``) failed to convert."""
    exploded = pages.select("book", "page_num", F.explode_outer(_findings()).alias("d")).where("d IS NOT NULL")
    return exploded.select("book", "page_num", "d.*")


def page_status(pages: DataFrame) -> DataFrame:
    """One row per page: whether it converted (``error``: it did not), and how many errors and warnings it has.

    Whole pages of a selection come from a left join of it with the results, as failed pages have none.
    """
    counted = pages.select("book", "page_num", F.col("tex").isNull().alias("failed"), _findings().alias("found"))
    of = lambda severity: F.size(F.filter("found", lambda d: d["severity"] == severity))
    counted = counted.select("book", "page_num", "failed", of("error").alias("errors_count"), of("warning").alias("warnings_count"))
    status = F.when(F.col("failed"), "error").when(F.col("warnings_count") > 0, "warning").otherwise("success")
    return counted.select("book", "page_num", status.alias("status"), (F.col("errors_count") == 0).alias("valid"), "errors_count", "warnings_count")


def page_diagnostic_counts(pages: DataFrame) -> DataFrame:
    """Pages per book that are fine, have warnings only, or have errors, failed ones included."""
    errors, warnings = F.col("errors_count") > 0, F.col("warnings_count") > 0
    return page_status(pages).groupBy("book").agg(
        F.count_if(~errors & ~warnings).alias("ok_pages"), F.count_if(~errors & warnings).alias("warning_pages"), F.count_if(errors).alias("failed_pages"))


def autofix_tex(pages: DataFrame, tex: str = "tex") -> DataFrame:
    """Squeeze blank lines, drop lone closing braces, join a short line that ends in & with the next.

    Lines become one letter each, c for a line to join with the next; the pattern ``c.|.`` then cuts the page into
    single lines and non-overlapping pairs.
    """
    squeezed = T.squeeze_blank_lines(F.col(tex))
    kept = F.filter(T.split_newlines(squeezed), lambda line: T.strip(line) != "}")
    staged = pages.withColumn("__l", kept)

    def letter(line: Column, i: Column) -> Column:
        s, following = T.strip(line), T.strip(F.get("__l", i + 1))
        joins = s.endswith("&") & (F.length(s) < SHORT_LINE) & (following != "") & ~following.startswith("\\") & ~following.startswith("%")
        return F.when(F.coalesce(joins, F.lit(False)), "c").otherwise("-")

    staged = staged.withColumn("__groups", F.regexp_extract_all(F.array_join(F.transform("__l", letter), ""), F.lit("c.|."), F.lit(0)))

    def cut(group: Column, k: Column) -> Column:
        first = T.total(F.transform(F.slice("__groups", 1, k), F.length)).cast("int")
        line = F.get("__l", first)
        return F.when(F.length(group) == 2, F.concat(T.rstrip(line), F.lit(" "), T.lstrip(F.get("__l", first + 1)))).otherwise(line)

    joined = F.when(F.exists("__groups", lambda g: F.length(g) == 2), F.transform("__groups", cut)).otherwise(F.col("__l"))
    return staged.withColumn(tex, T.join_lines(joined)).drop("__l", "__groups")
