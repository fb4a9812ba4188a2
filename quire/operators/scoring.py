"""Quality of LaTeX pages: statistics, five scores, the weighted grade.  Every score is a Column of its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# What is counted, penalties, weights and grade limits.
MATH_ENVIRONMENTS = (
    "equation|equation\\*|eqnarray|eqnarray\\*|align|align\\*|gather|gather\\*|multline|multline\\*|flalign|flalign\\*|math|displaymath"
)
STATISTICS = {
    "math_env_count": f"\\\\begin\\{{(?:{MATH_ENVIRONMENTS})\\}}",
    "inline_math_count": "\\$[^$]+\\$",
    "tabular_count": "\\\\begin\\{tabular\\*?\\}",
    "figure_count": "\\\\begin\\{figure\\*?\\}",
    "reference_count": "\\\\ref\\{[^}]+\\}",
    "label_count": "\\\\label\\{[^}]+\\}",
    "section_count": "\\\\section\\{",
    "theorem_like_count": "(?i)\\\\begin\\{(?:theorem|lemma|proposition|corollary|definition|proof|example)\\*?\\}",
}
TABULAR = "(?i)\\\\begin\\{tabular\\*?\\}(?:\\[[^\\]]*\\])?\\{([^}]*)\\}([\\s\\S]*?)\\\\end\\{tabular\\*?\\}"
TABULAR_RULE = "\\A\\\\(?:hline|toprule|midrule|bottomrule|cmidrule)"
CELL_BREAK = "(?<!\\\\)(?:\\\\\\\\)*&"
FIGURE = "(?i)\\\\begin\\{figure\\*?\\}[\\s\\S]*?\\\\end\\{figure\\*?\\}"
DOLLAR_PENALTY, DISPLAY_PENALTY, EQUATION_PENALTY = 30, 30, 20
ROW_PENALTY, FIGURE_PENALTY, LABEL_PENALTY, MAX_LABELS = 10, 5, 3, 5
DOCUMENT_PENALTY, SECTION_PENALTY = 30, 10
WEIGHTS = {"formula_score": 0.30, "table_score": 0.20, "image_score": 0.15, "reference_score": 0.15, "structure_score": 0.20}
GRADES = {"A": 90, "B": 75, "C": 60, "D": 40}
LOWEST_GRADE = "F"


def statistics(tex: Column) -> dict[str, Column]:
    counts = {name: T.count_matches(tex, pattern) for name, pattern in STATISTICS.items()}
    return {"total_lines": F.size(T.split_newlines(tex)), "total_chars": F.length(tex), **counts}


def tex_statistics(pages: DataFrame) -> DataFrame:
    return pages.select("book", "page_num", *[c.alias(n) for n, c in statistics(F.col("tex")).items()])


def tabulars(tex: Column) -> Column:
    """Tables of a page as (column spec, body)."""
    return F.arrays_zip(F.regexp_extract_all(tex, F.lit(TABULAR), F.lit(1)).alias("spec"),
                        F.regexp_extract_all(tex, F.lit(TABULAR), F.lit(2)).alias("body"))


def _is_row(line: Column) -> Column:
    s = T.strip(line)
    return (s != "") & ~s.startswith("%") & ~s.rlike(TABULAR_RULE)


def _cells(line: Column) -> Column:
    return T.count_matches(line, CELL_BREAK) + 1


def _columns(spec: Column) -> Column:
    return T.count_matches(spec, "[clr]")


def _bad_rows(tex: Column) -> Column:
    def bad(table: Column) -> Column:
        rows = F.filter(T.split_newlines(table["body"]), lambda line: _is_row(line) & (_cells(line) != _columns(table["spec"])))
        return F.size(rows)

    return F.aggregate(F.transform(tabulars(tex), bad), F.lit(0), lambda a, b: a + b)


def tabular_rows(pages: DataFrame) -> DataFrame:
    """One row per table row of a page, with its cell count and the columns its table declares."""
    tables = pages.select("book", "page_num", F.posexplode_outer(tabulars(F.col("tex"))).alias("table_no", "t")).where("t IS NOT NULL")
    lines = tables.select("book", "page_num", "table_no", F.col("t.spec").alias("spec"),
                          F.posexplode_outer(T.split_newlines("t.body")).alias("row_line", "line"))
    return lines.where(_is_row(F.col("line"))).select(
        "book", "page_num", "table_no", "row_line", T.strip("line").alias("row"), _cells(F.col("line")).alias("cells"),
        _columns(F.col("spec")).alias("columns"))


def issue_counts(tex: Column) -> dict[str, Column]:
    """How often each issue occurs on a page."""
    stats = statistics(tex)
    has_math = (stats["math_env_count"] > 0) | (stats["inline_math_count"] > 0)
    labels = F.array_distinct(F.regexp_extract_all(tex, F.lit("\\\\label\\{([^}]+)\\}"), F.lit(1)))
    refs = F.regexp_extract_all(tex, F.lit("\\\\ref\\{([^}]+)\\}"), F.lit(1))
    unused = F.least(F.size(F.array_except(labels, refs)), F.lit(MAX_LABELS))

    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    return {
        "dollar": flag(has_math & (T.count_char(tex, "$") % 2 != 0)),
        "display": flag(has_math & (T.count_matches(tex, "\\\\\\[") != T.count_matches(tex, "\\\\\\]"))),
        "equation": flag(has_math & (T.count_matches(tex, "(?i)\\\\begin\\{equation\\*?\\}") != T.count_matches(tex, "(?i)\\\\end\\{equation\\*?\\}"))),
        "table_row": F.when(stats["tabular_count"] > 0, _bad_rows(tex)).otherwise(0),
        "figure": F.when(tex.contains("\\includegraphics"), 0).otherwise(T.count_matches(tex, FIGURE)),
        "label": F.when(stats["reference_count"] > 0, unused).otherwise(0),
        "document": flag(tex.contains("\\begin{document}") != tex.contains("\\end{document}")),
        "section": flag(stats["section_count"] == 0),
    }


# Category and severity of each issue.
ISSUES = {
    "dollar": ("formula", "critical"), "display": ("formula", "critical"), "equation": ("formula", "major"),
    "table_row": ("table", "major"), "figure": ("image", "minor"), "label": ("reference", "minor"),
    "document": ("structure", "critical"), "section": ("structure", "minor"),
}


def _with_issue_counts(pages: DataFrame) -> DataFrame:
    return pages.select("book", "page_num", *[c.alias(f"i_{n}") for n, c in issue_counts(F.col("tex")).items()])


def page_scores(pages: DataFrame) -> DataFrame:
    """The five scores, their weighted total and the grade; the grade looks at the total before rounding."""
    def minus(**penalties: int) -> Column:
        left = F.lit(100)
        for issue, penalty in penalties.items():
            left = left - F.col(f"i_{issue}") * penalty
        return F.greatest(F.lit(0), left).cast("int")

    scored = _with_issue_counts(pages).select(
        "book", "page_num",
        minus(dollar=DOLLAR_PENALTY, display=DISPLAY_PENALTY, equation=EQUATION_PENALTY).alias("formula_score"),
        minus(table_row=ROW_PENALTY).alias("table_score"), minus(figure=FIGURE_PENALTY).alias("image_score"),
        minus(label=LABEL_PENALTY).alias("reference_score"),
        minus(document=DOCUMENT_PENALTY, section=SECTION_PENALTY).alias("structure_score"))
    total = F.lit(0.0)
    for score, weight in WEIGHTS.items():
        total = total + F.col(score) * F.lit(weight)
    scored = scored.withColumn("__total", total)
    grade = F.lit(None).cast("string")
    for name, limit in reversed(GRADES.items()):
        grade = F.when(F.col("__total") >= limit, name).otherwise(grade)
    return scored.withColumns({"score": F.bround("__total", 0).cast("int"), "grade": F.coalesce(grade, F.lit(LOWEST_GRADE))}).drop("__total")


def quality_issues(pages: DataFrame) -> DataFrame:
    """One row per page and kind of issue found."""
    entries = [F.struct(F.lit(n).alias("issue"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.col(f"i_{n}").cast("int").alias("n"))
               for n, (c, s) in ISSUES.items()]
    found = _with_issue_counts(pages).select("book", "page_num", F.filter(F.array(*entries), lambda e: e["n"] > 0).alias("found"))
    return found.select("book", "page_num", F.explode_outer("found").alias("e")).where("e IS NOT NULL").select("book", "page_num", "e.*")


def issue_summary(pages: DataFrame) -> DataFrame:
    return quality_issues(pages).groupBy("book", "severity").agg(F.sum("n").alias("issues"), F.count(F.lit(1)).alias("page_kinds"))


def grade_distribution(scores: DataFrame) -> DataFrame:
    """Pages per book and grade, with totals over either."""
    report = scores.cube("book", "grade").agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg("score"), 6).alias("avg_score"), F.grouping("book").alias("__b"), F.grouping("grade").alias("__g"))
    return report.select(F.when(F.col("__b") == 1, "(all)").otherwise(F.col("book")).alias("book"),
                         F.when(F.col("__g") == 1, "(all)").otherwise(F.col("grade")).alias("grade"), "pages", "avg_score")


def ref_label_integrity(pages: DataFrame) -> DataFrame:
    """Per book: references without a label and labels without a reference."""
    def names(kind: str) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all("tex", F.lit(f"\\\\{kind}\\{{([^}}]+)\\}}"), F.lit(1)))
        return pages.select("book", F.explode_outer(found).alias("name")).where("name IS NOT NULL").distinct()

    refs, labels = names("ref"), names("label")
    undefined = refs.join(labels, ["book", "name"], "left_anti").withColumn("problem", F.lit("undefined_ref"))
    unused = labels.join(refs, ["book", "name"], "left_anti").withColumn("problem", F.lit("unused_label"))
    return undefined.unionByName(unused)
