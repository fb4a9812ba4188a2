"""Page text: normalising, rewriting notation, context blocks, merging extractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import latex as L
from quire.functions import quality as Q
from quire.functions import text as T

# Markers inside page text, and the signals of a pseudo-code page.
TABLE_MARKER = "[STRUCTURED_TABLE_CONTEXT]"
ALGORITHM_MARKER = "[ALGORITHM_CONTEXT]"
OCR_MARKER = "[OCR补充]"
ALGORITHM_TITLE = f"(?i){T.WORD_START}algorithm{T.SPACE}*[0-9]+{T.WORD_END}|算法{T.SPACE}*[0-9]+"
ALGORITHM_CONTROL = (
    f"(?i){T.WORD_START}(?:input|output|require|ensure|initialize|initialise|while|for|if|then|return|end){T.WORD_END}"
    "|(?:输入|输出|初始化|当|循环|如果|则|返回|结束)"
)
GLYPH_RESIDUE = "(?i)\\(?cid:\\d+\\)?"


def normalized(value: Column, hint: Column | None = None) -> Column:
    """Unify line ends, drop unmapped-glyph residue, trim lines; tables and code keep their left indentation."""
    unified = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "\\r\\n?", "\n"), GLYPH_RESIDUE, "")
    lines = T.split_newlines(unified)
    plain = T.strip(T.join_lines(F.transform(lines, T.strip)))
    if hint is None:
        return plain
    indented = F.btrim(T.join_lines(F.transform(lines, T.rstrip)), F.lit("\n"))
    return F.when(hint.isin("table", "code"), indented).otherwise(plain)


def normalize_page_text(pages: DataFrame, hint: str | None = None) -> DataFrame:
    return pages.withColumn("text", normalized(F.col("text"), F.col(hint) if hint else None))


def math_rewrite(pages: DataFrame, rules: str = "transpose", text: str = "text") -> DataFrame:
    """Apply one rule set in order; ``n_<rule>`` counts the changes of each rule."""
    for name, (needle, pattern, replacement) in L.RULE_SETS[rules].items():
        # Lower case costs more than most rules; only patterns that ignore case need it.
        searched = F.lower(F.col(text)) if pattern.startswith("(?i)") else F.col(text)
        possible = searched.contains(needle)
        pages = pages.withColumns({
            f"n_{name}": F.when(possible, T.count_matches(text, pattern)).otherwise(0),
            text: F.when(possible, F.regexp_replace(text, pattern, replacement)).otherwise(F.col(text)),
        })
    return pages


def math_rewrite_counts(pages: DataFrame, rules: str = "transpose") -> DataFrame:
    """Changes per book and rule."""
    counts = [f"n_{name}" for name in L.RULE_SETS[rules]]
    rewritten = math_rewrite(pages, rules)
    return rewritten.groupBy("book").agg(*[F.sum(c).cast("long").alias(c) for c in counts])


def has_algorithm(value: Column) -> Column:
    return value.rlike(ALGORITHM_TITLE) & value.rlike(ALGORITHM_CONTROL)


def with_algorithm_context(value: Column) -> Column:
    text = T.strip(F.coalesce(value, F.lit("")))
    marked = F.concat(F.lit(ALGORITHM_MARKER + "\n"), text)
    return F.when(~text.contains(ALGORITHM_MARKER) & has_algorithm(text), marked).otherwise(text)


def attach_algorithm_context(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", with_algorithm_context(F.col("text")))


def attach_table_context(pages: DataFrame, tables: DataFrame, on: list[str]) -> DataFrame:
    """Append the tables of a page in one block, separated by a blank line.

    ``tables`` holds ``on``, ``table_text`` and, where a page can have several, ``table_no``, which orders them.
    """
    number = F.col("table_no") if "table_no" in tables.columns else F.lit(1)
    ordered = F.array_sort(F.collect_list(F.struct(number.alias("n"), F.col("table_text").alias("t"))))
    filled = tables.where(F.coalesce("table_text", F.lit("")) != "")
    tables = filled.groupBy(*on).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), "\n\n").alias("table_text"))
    text = T.strip("text")
    block = F.concat(F.lit(TABLE_MARKER + "\n"), F.col("table_text"))
    joined = F.when(F.coalesce(F.col("table_text"), F.lit("")) == "", text).when(text == "", block).otherwise(
        F.concat(text, F.lit("\n\n"), block))
    return pages.join(tables, on, "left").withColumn("text", joined).drop("table_text")


def merge_extractions(
    primary: DataFrame, secondary: DataFrame, quality_fn: Callable[[Column], Column] = Q.text_quality
) -> DataFrame:
    """Choose or merge two readings of a page: the better one wins, otherwise the second is appended."""
    a = primary.select("book", "page_num", F.col("text").alias("first"))
    b = secondary.select("book", "page_num", F.col("text").alias("second"))
    first, second = T.strip(F.coalesce("first", F.lit(""))), T.strip(F.coalesce("second", F.lit("")))
    staged = a.join(b, ["book", "page_num"], "full").withColumns({"first": first, "second": second})
    staged = staged.withColumns({"q1": quality_fn(F.col("first")), "q2": quality_fn(F.col("second"))})
    one, two = F.col("first"), F.col("second")
    rule = (
        F.when(two == "", "primary").when(one == "", "secondary").when(F.col("q2") >= F.col("q1"), "secondary")
        .when(one.contains(two), "primary").otherwise("merged")
    )
    staged = staged.withColumn("source", rule)
    merged = F.concat(one, F.lit(f"\n\n{OCR_MARKER}\n"), two)
    text = F.when(F.col("source") == "primary", one).when(F.col("source") == "secondary", two).otherwise(merged)
    return staged.select("book", "page_num", "source", text.alias("text"))
