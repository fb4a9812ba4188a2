"""Headers and footers that repeat across the pages of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.blocks import BLOCK_WIDTH

# How many non-blank edge lines vote and how many may be removed, the longest furniture line,
# the marks that end a sentence, the page share a key needs, and the offset of the rounding rule.
VOTING_LINES = 3
REMOVABLE_LINES = 4
MAX_FURNITURE_CHARS = 120
LONG_SENTENCE_CHARS = 40
SENTENCE_END = "[。！？!?]\\s*\\z"
MIN_RATIO = 0.25
ROUND_UP = 0.999


def is_margin_candidate(line: Column) -> Column:
    def test(s: Column) -> Column:
        short = F.length(s).between(1, MAX_FURNITURE_CHARS)
        sentence = (F.length(s) > LONG_SENTENCE_CHARS) & s.rlike(SENTENCE_END)
        return short & ~s.startswith("[") & ~sentence

    return T.let(T.strip(line), test)


def margin_key(line: Column) -> Column:
    """Two lines share a key when they differ only in spacing, case and numbers."""
    squeezed = F.regexp_replace(T.strip(line), f"{T.SPACE}+", " ")
    return F.lower(F.regexp_replace(squeezed, "\\p{Nd}+", "#"))


def margin_noise_candidates(lines: DataFrame) -> DataFrame:
    return lines.where(is_margin_candidate(F.col("line"))).select(
        "book", "page_num", "line_no", margin_key(F.col("line")).alias("margin_key"))


def _margin_counts(pages: DataFrame) -> DataFrame:
    """Pages per (book, key), for keys on two pages or more.

    A page's distinct keys (at most 2 * VOTING_LINES) are found inside the row, so a plain count combined
    map-side is the page count.  The outer explode matters: a plain one makes Catalyst infer a filter on the key array
    and compute it again at the scan.
    """
    filled = F.filter(T.split_lines("text"), lambda line: ~T.is_blank(line))
    edges = F.concat(T.first_n(F.col("__lines"), VOTING_LINES), T.last_n(F.col("__lines"), VOTING_LINES))
    keys = F.array_distinct(F.transform(F.filter(edges, is_margin_candidate), margin_key))
    votes = pages.select("book", filled.alias("__lines")).select("book", keys.alias("__keys"))
    counts = votes.select("book", F.explode_outer("__keys").alias("margin_key")).groupBy("book", "margin_key").agg(
        F.count(F.lit(1)).alias("n_pages"))
    return counts.where("n_pages >= 2 AND margin_key IS NOT NULL")


def repeated_margin_lines(pages: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Furniture keys seen on enough pages of a book.  Page totals need no text, so the text is read once."""
    totals = pages.groupBy("book").agg(F.count(F.lit(1)).alias("total_pages"))
    return repeated_keys(pages, totals, min_ratio)


def repeated_keys(pages: DataFrame, totals: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``repeated_margin_lines`` with the page totals of the books (``book, total_pages``) at hand."""
    threshold = F.greatest(F.lit(2), F.floor(F.col("total_pages") * F.lit(min_ratio) + F.lit(ROUND_UP)))
    thresholds = totals.select("book", threshold.cast("long").alias("threshold"))
    return _margin_counts(pages).join(thresholds, "book").where("n_pages >= threshold").select("book", "margin_key", "n_pages", "threshold")


def margin_lists(repeated: DataFrame) -> DataFrame:
    """The repeated keys of each book as one list, ``__keys``.

    Each page casts at most 6 votes, so a book has at most ``6 / min_ratio`` repeated keys whatever its length.
    """
    return repeated.groupBy("book").agg(F.collect_list("margin_key").alias("__keys"))


def strip_repeated_margins(pages: DataFrame, min_ratio: float = MIN_RATIO, width: int = BLOCK_WIDTH) -> DataFrame:
    """Remove repeated furniture from the first and last lines of each page.

    The list of a book goes to each of its blocks of ``width`` pages, one row per block, and meets the pages there: where the
    lists of all books are too large to broadcast, the text is dealt out by (book, block), so that a book of a third of all
    pages is many tasks.  Pages are cleaned inside the row.
    """
    blocked = pages.withColumn("__block", F.coalesce(F.floor(F.col("page_num") / width), F.lit(-1)))
    lists = margin_lists(repeated_margin_lines(pages, min_ratio))
    per_block = blocked.select("book", "__block").distinct().join(lists, "book")
    return drop_margins(blocked.join(per_block, ["book", "__block"], "left")).drop("__block")


def drop_margins(joined: DataFrame) -> DataFrame:
    """Clean pages that carry the repeated keys of their book as ``__keys``; where that is NULL the text stays as it is."""
    staged = joined.withColumn("__lines", T.split_lines("text"))
    filled = F.filter(T.positions(F.col("__lines")), lambda i: ~T.is_blank(F.get(F.col("__lines"), i)))
    staged = staged.withColumn("__filled", filled)
    removable = F.array_union(T.first_n(F.col("__filled"), REMOVABLE_LINES), T.last_n(F.col("__filled"), REMOVABLE_LINES))
    staged = staged.withColumn("__edges", removable)

    def keep(line: Column, i: Column) -> Column:
        furniture = is_margin_candidate(line) & F.array_contains("__keys", margin_key(line))
        return ~(F.array_contains("__edges", i) & furniture)

    cleaned = T.strip(T.join_lines(F.filter("__lines", keep)))
    text = F.when(F.col("__keys").isNull(), F.col("text")).otherwise(cleaned)
    return staged.withColumn("text", text).drop("__lines", "__filled", "__edges", "__keys")
