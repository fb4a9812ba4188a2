"""Page ranges typed by users: parse, compress, select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# The page limit without a known page count, and the label of a full selection.
HARD_LIMIT = 5000
ALL_PAGES = "全部"

NOT_POSITIVE, BAD_RANGE, REVERSED = "not_positive", "bad_range", "reversed"
RANGE_TOO_LONG, BAD_PAGE, OUT_OF_RANGE = "range_too_long", "bad_page", "out_of_range"


def _number(part: Column) -> Column:
    """A digit string as a number; absurdly long ones count as larger than any limit."""
    return F.when(part.rlike("\\A[0-9]+\\z"), F.coalesce(part.try_cast("bigint"), F.lit(2**62)))


def _part(raw: Column, limit: Column) -> Column:
    part = T.strip(raw)
    ends = F.split(part, "-")
    first, last = _number(T.strip(F.get(ends, 0))), _number(T.strip(F.get(ends, 1)))
    page = _number(part)
    ranged = part.contains("-")
    error = (
        F.when(part.rlike(f"\\A-[0-9]+\\z|\\A[0-9]+{T.SPACE}*-{T.SPACE}*-[0-9]+\\z"), NOT_POSITIVE)
        .when(ranged & ((F.size(ends) != 2) | first.isNull() | last.isNull()), BAD_RANGE)
        .when(ranged & ((first <= 0) | (last <= 0)), NOT_POSITIVE)
        .when(ranged & (first > last), REVERSED)
        .when(ranged & (last - first + 1 > limit), RANGE_TOO_LONG)
        .when(~ranged & page.isNull(), BAD_PAGE)
        .when(~ranged & (page <= 0), NOT_POSITIVE)
        .when(~ranged & (page > limit), OUT_OF_RANGE)
    )
    return F.struct(error.alias("error"), F.when(ranged, first).otherwise(page).alias("first"),
                    F.when(ranged, last).otherwise(page).alias("last"))


def parse_page_ranges(requests: DataFrame, expr: str = "expr", max_pages: Column | None = None) -> DataFrame:
    """Add ``pages`` (sorted distinct 0-based, NULL for "all pages") and ``error`` (class of the first bad part).

    A range is limited by its length, a single page by its value.
    """
    limit = F.coalesce(max_pages, F.lit(HARD_LIMIT)) if max_pages is not None else F.lit(HARD_LIMIT)
    parts = F.filter(F.split(F.coalesce(F.col(expr), F.lit("")), ","), lambda p: ~T.is_blank(p))
    staged = requests.withColumn("__parts", F.transform(parts, lambda p: _part(p, limit)))
    errors = F.filter(F.transform("__parts", lambda p: p["error"]), lambda e: e.isNotNull())
    staged = staged.withColumn("error", F.get(errors, 0))
    spans = F.transform("__parts", lambda p: F.when(p["error"].isNull(), F.sequence(p["first"] - 1, p["last"] - 1)))
    pages = F.array_sort(F.array_distinct(F.flatten(spans))).cast("array<int>")
    return staged.withColumn("pages", F.when((F.size("__parts") > 0) & F.col("error").isNull(), pages)).drop("__parts")


def page_selection(requests: DataFrame) -> DataFrame:
    """One row per requested page; an "all pages" request is one row with a NULL page."""
    parsed = parse_page_ranges(requests).where("error IS NULL")
    return parsed.select("book", F.explode_outer("pages").alias("page_num"))


def select_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages that were asked for.  Both semi joins prune the corpus before any text work; pages out of bounds drop out."""
    selection = page_selection(requests)
    listed = pages.join(selection.where("page_num IS NOT NULL"), ["book", "page_num"], "left_semi")
    whole = pages.join(selection.where("page_num IS NULL").select("book"), "book", "left_semi")
    explicit = selection.where("page_num IS NOT NULL").select("book", "page_num")
    # A book may be asked for both ways; keep each page once.
    return listed.unionByName(whole.join(explicit, ["book", "page_num"], "left_anti"))


def compress_page_ranges(pages: Column) -> Column:
    """'1,2,3,5' becomes '1-3,5'; strings that already hold a range pass through."""
    numbers = F.filter(
        F.transform(F.split(pages, ","), lambda p: F.regexp_extract(p, "^\\s*\\+?([0-9]+)", 1).try_cast("bigint")),
        lambda n: n.isNotNull(),
    )

    def runs(ordered: Column) -> Column:
        starts = F.filter(ordered, lambda n, i: (i == 0) | (F.get(ordered, i - 1) + 1 != n))
        ends = F.filter(ordered, lambda n, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1) != n + 1))
        return F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b)))

    return (
        F.when(pages.isNull() | pages.isin("", "all", "*"), ALL_PAGES)
        .when(pages.contains("-") | (F.size(numbers) == 0), pages)
        .otherwise(F.array_join(T.let(F.array_sort(numbers), runs), ","))
    )
