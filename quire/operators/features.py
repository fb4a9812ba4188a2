"""Densities, routing hints and reports per page and per book."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import lines as P
from quire.functions import quality as Q
from quire.functions import text as T

# Page size in points where the input has none, limits of a difficult page, routing thresholds.
PAGE_AREA = 612 * 792
FORMULA_LIMIT, TABLE_LIMIT, IMAGE_LIMIT = 0.30, 0.20, 0.15
OCR_TABLE_QUALITY, OCR_REGION_QUALITY, OCR_QUALITY = 0.5, 0.28, 0.18
WIDE_IMAGE = 1.35
FORMULA_ROUTE = 0.20
CODE_WORDS = "def|class|import|from|return|if|else|for|while|switch|case|function|public|private|printf|cout"
CODE_TEXT = f"(?i){T.WORD_START}(?:(?:{CODE_WORDS}){T.WORD_END}|std::(?={T.WORD}))"
CODE_MARKS = "[{};<>]{2,}"


def region_summary(regions: DataFrame) -> DataFrame:
    """Total image area per page, and the shape of the largest image."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    # On equal areas the first region wins, hence the negated id.
    return regions.groupBy("book", "page_num").agg(
        F.sum(width * height).alias("image_area"),
        F.max_by(F.struct(width.alias("w"), height.alias("h")), F.struct(F.abs(width * height), -F.col("region_id"))).alias("largest"))


def page_features(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Formula, table and image density of each page.  Lines are counted inside the row; only regions shuffle.

    ``regions`` carries the size of its page in ``page_width`` and ``page_height``; without them a page is US Letter.
    """
    lines = T.split_newlines("text")
    staged = pages.withColumn("__lines", F.filter(lines, lambda line: ~T.is_blank(line)))
    total = F.greatest(F.lit(1), F.size("__lines"))
    staged = staged.select(
        "book", "page_num",
        (F.size(F.filter("__lines", P.has_formula)) / total).alias("f"),
        (F.size(F.filter("__lines", lambda line: line.rlike(P.TABLE_LINE))) / total).alias("t"))
    sized = {"page_width", "page_height"} <= set(regions.columns)
    page_area = F.max(F.col("page_width") * F.col("page_height")) if sized else F.lit(None).cast("double")
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    images = regions.groupBy("book", "page_num").agg((F.sum(width * height) / F.coalesce(F.nullif(page_area, F.lit(0.0)), F.lit(float(PAGE_AREA)))).alias("i"))
    joined = staged.join(images, ["book", "page_num"], "left").withColumn("i", F.coalesce("i", F.lit(0.0)))
    difficult = (F.col("f") > FORMULA_LIMIT) | (F.col("t") > TABLE_LIMIT) | (F.col("i") > IMAGE_LIMIT)
    return joined.select(
        "book", "page_num", F.bround("f", 3).alias("formula_density"), F.bround("t", 3).alias("table_density"),
        F.bround("i", 3).alias("image_density"), difficult.alias("is_difficult"))


def difficulty_rollup(features: DataFrame) -> DataFrame:
    """Pages, difficult pages and mean densities per book, and over all books."""
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("formula_density", "table_density", "image_density")]
    report = features.rollup("book").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("is_difficult").alias("difficult_pages"), *means, F.grouping("book").alias("__all"))
    return report.withColumn("book", F.when(F.col("__all") == 1, "(all)").otherwise(F.col("book"))).drop("__all")


def layout_hint(text: Column, has_tables: Column, largest: Column) -> Column:
    """table, code or text, by tables, key words, punctuation and the shape of the largest image."""
    wide = F.coalesce((largest["h"] > 0) & (largest["w"] / largest["h"] > WIDE_IMAGE), F.lit(False))
    return F.when(has_tables, "table").when(text.rlike(CODE_TEXT) | text.rlike(CODE_MARKS) | wide, "code").otherwise("text")


def ocr_routing(
    pages: DataFrame, regions: DataFrame, tables: DataFrame, quality_fn: Callable[[Column], Column] = Q.text_quality
) -> DataFrame:
    """Which pages need a machine reading and why, with their layout.

    ``tables`` holds (book, page_num) of pages with tables; ``quality_fn`` is any Column function or pandas UDF.
    """
    marked = tables.select("book", "page_num").distinct().withColumn("has_tables", F.lit(True))
    joined = (
        pages.withColumn("quality", quality_fn(F.col("text"))).join(region_summary(regions), ["book", "page_num"], "left")
        .join(marked, ["book", "page_num"], "left").withColumn("has_tables", F.coalesce("has_tables", F.lit(False)))
    )
    images, tabled, quality = F.col("largest").isNotNull(), F.col("has_tables"), F.col("quality")
    reason = (
        F.when(T.is_blank("text"), "empty")
        .when(tabled & ~F.col("text").contains("\n") & (quality < OCR_TABLE_QUALITY), "flat_table")
        .when((quality < OCR_REGION_QUALITY) & (images | tabled), "poor_with_regions")
        .when(quality < OCR_QUALITY, "poor").otherwise("")
    )
    return joined.select(
        "book", "page_num", (reason != "").alias("should_ocr"), reason.alias("reason"),
        layout_hint(F.col("text"), tabled, F.col("largest")).alias("layout"))


def route_pages(features: DataFrame, stitched: DataFrame, algorithm: DataFrame, high_quality: bool = False) -> DataFrame:
    """Pages for the costly path, with reasons: dense formulas, a formula across pages, pseudo-code."""
    parts = [stitched.select("book", "page_num", F.lit("stitched").alias("reason")),
             algorithm.select("book", "page_num", F.lit("algorithm").alias("reason"))]
    if not high_quality:
        dense = features.where(F.col("formula_density") >= FORMULA_ROUTE)
        parts.append(dense.select("book", "page_num", F.lit("formula").alias("reason")))
    routed = parts[0]
    for part in parts[1:]:
        routed = routed.unionByName(part)
    return routed.groupBy("book", "page_num").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def split_difficult(pages: DataFrame, features: DataFrame) -> DataFrame:
    """Non-blank pages, each marked difficult or normal."""
    difficult = features.where("is_difficult").select("book", "page_num", F.lit(True).alias("difficult"))
    return pages.where(~T.is_blank("text")).select("book", "page_num").join(difficult, ["book", "page_num"], "left").withColumn(
        "difficult", F.coalesce("difficult", F.lit(False)))
