"""Line-level filters.  Lines are cut and put back inside the row, so no page ever crosses the network for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import latex as L
from quire.functions import lines as P
from quire.functions import text as T

# Fixed value: raw lines at each page edge that may hold page numbers.
PAGINATION_WINDOW = 4




def pagination_lines(pages: DataFrame) -> DataFrame:
    """Lines that are page furniture, anywhere on the page."""
    lines = pages.select("book", "page_num", "total_pages", F.posexplode_outer(T.split_lines("text")).alias("line_no", "line"))
    found = P.is_pagination(F.col("line"), F.col("page_num"), F.col("total_pages"))
    return lines.where(found).select("book", "page_num", "line_no", "line")


def cleanup_pagination(pages: DataFrame) -> DataFrame:
    """Drop page furniture among the first and last raw lines of each page."""
    staged = pages.withColumn("__lines", T.split_lines("text"))

    def keep(line: Column, i: Column) -> Column:
        edge = (i < PAGINATION_WINDOW) | (i >= F.size("__lines") - PAGINATION_WINDOW)
        return ~(edge & P.is_pagination(line, F.col("page_num"), F.col("total_pages")))

    return staged.withColumn("text", T.strip(T.join_lines(F.filter("__lines", keep)))).drop("__lines")


def standalone_page_numbers(pages: DataFrame, tex: str = "tex") -> DataFrame:
    return pages.withColumn(tex, L.drop_page_numbers(F.col(tex)))


def excess_rules(pages: DataFrame, tex: str = "tex") -> DataFrame:
    return pages.withColumn(tex, L.drop_rules(F.col(tex)))


def heading_lines(lines: DataFrame) -> DataFrame:
    """Lines that look like headings, by the rules for extracted text and for text to convert."""
    line = T.strip("line")
    flagged = lines.withColumns({"extracted": P.is_heading(line), "converted": P.is_text_heading(F.col("line"))})
    return flagged.where("extracted OR converted").select("book", "page_num", "line_no", "line", "extracted", "converted")


def math_lines(lines: DataFrame) -> DataFrame:
    return lines.where(P.is_math(F.col("line"))).select("book", "page_num", "line_no", "line")


def formula_lines(lines: DataFrame) -> DataFrame:
    return lines.where(P.has_formula(F.col("line"))).select("book", "page_num", "line_no", "line")
