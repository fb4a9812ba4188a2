"""The whole way from the raw readings of a page to its text, with one numbering and one move of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import quality as Q
from quire.functions import text as T
from quire.operators import linefilters, margins, pagetext
from quire.operators.blocks import BLOCK_WIDTH, with_blocks
from quire.operators.features import OCR_QUALITY, OCR_REGION_QUALITY, OCR_TABLE_QUALITY
from quire.operators.structure import without_notes

# What a document row may hold besides ``source``, ``doc_id`` and ``text``; a missing column is NULL throughout.
OPTIONAL = {"notes": "array<string>", "reading": "string", "table_text": "string", "has_images": "boolean", "backup": "string"}
_BLOCK = ["__group", "__block"]


def extract_pages(documents: DataFrame, min_ratio: float = margins.MIN_RATIO, width: int = BLOCK_WIDTH) -> DataFrame:
    """Text of every page after all steps of extraction: ``book, page_num, doc_id, origin, text``.

    ``documents`` has one row per page: ``source`` (the book), ``doc_id`` (the order of pages), ``text`` (the text layer) and, where
    known, ``notes`` (squeezed small print at the foot), ``reading`` (a machine reading), ``table_text`` (tables as lines),
    ``has_images`` and ``backup`` (another text layer).  The steps: the layer is normalised and loses its small print; a poor
    layer gives way to the reading, or takes it along where the reading is poorer; tables are appended; page numbers
    go; the text is normalised and its notation mended; a page left empty takes its backup; lines that repeat at the edges of a book's pages go.
    ``origin`` is ``ocr`` where the reading was used, else ``text-layer``.

    NULL texts are empty.  Rows of a NULL source are a book of their own, whose edges stay; rows without a ``doc_id`` come first in
    their book.  The text crosses the network once, by (book, block): numbering, page totals and the repeated lines meet it there.
    """
    columns = [F.col(c) if c in documents.columns else F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items()]
    blocked = with_blocks(documents.select(F.col("source").alias("book"), "doc_id", "text", *columns), ["book"], "doc_id", width)
    blocked = blocked.withColumn("__group", F.struct("book"))
    sizes = blocked.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n"))
    book = Window.partitionBy("__group")
    earlier = F.sum("n").over(book.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    spans = sizes.select(*_BLOCK, F.coalesce(earlier, F.lit(0)).alias("__before"), F.sum("n").over(book).alias("total_pages"))
    place = F.row_number().over(Window.partitionBy(*_BLOCK).orderBy("doc_id", "__tie"))
    numbered = blocked.withColumn("__place", place).join(spans, _BLOCK)
    pages = _read(numbered.withColumn("page_num", (F.col("__before") + F.col("__place") - 1).cast("int")))

    totals = spans.select(F.col("__group.book").alias("book"), "total_pages").distinct()
    keys = margins.margin_lists(margins.repeated_keys(pages, totals, min_ratio))
    per_block = spans.select(*_BLOCK, F.col("__group.book").alias("book")).join(keys, "book").drop("book")
    return margins.drop_margins(pages.join(per_block, _BLOCK, "left")).select("book", "page_num", "doc_id", "origin", "text")


def _read(pages: DataFrame) -> DataFrame:
    """All steps that look at one page alone."""
    layer = pagetext.normalize_page_text(pages)
    layer = layer.withColumn("text", without_notes(F.col("text"), F.col("notes")))
    layer = layer.withColumns({"reading": pagetext.normalized(F.col("reading")), "__quality": Q.text_quality("text")})
    text, reading, tables = F.col("text"), F.col("reading"), F.coalesce("table_text", F.lit(""))
    used = (reading != "") & needs_reading(text, F.col("__quality"), F.col("has_images"), tables != "")
    better = T.is_blank(text) | (Q.text_quality(reading) >= F.col("__quality"))
    merged = F.when(text.contains(reading), text).otherwise(F.concat(text, F.lit(f"\n\n{pagetext.OCR_MARKER}\n"), reading))
    read = layer.withColumn("__used", used).withColumn("text", F.when(~F.col("__used"), text).when(better, reading).otherwise(merged))
    block = F.concat(F.lit(pagetext.TABLE_MARKER + "\n"), tables)
    tabled = F.when(tables == "", text).when(T.is_blank(text), block).otherwise(F.concat(text, F.lit("\n\n"), block))
    cleaned = pagetext.normalize_page_text(linefilters.cleanup_pagination(read.withColumn("text", tabled)))
    mended = pagetext.math_rewrite(cleaned, "extract").withColumn("__kept", F.col("text"))
    spare = linefilters.cleanup_pagination(mended.withColumn("text", F.when(T.is_blank("__kept"), F.coalesce("backup", F.lit(""))).otherwise("")))
    whole = F.when(T.is_blank("__kept"), pagetext.normalized(F.col("text"))).otherwise(F.col("__kept"))
    origin = F.when(F.col("__used"), "ocr").otherwise("text-layer")
    return spare.select(*_BLOCK, "book", "page_num", "doc_id", origin.alias("origin"), whole.alias("text"))


def needs_reading(text: Column, quality: Column, images: Column, tabled: Column) -> Column:
    """Is the text layer too poor to stand alone?"""
    flat = tabled & ~text.contains("\n") & (quality < OCR_TABLE_QUALITY)
    regions = (quality < OCR_REGION_QUALITY) & (F.coalesce(images, F.lit(False)) | tabled)
    return T.is_blank(text) | flat | regions | (quality < OCR_QUALITY)
