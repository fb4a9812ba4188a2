"""Planning chunks of pages, prompts, and putting results back together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.blocks import BLOCK_WIDTH, number_rows, with_running
from quire.operators.filling import greedy_chunks
from quire.operators.structure import mark_duplicate_headers
from quire.session import cut_lineage

PAGE = ["book", "page_num"]

# Chunk sizes, separators and markers.
FIXED_PAGES, CHAPTER_PAGES, MAX_CHARS = 4, 8, 80_000
CHUNK_SEPARATOR = "\n---\n"
MERGE_FILES = 5


def display_positions(pages: DataFrame, width: int = BLOCK_WIDTH, dense: bool = False) -> DataFrame:
    """Dense 0-based position of each selected page in its book.

    Whole books as ``scan_corpus`` numbers them are ``dense`` already: the position is the page number, and nothing moves.
    """
    if dense:
        return pages.select(*PAGE, F.col("page_num").cast("long").alias("display_idx"))
    numbered = number_rows(pages.select(*PAGE), ["book"], "page_num", "__n", width, counted=True)
    return numbered.select(*PAGE, (F.col("__n") - 1).alias("display_idx"))


def fixed_chunks(pages: DataFrame, size: int = FIXED_PAGES, width: int = BLOCK_WIDTH, dense: bool = False) -> DataFrame:
    """Chunks of a fixed number of pages, keyed by page and never by list position."""
    placed = display_positions(pages, width, dense)
    return placed.select(*PAGE, F.floor(F.col("display_idx") / size).alias("chunk"))


def chapter_chunks(
    pages: DataFrame, boundaries: DataFrame, size: int = CHAPTER_PAGES, width: int = BLOCK_WIDTH, dense: bool = False
) -> DataFrame:
    """Chunks that never cross a chapter start and hold at most ``size`` pages, numbered from 0 in each book."""
    starts = boundaries.select(*PAGE).distinct().withColumn("__start", F.lit(True))
    placed = cut_lineage(display_positions(pages, width, dense).join(starts, PAGE, "left"))
    opens = F.when(F.col("__start") | (F.col("display_idx") == 0), F.col("display_idx"))
    placed = with_running(placed, ["book"], "display_idx", {"__from": (opens, F.max)}, width, counted=True)
    first = F.when((F.col("display_idx") - F.col("__from")) % size == 0, 1).otherwise(0).cast("long")
    numbered = with_running(placed, ["book"], "display_idx", {"__n": (first, F.sum)}, width, counted=True)
    return numbered.select(*PAGE, (F.col("__n") - 1).alias("chunk"))


def char_budget_chunks(pages: DataFrame, max_chars: int = MAX_CHARS, width: int = BLOCK_WIDTH) -> DataFrame:
    """Pages fill chunks in order: one that would take the chunk over ``max_chars`` characters begins the next.

    A longer page is a chunk of its own.  Chunks are numbered from 0 in each book.
    """
    return greedy_chunks(pages.select(*PAGE, F.length("text").alias("chars")), "book", "page_num", "chars", max_chars, width)


def build_batch_prompts(pages: DataFrame, size: int = FIXED_PAGES, dense: bool = False) -> DataFrame:
    """One prompt per chunk: the non-blank pages with their numbers, repeated headers marked.  A chunk is a few pages.

    For whole (``dense``) books the chunk follows from the page number, so texts move once, to their chunk.
    """
    texts = pages.select(*PAGE, "text").where(~T.is_blank("text"))
    if dense:
        chunked = texts.withColumn("chunk", F.floor(F.col("page_num") / size))
    else:
        chunked = texts.join(fixed_chunks(pages, size), PAGE)
    part = F.concat(F.lit("[PAGE "), (F.col("page_num") + 1).cast("string"), F.lit("]\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("page_num", part.alias("t"))))
    prompts = chunked.groupBy("book", "chunk").agg(
        F.count(F.lit(1)).alias("pages"), F.array_join(F.transform(ordered, lambda p: p["t"]), CHUNK_SEPARATOR).alias("prompt"))
    return prompts.withColumn("prompt", mark_duplicate_headers(F.col("prompt")))


def missing_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Non-blank pages without a non-blank result."""
    done = results.where(~T.is_blank("text")).select(*PAGE)
    return pages.where(~T.is_blank("text")).select(*PAGE).join(done, PAGE, "left_anti")


def backfill_pages(first: DataFrame, redone: DataFrame) -> DataFrame:
    """Results of both passes; the later pass wins where both have a page.

    An answer can hold a page twice.  ``section``, where the results have it, is the place of the text in the answer: the last
    one wins; without it the greatest text does.
    """

    def staged(results: DataFrame, number: int) -> DataFrame:
        section = F.col("section") if "section" in results.columns else F.lit(0)
        return results.select(*PAGE, "text", F.lit(number).alias("pass"), section.cast("long").alias("__section"))

    both = staged(first, 1).unionByName(staged(redone, 2))
    return both.groupBy(*PAGE).agg(F.max_by("text", F.struct("pass", "__section", "text")).alias("text"), F.max("pass").alias("pass"))


def page_marker(page):
    return F.concat(F.lit("% ===== 第 "), page.cast("string"), F.lit(" 页 ====="))


def upsert_page_block(blocks: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replace single pages of a document; a replacement without a target is reported, not inserted.

    Replacements are few: the join to them can be broadcast, which a full outer join cannot, so blocks stay in place.
    """
    new = replacements.select(*PAGE, F.col("block").alias("new"))
    old = blocks.select(*PAGE, F.col("block").alias("old"))
    missing = new.join(blocks.select(*PAGE), PAGE, "left_anti").select(*PAGE, F.lit(None).cast("string").alias("old"), "new")
    joined = old.join(new, PAGE, "left").unionByName(missing)
    marker = page_marker(F.col("page_num") + 1)
    clean = T.strip("new")
    bare = F.when(clean.startswith(marker), F.ltrim(F.substring(clean, F.length(marker) + 1, F.length(clean)), F.lit("\r\n"))).otherwise(clean)
    replaced = F.concat(marker, F.lit("\n"), T.rstrip(bare), F.lit("\n\n"))
    status = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "kept").otherwise("replaced")
    return joined.select(*PAGE, status.alias("status"), F.when(status == "replaced", replaced).when(status == "kept", F.col("old")).alias("block"))


def merge_documents(documents: DataFrame, keys: list[str], order: str, tex: str = "tex") -> DataFrame:
    """Concatenate the few documents of one merge request, with separators."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tex).alias("t"))))
    parts = F.transform(ordered, lambda d, i: F.concat(F.lit("% ===== 合并文档 "), (i + 1).cast("string"), F.lit(" =====\n"), d["t"], F.lit("\n\\clearpage\n")))
    return documents.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), T.strip(T.join_lines(parts)).alias("tex"))


def assemble_document(selection: DataFrame, results: DataFrame, translated: bool = False) -> DataFrame:
    """Blocks of each book's document in page order, with a placeholder for pages that failed.

    A book can be arbitrarily long, so the document stays a table of blocks; ``write_tex_corpus`` writes them in
    order and the parts of a book, read one after the other, are the document.
    """
    mode = "翻译并转换" if translated else "转换"
    joined = selection.select(*PAGE).join(results.select(*PAGE, "latex"), PAGE, "left")
    ok = F.col("latex").isNotNull()
    failed = F.concat(F.lit("% 第 "), (F.col("page_num") + 1).cast("string"), F.lit(f" 页{mode}失败\n"))
    block = F.when(ok, F.concat(page_marker(F.col("page_num") + 1), F.lit("\n"), F.col("latex"), F.lit("\n"))).otherwise(failed)
    return joined.select(*PAGE, F.when(ok, "ok").otherwise("failed").alias("status"), block.alias("block"))


PageFunction = Callable[[str], tuple[str, int, int]]


def outline(text: str) -> tuple[str, int, int]:
    """Offline stand-in for a conversion service: text, prompt tokens, completion tokens."""
    if not text.strip():
        raise ValueError("empty page")
    words = len(text.split())
    return f"% {words} words\n{text}", len(text) // 4, words


def account_failure(error: Exception) -> bool:
    """Errors that every further request would meet: the key or the balance is refused."""
    message = str(error).lower()
    return any(mark in message for mark in ("401", "402", "403", "unauthorized", "insufficient balance", "invalid api key"))


def map_pages(pages: DataFrame, convert: PageFunction = outline, fatal: Callable[[Exception], bool] = account_failure) -> DataFrame:
    """Apply a page function in Arrow batches.  A page that fails becomes an error row; the others go on.

    An error that ``fatal`` accepts fails the job instead of spending a request on every other page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                try:
                    rows.append((*convert(text), True, ""))
                except Exception as error:  # one page's failure must not stop the batch
                    if fatal(error):
                        raise
                    rows.append(("", 0, 0, False, str(error)))
            made = pd.DataFrame(rows, columns=["text", "prompt_tokens", "completion_tokens", "ok", "error"], index=batch.index)
            yield pd.concat([batch[PAGE], made], axis=1)

    schema = "book string, page_num int, text string, prompt_tokens bigint, completion_tokens bigint, ok boolean, error string"
    return pages.select(*PAGE, "text").mapInPandas(run, schema)
