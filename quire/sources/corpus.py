"""Readers: the raw tables and the page and line views of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.blocks import BLOCK_WIDTH, number_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_corpus(documents: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """One row per page: book, dense 0-based page_num in ``doc_id`` order, and the text."""
    named = documents.select(F.col("source").alias("book"), "doc_id", "lang", "text")
    numbered = number_rows(named, ["book"], "doc_id", "position", width)
    return numbered.select("book", (F.col("position") - 1).cast("int").alias("page_num"), "doc_id", "lang", "text")


def scan_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per line; split only at line feeds, so joining the lines gives the text back."""
    return pages.select("book", "page_num", F.posexplode_outer(T.split_newlines(text)).alias("line_no", "line"))


def file_fingerprint(documents: DataFrame) -> DataFrame:
    """Content hash of each document, the first part of a cache key."""
    return documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("fingerprint"),
                            F.octet_length("text").cast("long").alias("size_bytes"))
