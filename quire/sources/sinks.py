"""Writers, and readers for what they write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_folder

HISTORY_SCHEMA = (
    "seq bigint, filename string, model string, template string, translated boolean, pages string, quality_mode string, output_file string, "
    "timestamp timestamp, batch boolean, batch_id string, stats struct<total_pages: bigint, processed_pages: bigint, total_tokens: bigint, "
    "processing_time: double, cost: struct<pricing_configured: boolean, currency: string, total_cost: double>>"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_tex_corpus(blocks: DataFrame, path: str, partitions: int | None = None, names: DataFrame | None = None) -> None:
    """Write document blocks as text, one folder per book, files in page order.

    ``names`` (``book, output_name``, one row per book, as ``unique_output_names`` gives them with their ``_cn`` and number)
    renames the folders; a book without a name keeps its own.

    Range partitioning by (book, page_num) spreads a long book over several tasks and keeps pages ordered within
    and across its part files.
    """
    keys = ["book", "page_num"]
    if names is not None:
        named = blocks.join(names.select("book", "output_name"), "book", "left")
        blocks = named.withColumn("book", F.coalesce("output_name", "book")).drop("output_name")
    ranged = blocks.repartitionByRange(partitions, *keys) if partitions else blocks.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).select("book", F.col("block").alias("value")).write.partitionBy("book").text(path)


def read_tex_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines of written documents with their book."""
    return spark.read.schema("value string, book string").text(path)


def write_history_json(history: DataFrame, path: str) -> None:
    """Nested history records, one JSON object per line."""
    parts = ["total_pages", "processed_pages", "total_tokens", "processing_time"]
    if "total_cost" in history.columns:
        parts.append(F.struct(F.col("total_cost").isNotNull().alias("pricing_configured"), "total_cost").alias("cost"))
    stats = F.struct(*parts)
    history.select("seq", "filename", "model", "template", "translated", "pages", "quality_mode", "output_file",
                   F.col("ts").cast("timestamp").alias("timestamp"), stats.alias("stats")).write.json(path)


def scan_history_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Flat rows of nested history records; ``multi_line`` for a file that holds one JSON array."""
    records = spark.read.schema(HISTORY_SCHEMA).option("multiLine", multi_line).json(path)
    return records.select(
        "seq", "filename", "model", "template", "translated", "pages", "quality_mode", "output_file", F.col("timestamp").alias("ts"),
        "stats.total_pages", "stats.processed_pages", "stats.total_tokens", "stats.processing_time", F.col("stats.cost.total_cost").alias("total_cost"))
