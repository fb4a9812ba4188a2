"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every stage function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chosen_path, langid, packing, substrings, toxicity
from quire.llm.common import stored, table
from quire.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Toxic documents go from this score on.
TOXIC = toxicity.THRESHOLD
# A document stays if it has a letter and this share of its letters is labelled with one language.
LANGUAGE_SHARE = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go, whatever their id.  It learns from the given labels of documents that are here."""
    docs = docs.select(*COLUMNS)
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), TOXIC)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those where no language has half of the letters, go.  It learns from their ``lang``."""
    docs = docs.select(*COLUMNS)
    return langid.accepted(docs, langid.fit(docs), LANGUAGE_SHARE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest ``doc_id`` stays; of rows that repeat an id and a text one stays.

    Different texts under one id are judged apart, and rows without an id stay.  One narrow row per text that goes decides.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64("doc_id", "text"))
    linked = chosen_path.similar_documents(keyed.select(F.col("key").alias("doc_id"), "text")).where("n_links > 0")
    linked = linked.select(F.col("doc_id").alias("key"), "class_id").distinct().join(keyed.select("key", "doc_id").distinct(), "key")
    linked = stored(linked, "linked")
    first = linked.groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = linked.join(first, "class_id").where("key != first.key").select("key")
    return keyed.join(gone, "key", "left_anti").dropDuplicates(["key", "doc_id"]).select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has go; what is left is joined by single spaces.

    Texts without a repeat stay as they are.  ``n_chars`` follows the text.  A document that loses all its words goes.
    """
    judged = substrings.drop_repeats(docs, carry=COLUMNS[1:]).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    return judged.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
                         F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024, remember=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]
# A classifier, hashes of shingles and a tokenizer are not expressible in SQL; tests/llm compares with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
