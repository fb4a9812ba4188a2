"""The queries of the operators, with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, chosen_path, discriminant, gru, langid, oracles, packing, prefix_trie, resampling, simhash, substrings, token_store, toxicity, winnow
from quire.llm.common import fold, new_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_embedding_dedup", oracles.EMBEDDINGS)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "embeddings"))


@register("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    classifier = toxicity.fit(docs, table(spark, folder, "labels").where(fold("doc_id", 3) != 1))
    return toxicity.score(docs, classifier).withColumn("held_out", fold("doc_id", 3) == 1)


@register("op3_chosen_path", oracles.SIMILAR)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.similar_documents(table(spark, folder, "documents"))


@register("op4_token_store")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_store.write_store(table(spark, folder, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_store.digest(token_store.read_store(spark, path))


@register("op5_substrings", oracles.REPEATS)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digested(substrings.drop_repeats(table(spark, folder, "documents")))


@register("op6_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


@register("op7_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@register("op8_language_model")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    scored = gru.score(table(spark, folder, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


@register("op9_winnowing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, folder, "documents"))


@register("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    return langid.predict(docs, model).withColumn("held_out", fold("doc_id", 4) == 2)


@register("op11_quality")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    scored = discriminant.quality(table(spark, folder, "documents"), table(spark, folder, "labels").where(fold("doc_id", 5) != 0))
    return scored.withColumn("held_out", fold("doc_id", 5) == 0)


@register("op12_resampling", oracles.RESAMPLED)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op13_prefix_trie", oracles.CONVERSATIONS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))
