"""Fields of model answers stored as JSON, and long answers continued over several rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

CHAT_SCHEMA = (
    "choices array<struct<finish_reason: string, message: struct<content: string, reasoning_content: string>>>, "
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>, output_text string, "
    "output array<struct<type: string, content: array<struct<type: string, text: string, annotations: "
    "array<struct<type: string, url: string, title: string, start_index: bigint, end_index: bigint>>>>>>"
)
# Rounds of one answer, and the reason that asks for another.
MAX_ROUNDS = 10
CUT_OFF = "length"


def _parsed(responses: DataFrame, body: str) -> DataFrame:
    return responses.withColumn("__r", F.from_json(body, CHAT_SCHEMA))


def _first_output_text() -> Column:
    messages = F.filter("__r.output", lambda o: o["type"] == "message")
    texts = F.filter(F.flatten(F.transform(messages, lambda m: F.coalesce(m["content"], F.array()))), lambda c: c["type"] == "output_text")
    return F.coalesce(F.get(texts, 0)["text"], F.lit(""))


def llm_response_fields(responses: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Content, reasoning, finish reason and usage; missing text fields become ''."""
    choice = F.get(F.col("__r.choices"), 0)
    blank = F.lit("")
    return _parsed(responses, body).select(
        *keys,
        F.coalesce(choice["message"]["content"], blank).alias("content"),
        F.coalesce(choice["message"]["reasoning_content"], blank).alias("reasoning"),
        F.coalesce(choice["finish_reason"], blank).alias("finish_reason"),
        F.coalesce(F.col("__r.usage.prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.col("__r.usage.completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.col("__r.output_text"), _first_output_text(), blank).alias("output_text"),
    )


def response_citations(responses: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per link annotation of an output message."""
    def annotations(content: Column) -> Column:
        texts = F.filter(content, lambda c: c["type"] == "output_text")
        return F.flatten(F.transform(texts, lambda c: F.coalesce(c["annotations"], F.array())))

    messages = F.filter("__r.output", lambda o: o["type"] == "message")
    found = F.flatten(F.transform(messages, lambda m: annotations(F.coalesce(m["content"], F.array()))))
    links = F.filter(found, lambda a: a["type"] == "url_citation")
    exploded = _parsed(responses, body).select(*keys, F.posexplode_outer(links).alias("citation_no", "a"))
    return exploded.where("a IS NOT NULL").select(*keys, "citation_no", "a.url", "a.title", "a.start_index", "a.end_index")


def continue_rounds(responses: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Concatenate the rounds of a conversation up to the first that was not cut off, at most ``max_rounds``.

    Only the first rounds count, and ``row_number() <= n`` prunes each conversation before the shuffle.
    """
    fields = llm_response_fields(responses, ["conv_id", "turn"])
    order = Window.partitionBy("conv_id").orderBy("turn")
    first = fields.withColumn("round", F.row_number().over(order)).where(F.col("round") <= max_rounds)
    rounds = F.array_sort(F.collect_list(F.struct("round", "content", "finish_reason")))
    grouped = first.groupBy("conv_id").agg(rounds.alias("rounds"))
    last = F.array_position(F.transform("rounds", lambda r: r["finish_reason"] != CUT_OFF), True).cast("int")
    used = F.when(last == 0, F.col("rounds")).otherwise(F.slice("rounds", 1, F.greatest(last, F.lit(1))))
    return grouped.withColumn("rounds", used).select(
        "conv_id", F.size("rounds").alias("n_rounds"),
        F.array_join(F.transform("rounds", lambda r: r["content"]), "").alias("content"),
        (F.element_at("rounds", -1)["finish_reason"] != CUT_OFF).alias("finished"))


def winner(judge: Column) -> Column:
    """1 or 2 from a judge's answer: JSON, fenced JSON, else the first quoted winner, else 1."""
    trimmed = T.strip(F.coalesce(judge, F.lit("")))
    bare = F.when(trimmed.startswith("```"), T.strip(F.regexp_replace(trimmed, "(?m)^```(?:json)?\\s*|\\s*```$", ""))).otherwise(trimmed)
    data = F.try_parse_json(bare)
    value = F.try_variant_get(data, "$.winner", "int")
    quoted = F.regexp_extract(judge, "\"winner\"\\s*:\\s*([12])", 1)
    spelled = F.when(quoted == "2", 2).otherwise(1)
    # A JSON object without the field means 1; text that is no JSON falls back to the pattern.
    return F.when(data.isNull(), spelled).when(value.isNull() | (value == 1), 1).otherwise(2)


def pick_version(candidates: DataFrame) -> DataFrame:
    """The judged winner of two candidates; a lone candidate wins, none at all keeps the original."""
    one, two = ~T.is_blank(F.coalesce("v1", F.lit(""))), ~T.is_blank(F.coalesce("v2", F.lit("")))
    staged = candidates.withColumn("choice", F.when(~one & ~two, 0).when(~two, 1).when(~one, 2).otherwise(winner(F.col("judge"))))
    text = F.when(F.col("choice") == 0, F.col("original")).when(F.col("choice") == 1, F.col("v1")).otherwise(F.col("v2"))
    return staged.select("doc_id", "choice", text.alias("text"))
