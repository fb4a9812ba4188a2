"""The result cache as a table of (cache_key, stored_at, size_bytes, seq).  Ages are measured against an explicit time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: lifetime of an entry.
TTL_SECONDS = 604_800


def cache_key(text: Column, pages: Column, translate: Column) -> Column:
    """Content hash, sorted pages, translation mark."""
    numbers = F.array_sort(F.transform(F.split(pages, ","), lambda p: F.trim(p).try_cast("int")))
    listed = F.concat(F.lit("_p"), F.array_join(F.transform(numbers, lambda n: n.cast("string")), "-"))
    return F.concat(F.md5(text.cast("binary")), F.when(F.coalesce(pages, F.lit("")) == "", "").otherwise(listed), F.when(translate, "_tr").otherwise(""))


def cache_keys(requests: DataFrame) -> DataFrame:
    return requests.select("doc_id", cache_key(F.col("text"), F.col("pages"), F.col("translate")).alias("cache_key"))


def expired(as_of: str, ttl_seconds: int) -> Column:
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("stored_at").cast("timestamp"))
    return age > ttl_seconds * 1_000_000


def cache_put(writes: DataFrame) -> DataFrame:
    """The last write of each key."""
    last = writes.groupBy("cache_key").agg(F.max_by(F.struct("stored_at", "size_bytes", "seq"), "seq").alias("w"))
    return last.select("cache_key", "w.*")


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """hit, expired or miss for each request.  Copies of one document share a key; the skewed join is split at run time."""
    found = cache_keys(requests).join(cache_put(cache).select("cache_key", "stored_at"), "cache_key", "left")
    outcome = F.when(F.col("stored_at").isNull(), "miss").when(expired(as_of, ttl_seconds), "expired").otherwise("hit")
    return found.select("doc_id", "cache_key", outcome.alias("outcome"))


def cache_purge(cache: DataFrame, as_of: str, files: DataFrame | None = None, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Entries left after dropping expired ones; clearing a file drops only its plain key (no pages, no translation)."""
    kept = cache_put(cache).where(~expired(as_of, ttl_seconds))
    if files is None:
        return kept
    plain = files.select(F.md5(F.col("text").cast("binary")).alias("cache_key")).distinct()
    return kept.join(plain, "cache_key", "left_anti")


def cache_info(cache: DataFrame, as_of: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    return cache_put(cache).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
                                F.count_if(expired(as_of, ttl_seconds)).alias("expired"))
