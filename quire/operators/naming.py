"""Uploads and output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.blocks import BLOCK_WIDTH, number_rows, with_running

# Accepted types, size and batch limits, dangerous characters, name length, defaults.
ALLOWED_EXTENSIONS = ["pdf"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_BATCH_FILES = 5
DANGEROUS = "/\\:*?\"<>|\0\n\r\t"
MAX_NAME_CHARS = 200
DEFAULT_NAME = "unnamed"
DEFAULT_STEM = "output"


def _default(value: Column, default: str) -> Column:
    """Replace the empty string, mentioning the value once so that generated code stays small."""
    return F.regexp_replace(value, "\\A\\z", default)


def safe_filename(filename: Column) -> Column:
    """Replace dangerous characters, trim dots and spaces, cap the name; other scripts stay."""
    filename = F.coalesce(filename, F.lit(""))

    def clean(part: Column) -> Column:
        return F.btrim(F.translate(part, DANGEROUS, "_" * len(DANGEROUS)), F.lit(". "))

    name = _default(clean(F.regexp_replace(filename, "\\.[^.]*\\z", "")), DEFAULT_NAME)
    extension = clean(F.regexp_extract(filename, "\\.([^.]*)\\z", 1))
    dotted = F.regexp_replace(F.concat(F.lit("."), extension), "\\A\\.\\z", "")
    return F.concat(F.left(name, F.lit(MAX_NAME_CHARS)), dotted)


def admit_uploads(uploads: DataFrame) -> DataFrame:
    """Each upload with the reason it is turned away, NULL when admitted."""
    name, size = F.col("filename"), F.col("size_bytes")
    allowed = name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(ALLOWED_EXTENSIONS)
    reason = F.when(~allowed, "extension").when(size > MAX_UPLOAD_BYTES, "size").otherwise("")
    return uploads.select("upload_id", "filename", "size_bytes", (reason == "").alias("admitted"), reason.alias("reason"))


def duplicate_names_in_batch(uploads: DataFrame, max_files: int = MAX_BATCH_FILES) -> DataFrame:
    """Batches to reject: too many files, or one sanitised lower-case name twice.

    Names are counted per (batch, name) first, so no task sees a whole batch of names.
    """
    names = uploads.select("batch_id", F.lower(safe_filename(F.col("filename"))).alias("name"))
    per_name = names.groupBy("batch_id", "name").agg(F.count(F.lit(1)).alias("copies"))
    batches = per_name.groupBy("batch_id").agg(
        F.sum("copies").alias("files"), F.count_if(F.col("copies") > 1).alias("repeated_names"))
    reason = F.when(F.col("files") > max_files, "too_many_files").when(F.col("repeated_names") > 0, "duplicate_name")
    return batches.withColumn("reason", reason).where("reason IS NOT NULL")


def unique_output_names(
    sources: DataFrame,
    existing: DataFrame | None = None,
    order: str = "upload_id",
    translated: str = "translate",
    index: str | None = None,
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Assign ``stem[_i][_cn].tex``; a name already used gets the next free ``_2``, ``_3``, ...

    ``existing`` holds the ``name`` column of files already there.  A requested name that itself looks numbered
    (``a_2``) keeps its number for its own sources.  The r-th source of a base takes the r-th free number: with
    the taken numbers sorted as t1 < t2 < ..., that is r plus the count of t_j with t_j - j < r.  Both rankings
    run in blocks, so a base name shared by a third of all sources is no hot task.
    """
    safe = safe_filename(F.col("filename"))
    stem = _default(T.strip(F.regexp_replace(safe, "(?s)(?<=.)\\.[^.]*\\z", "")), DEFAULT_STEM)
    suffix = F.when(F.col(translated), "_cn").otherwise("")
    numbered = F.concat(F.lit("_"), (F.col(index) + 1).cast("string")) if index else F.lit("")
    based = sources.withColumn("base", F.concat(stem, numbered, suffix))
    ranked = number_rows(based, ["base"], order, "__rank", width)

    bases = based.select("base").distinct()
    pattern = "(?s)\\A(.*)_([2-9]|[1-9][0-9]+)\\z"
    split = [F.regexp_extract("name", pattern, 1).alias("base"), F.regexp_extract("name", pattern, 2).try_cast("bigint").alias("taken")]
    names = bases.withColumnRenamed("base", "name")
    taken = names.select(*split)
    if existing is not None:
        files = existing.where(F.col("name").endswith(".tex")).select(F.expr("left(name, length(name) - 4)").alias("name"))
        taken = taken.unionByName(files.select(*split)).unionByName(
            files.select(F.col("name").alias("base"), F.lit(1).cast("bigint").alias("taken")))
    taken = taken.where("taken IS NOT NULL").distinct().join(bases, "base", "left_semi")
    gaps = number_rows(taken, ["base"], "taken", "__j", width, counted=True)
    # Sort key 2k for taken numbers whose gap is below k, 2r + 1 for the r-th source: unique, so blocks stay small.
    marks = gaps.groupBy("base", ((F.col("taken") - F.col("__j") + 1) * 2).alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    wanted = ranked.select("base", (F.col("__rank") * 2 + 1).alias("__at"), F.lit(0).cast("bigint").alias("__n"), F.col(order), "__rank")
    merged = wanted.unionByName(marks, allowMissingColumns=True)
    summed = with_running(merged, ["base"], "__at", {"__shift": (F.col("__n"), F.sum)}, width, counted=True).where("__rank IS NOT NULL")
    number = F.col("__rank") + F.col("__shift")
    name = F.concat("base", F.when(number > 1, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), F.lit(".tex"))
    return summed.select(order, "base", name.alias("output_name"))
