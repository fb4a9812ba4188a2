"""Conversion history and the preferences learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.blocks import BLOCK_WIDTH, with_blocks
from quire.session import cut_lineage

# Records kept, ranges remembered, uses that make a preference, accepted settings, prompt header.
MAX_RECORDS = 20
MAX_RANGES = 5
MIN_USES = 2
SETTINGS = ["default_translate", "quality_mode", "terminology", "template_usage", "model_usage"]
QUALITY_MODES = ["standard", "high"]
TERMINOLOGY_HEADER = "用户偏好术语翻译（请优先使用以下翻译）："


def _newest(history: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` newest records: a top-k, not a sort of the history."""
    return history.orderBy(F.desc("seq")).limit(keep)


def history_retain(history: DataFrame, keep: int = MAX_RECORDS) -> DataFrame:
    """Every record with ``kept``; the files of the others can go.  The kept keys are at most ``keep`` rows."""
    kept = F.broadcast(_newest(history, keep).select("seq", F.lit(True).alias("kept")))
    marked = history.join(kept, "seq", "left")
    return marked.select("seq", "filename", "output_file", F.coalesce("kept", F.lit(False)).alias("kept"))


def history_page(history: DataFrame, limit: int = 10, offset: int = 0, keep: int = MAX_RECORDS) -> DataFrame:
    """One page of the retained records, newest first, with the total.  Ranks run over at most ``keep`` rows."""
    ranked = _newest(history, keep).withColumns({
        "position": F.row_number().over(Window.orderBy(F.desc("seq"))) - 1, "total": F.count(F.lit(1)).over(Window.partitionBy())})
    start = max(0, offset)
    return ranked.where((F.col("position") >= start) & (F.col("position") < start + limit))


def _choices(history: DataFrame) -> DataFrame:
    template = F.coalesce(*[F.col(c) for c in ("template_name", "template") if c in history.columns])
    pairs = F.array(F.struct(F.lit("model").alias("kind"), F.col("model").alias("name")), F.struct(F.lit("template").alias("kind"), template.alias("name")))
    used = history.select("seq", F.explode(pairs).alias("c")).select("seq", "c.kind", "c.name").where("name <> ''")
    return used.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("uses"), F.min("seq").alias("first_seen"))


def preference_usage(history: DataFrame) -> DataFrame:
    """Uses of each model and template."""
    return _choices(history).select("kind", "name", "uses")


def preferred_choice(history: DataFrame) -> DataFrame:
    """The most used model and template, once used twice; a tie goes to the one seen first."""
    best = _choices(history).groupBy("kind").agg(F.max_by(F.struct("name", "uses"), F.struct(F.col("uses"), -F.col("first_seen"))).alias("best"))
    return best.select("kind", "best.*").where(F.col("uses") >= MIN_USES)


def preference_flags(history: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Translation default, last quality mode, and the list of page ranges, oldest first."""
    flags = history.agg(
        F.coalesce(F.bool_or("translated"), F.lit(False)).alias("default_translate"),
        F.coalesce(F.max_by("quality_mode", F.when(F.coalesce("quality_mode", F.lit("")) != "", F.col("seq"))), F.lit("standard")).alias("quality_mode"))
    return flags.withColumn("page_ranges", F.lit(";".join(common_page_ranges(history, width=width))))


def common_page_ranges(history: DataFrame, keep: int = MAX_RANGES, width: int = BLOCK_WIDTH) -> list[str]:
    """The list that a settings file holds after the whole history, oldest first: a range not on it is appended, and the
    oldest one is pushed out when there are more than ``keep``.  A range that was pushed out comes back when it is used again.

    What a stretch of the history does to the list depends on the list before it.  The history is cut into blocks, each
    replayed in one task from a guess, the empty list at first; then every block whose guess was wrong is replayed from the end of the block
    before it, until all agree.  A block forgets its start after ``keep`` new ranges, so a second round mostly settles all;
    a block whose ranges are all on the list leaves it as it is, and needs no replay.  Each round settles one block at least.
    The driver holds a list of ``keep`` ranges per block and round, of at most ``MOST_BLOCKS`` blocks or so.
    Empty ranges and ``all`` do not count; records without a ``seq`` come first.
    """
    used = history.where("pages <> '' AND pages <> 'all'").select("seq", "pages")
    in_order = F.array_sort(F.collect_list(F.struct("seq", "__tie", "pages")))
    replays = with_blocks(used, [], "seq", width).groupBy("__block").agg(F.transform(in_order, lambda r: r["pages"]).alias("pages"))
    stretches = cut_lineage(replays.select("__block", F.filter("pages", lambda p, i: (i == 0) | (F.get("pages", i - 1) != p)).alias("pages")))
    few = F.array_distinct("pages")
    first = stretches.select("__block", F.when(F.size(few) <= keep, few).alias("few"), _replayed(F.array().cast("array<string>"), keep).alias("end"))
    known = {r["__block"]: r for r in first.collect()}
    order = sorted(known)
    ends = {(b, ()): tuple(known[b]["end"]) for b in order}
    guess = {b: ends[b, ()] for b in order}
    while True:
        state, missing = (), []
        for b in order:
            if known[b]["few"] is not None and set(known[b]["few"]) <= set(state):
                continue
            if (b, state) not in ends:
                missing.append((b, list(state)))
            state = ends.get((b, state), guess[b])
        if not missing:
            return list(state)
        starts = history.sparkSession.createDataFrame(missing, "__block bigint, start array<string>")
        for r in stretches.join(F.broadcast(starts), "__block").select("__block", "start", _replayed(F.col("start"), keep).alias("end")).collect():
            guess[r["__block"]] = ends[r["__block"], tuple(r["start"])] = tuple(r["end"])


def _replayed(start: Column, keep: int) -> Column:
    """The list after the ranges of a stretch."""

    def use(state: Column, p: Column) -> Column:
        room = F.slice(state, F.greatest(F.size(state) - keep + 2, F.lit(1)), keep - 1)
        return F.when(F.array_contains(state, p), state).otherwise(F.array_append(room, p))

    return F.aggregate("pages", start, use)


def terminology_latest(events: DataFrame) -> DataFrame:
    """The current translation of each term: last write wins, blanks are ignored, deletions remove."""
    cleaned = events.select("seq", F.lower(T.strip("source")).alias("source"), T.strip("target").alias("target"), "deleted")
    valid = cleaned.where((F.col("source") != "") & (F.col("deleted") | (F.col("target") != "")))
    last = valid.groupBy("source").agg(F.max_by(F.struct("target", "deleted"), "seq").alias("last"))
    return last.where(~F.col("last.deleted")).select("source", F.col("last.target").alias("target"))


def terminology_prompt(events: DataFrame) -> DataFrame:
    """Prompt lines: a header, then one line per term; sorting by ``source`` gives the prompt in order."""
    terms = terminology_latest(events)
    lines = terms.select("source", F.concat(F.lit("  "), "source", F.lit(" -> "), "target").alias("line"))
    header = terms.groupBy(F.lit("").alias("source")).agg(F.lit(TERMINOLOGY_HEADER).alias("line"))
    return header.unionByName(lines)


def preference_updates(updates: DataFrame) -> DataFrame:
    """The last accepted value of each known setting; other settings and invalid modes are turned down."""
    known = F.col("pref_key").isin(SETTINGS)
    valid = (F.col("pref_key") != "quality_mode") | F.col("pref_value").isin(QUALITY_MODES)
    accepted = updates.where(known & valid)
    return accepted.groupBy("pref_key").agg(F.max_by("pref_value", "seq").alias("pref_value"), F.count(F.lit(1)).alias("accepted"))


def new_cjk_terms(corrections: DataFrame) -> DataFrame:
    """Runs of Chinese characters in the corrected text that the original lacks."""
    def runs(name: str):
        return F.regexp_extract_all(name, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0))

    terms = F.array_sort(F.array_except(runs("corrected"), runs("original")))
    return corrections.select("doc_id", F.array_join(terms, ",").alias("terms"))


def orphan_files(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files that no history record mentions."""
    columns = [c for c in ("output_file", "upload_file") if c in history.columns]
    named = history.select(F.explode(F.array(*columns)).alias("path"))
    tracked = named.select(F.regexp_extract("path", "([^/\\\\]*)\\z", 1).alias("name")).distinct()
    return files.join(tracked, "name", "left_anti")
