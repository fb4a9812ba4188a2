"""Removal of repeated passages by seed and extend.

A repeat is a run of ``WINDOW`` words that also starts in a document with a smaller id.  Documents are joined on winnowed
anchors: of the ``ANCHOR``-word grams inside a window the one with the smallest hash is its anchor, so equal windows have
equal anchors, and one gram in five is an anchor.  Anchors that occur in two documents are seeds.  Around every
seed the match is extended to both sides over all windows that the seed is the anchor of; a window is named by a hash
of 128 bits, and the smallest id under a name decides.  Runs of repeated windows are the maximal repeats.

Nothing is paired: a passage that a thousand documents share costs a row per document and task, not per pair, and what is
equal within one batch of a task is settled there, so a common passage sends one row per batch to its key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounds, few, groups, lean, mix, rows, stored, texts_of, word_hashes, words_of
from quire.llm.winnow import rolling, window_minima

WINDOW = 13
ANCHOR = 5
FEW_TEXTS = 1024
_SECOND_BASE = 0x9FB21C651E98DF25

_ANCHORS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("settled", pa.bool_())])
_SEEDS = pa.schema([("doc", pa.int64()), ("anchor", pa.int64())])
_WINDOWS = pa.schema([("first", pa.int64()), ("second", pa.int64()), ("doc", pa.int64()), ("settled", pa.bool_())])
_REPEATS = pa.schema([("doc", pa.int64()), ("first", pa.int64())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def anchors_of(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for every window the place of its anchor."""
    grams = rolling(hashes, anchor)
    return grams, window_minima(grams, window - anchor + 1) if len(hashes) >= window else np.empty(0, np.int64)


def whole_windows(owner: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that lie within one text; ``owner`` is the text of every word."""
    return np.flatnonzero(owner[: len(owner) - window + 1] == owner[window - 1 :]) if len(owner) >= window else np.empty(0, np.int64)


def named(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One number for a value in a text; the value is a 64-bit hash already."""
    return values.view(np.uint64) ^ mix(owner.astype(np.uint64), 21)


def list_values(column: pa.Array, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists of some rows in a row, and the row (from 0) that each belongs to; null is empty."""
    part = column.slice(first, count)
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return part.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(count), sizes)


def _anchor_rows(window: int, anchor: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, docs = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for first, data, ends in texts_of(batch.column(1)):
                hashes, owner = word_hashes(data, ends)
                grams, place = anchors_of(hashes, window, anchor)
                at = whole_windows(owner, window)
                place, own = place[at], owner[at]
                change = np.append(True, (place[1:] != place[:-1]) | (own[1:] != own[:-1]))[: len(place)]
                found.append(grams[place[change]])
                docs.append(ids[first + own[change]])
            if not found or not sum(map(len, found)):
                continue
            value, doc = np.concatenate(found).view(np.int64), np.concatenate(docs)
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            fresh = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))  # a document counts once
            value, doc = value[fresh], doc[fresh]
            starts = bounds(value)
            count = np.diff(starts)
            # An anchor of several documents of this batch is a seed for all; one of them tells the other batches.
            settled = np.repeat(count > 1, count)
            yield rows(_ANCHORS, anchor=np.append(value, value[starts[:-1]][count > 1]), doc=np.append(doc, doc[starts[:-1]][count > 1]),
                       settled=np.append(settled, np.zeros((count > 1).sum(), bool)))

    return run


@lean
def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in groups(batches, ["anchor"]):
        value, doc, settled = (part.column(k).to_numpy() for k in range(3))
        starts = bounds(value)[:-1]
        low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
        shared = np.repeat(low < high, np.diff(np.append(starts, len(value)))) | settled
        yield rows(_SEEDS, doc=doc[shared], anchor=value[shared])


def _window_names(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return rolling(hashes, window).view(np.int64), rolling(mix(hashes, 77), window, _SECOND_BASE).view(np.int64)


def _window_rows(window: int, anchor: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable = pc.and_(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(2))), pc.invert(batch.column(3)))
            batch = batch.filter(usable)
            if not batch.num_rows:
                continue
            ids, firsts, seconds, docs = batch.column(0).to_numpy(zero_copy_only=False), [], [], []
            for start, data, ends in texts_of(batch.column(1)):
                hashes, owner = word_hashes(data, ends)
                grams, place = anchors_of(hashes, window, anchor)
                at = whole_windows(owner, window)
                seeds, rows_of = list_values(batch.column(2), start, len(ends))
                at = at[np.isin(named(grams[place[at]], owner[at]), named(seeds, rows_of))]
                first, second = _window_names(hashes, window)
                firsts.append(first[at])
                seconds.append(second[at])
                docs.append(ids[start + owner[at]])
            first, second, doc = (np.concatenate(x) for x in (firsts, seconds, docs))
            if not len(doc):
                continue
            order = np.lexsort((doc, second, first))
            first, second, doc = first[order], second[order], doc[order]
            fresh = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (doc[1:] != doc[:-1]))
            first, second, doc = first[fresh], second[fresh], doc[fresh]
            # All but the smallest id of this batch repeat it, whatever other batches hold.
            head = np.zeros(len(doc), bool)
            head[bounds(first, second)[:-1]] = True
            yield rows(_WINDOWS, first=first, second=second, doc=doc, settled=~head)

    return run


@lean
def _repeat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in groups(batches, ["first", "second"]):
        first, second, doc, settled = (part.column(k).to_numpy() for k in range(4))
        starts = bounds(first, second)[:-1]
        low = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
        repeat = settled | (doc > low)
        yield rows(_REPEATS, doc=doc[repeat], first=first[repeat])


def covered(hashes: np.ndarray, owner: np.ndarray, repeats: np.ndarray, repeat_owner: np.ndarray, window: int) -> np.ndarray:
    """Words inside the maximal runs of repeated windows."""
    at = whole_windows(owner, window)
    at = at[np.isin(named(rolling(hashes, window)[at], owner[at]), named(repeats, repeat_owner))]
    steps = np.zeros(len(hashes) + 1, np.int64)
    steps[at] += 1
    steps[at + window] -= 1  # starts are distinct, and so are ends
    return np.cumsum(steps[:-1]) > 0


def _kept_rows(window: int, carried: Sequence[int]):
    """``carried`` are the places of the columns that follow; few texts at a time are Python objects and leave as one batch."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, FEW_TEXTS):
            ids, texts, copies, repeats = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)
            gone: dict[int, np.ndarray] = {}
            marked = pc.is_valid(repeats)
            if pc.any(marked).as_py():
                numbers = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
                some, lists = texts.filter(marked), repeats.filter(marked)
                for start, data, ends in texts_of(some):
                    hashes, owner = word_hashes(data, ends)
                    hit = covered(hashes, owner, *list_values(lists, start, len(ends)), window)
                    limits = np.searchsorted(owner, np.arange(len(ends) + 1))
                    for k in range(len(ends)):
                        gone[int(numbers[start + k])] = hit[limits[k] : limits[k + 1]]
            out: dict[str, list] = {f.name: [] for f in _KEPT}
            for k, (doc, text, copy) in enumerate(zip(ids, texts, copies)):
                own = words_of(text.as_py()) if text.is_valid else []
                kept = own
                if len(own) >= window and copy:
                    kept = []  # every window starts in the first copy
                elif k in gone:
                    kept = list(itertools.compress(own, (~gone[k]).tolist()))
                for name, value in zip(out, (doc, len(own), len(own) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"))):
                    out[name].append(value)
            made = rows(_KEPT, **out)
            fields = [pa.field(f"carried_{k}", batch.column(at).type) for k, at in enumerate(carried)]
            yield pa.RecordBatch.from_arrays([*made.columns, *[batch.column(at) for at in carried]], schema=pa.schema([*_KEPT, *fields]))

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row: the words left, joined by single spaces.

    Removed is each word covered by a window of ``window`` words whose sequence also starts in a document with a smaller
    ``doc_id``; windows are judged on the input.  Words are runs of anything but spaces and ASCII controls, unchanged; a null
    text has none.  Rows that share a ``doc_id`` never remove from one another; a null ``doc_id`` neither removes nor loses
    words.  Other columns are ignored but for those in ``carry``, which follow the others; an empty table gives no rows.  The digests of the texts are written
    first; all else is one plan, in which the text is shuffled once by ``doc_id`` and that shuffle serves both passes over it.
    """
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The text itself is carried as it is there already.
    extra = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry) if c != "text"]
    # New names: Spark drops a name for itself in one pass alone, and then shuffles the text twice.
    texts = docs.select(F.col("doc_id").cast("long").alias("number"), F.col("text").alias("body"), *extra)
    usable = texts.where("number IS NOT NULL AND body IS NOT NULL").select("number", "body")
    anchors = usable.mapInArrow(_anchor_rows(window, anchor), "anchor long, doc long, settled boolean")
    # Settled rows only travel to their document; they are dealt apart from their anchor.
    anchors = anchors.repartition(F.when(F.col("settled"), F.xxhash64("anchor", "doc")).otherwise(F.col("anchor"))).sortWithinPartitions("anchor")
    seeds = anchors.mapInArrow(_seed_rows, "doc long, anchor long").groupBy(F.col("doc").alias("number")).agg(F.collect_set("anchor").alias("seeds"))
    # Later copies of a whole text: all their windows start in the first copy, so they need no windows of their own.
    named = stored(usable.select("number", F.md5(F.col("body").cast("binary")).alias("digest")), "digests")
    firsts = named.groupBy("digest").agg(F.min("number").alias("first"), F.max("number").alias("last")).where("first < last")
    copies = named.join(firsts.select("digest", "first"), "digest").where("number > first").groupBy("number").agg(F.collect_set("digest").alias("copies"))
    # Left joins on both passes, which both take all columns: the two shuffles of the text are the same and Spark makes one.
    # Rows without an id stay where they are read, as they would all meet in one task.
    dealt = texts.where("number IS NOT NULL").repartition(count, "number")
    alone = texts.where("number IS NULL")
    carried = [f"carried_{k}" for k, c in enumerate(carry) if c != "text"]
    places = [1 if c == "text" else 4 + carried.index(f"carried_{k}") for k, c in enumerate(carry)]
    copy = F.coalesce(F.array_contains("copies", F.md5(F.col("body").cast("binary"))), F.lit(False)).alias("copy")
    grown = dealt.join(seeds, "number", "left").join(copies, "number", "left").select("number", "body", "seeds", copy, *carried)
    windows = grown.mapInArrow(_window_rows(window, anchor), "first long, second long, doc long, settled boolean")
    windows = windows.repartition(F.when(F.col("settled"), F.xxhash64("first", "second", "doc")).otherwise(F.col("first"))).sortWithinPartitions("first", "second")
    repeats = windows.mapInArrow(_repeat_rows, "doc long, first long").groupBy(F.col("doc").alias("number")).agg(F.collect_set("first").alias("repeats"))
    judged = dealt.join(repeats, "number", "left").join(copies, "number", "left").select("number", "body", copy, "repeats", *carried)
    judged = judged.unionByName(alone.withColumns({"copy": F.lit(False), "repeats": F.lit(None).cast("array<long>")}))
    judged = judged.select("number", "body", "copy", "repeats", *carried)
    types = "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    kept = judged.mapInArrow(_kept_rows(window, places), f"doc_id long, n_words long, n_removed long, kept string{types}")
    return kept.toDF("doc_id", "n_words", "n_removed", "kept", *carry)


def digested(kept: DataFrame) -> DataFrame:
    """The rows of ``drop_repeats`` with the sha256 of the text that is left instead of the text."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
