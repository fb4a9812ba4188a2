"""Best-fit packing of token sequences by large-item matching, planned on a histogram of lengths.

A piece is 1 to ``capacity`` tokens long, so the whole corpus is described by ``capacity`` counts.  The plan is made on
them: it says how many sequences hold which lengths, never which document.  Pieces then take the places of their length
by rank.  The plan has at most a few entries per pair of length and gap, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lean, rows, stored
from quire.llm.pieces import SLICE, encoder

_PIECE = pa.schema([("part", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()),
                    ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
_PIECES = "part int, rank long, doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, remember: bool = True) -> DataFrame:
    """One row per piece; ``rank`` counts the pieces of one length within the task ``part``.

    A document is its ids and the end id.  Longer ones than ``capacity`` are cut so that every piece but the first is
    full.  Null and empty texts hold the end id alone; a null ``doc_id`` stays null and is packed like any other.
    """

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = encoder(tokenizer, True, remember), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, ids, lengths in codec.batches(batch.column(1), end_id, SLICE if remember else SLICE // 4):
                out: dict[str, list] = {f.name: [] for f in _PIECE}
                data, at = memoryview(ids.tobytes()), 0
                for doc, total in zip(batch.column(0).slice(first, len(lengths)).to_pylist(), lengths.tolist()):
                    start, piece, size = 0, 0, total % capacity or capacity
                    while start < total:
                        values = (part, int(seen[size]), doc, piece, start, size, zlib.crc32(data[4 * (at + start) : 4 * (at + start + size)]))
                        for name, value in zip(out, values):
                            out[name].append(value)
                        seen[size] += 1
                        start, piece, size = start + size, piece + 1, capacity
                    at += total
                yield rows(_PIECE, **out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


class Bins:
    """Sequences by the room left in them: runs of consecutive sequence ids that hold the same lengths."""

    def __init__(self, capacity: int):
        self.capacity, self.next_id = capacity, 0
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first id, count)
        self.plan: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first id, offset
        self.ranks: dict[int, int] = defaultdict(int)

    def open(self, length: int, count: int) -> None:
        self._place(length, self.next_id, count, 0)
        self.next_id += count

    def _place(self, length: int, first: int, count: int, offset: int) -> None:
        self.plan.append((length, self.ranks[length], count, first, offset))
        self.ranks[length] += count
        self.runs[self.capacity - offset - length].append((first, count))

    def fill(self, length: int, count: int, room: int) -> int:
        """Put up to ``count`` pieces into sequences with exactly this room; how many found a place."""
        done, runs = 0, self.runs[room]
        while runs and done < count:
            first, size = runs.pop()
            used = min(size, count - done)
            if used < size:
                runs.append((first + used, size - used))
            self._place(length, first, used, self.capacity - room)
            done += used
        return done


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length: rows of length, first rank, count, first sequence, offset.

    Pieces above a third of the capacity fit at most twice into one sequence.  They are matched greedily: the longest open
    one with the longest that still fits beside it.  The smaller ones follow in descending order, each into the fullest
    sequence with room for it, or a new one.
    """
    left, bins, third = [int(x) for x in counts], Bins(capacity), capacity // 3
    for length in range(capacity, third, -1):
        mate = min(length, capacity - length)
        while left[length]:
            while mate > third and not left[mate]:
                mate -= 1
            if mate <= third:
                bins.open(length, left[length])
                left[length] = 0
            else:
                pairs = left[length] // 2 if mate == length else min(left[length], left[mate])
                if not pairs:  # one of its own kind is left: the next shorter one goes with it
                    mate -= 1
                    continue
                first = bins.next_id
                bins.open(length, pairs)
                room = bins.runs[capacity - length]
                room.remove((first, pairs))
                bins._place(mate, first, pairs, length)
                left[length] -= pairs
                left[mate] -= pairs
    for length in range(third, 0, -1):
        while left[length]:
            room = next((r for r in range(length, capacity + 1) if bins.runs.get(r)), None)
            if room is None:
                # New sequences start with as many pieces of this length as fit.
                each = capacity // length
                full, rest = divmod(left[length], each)
                for k in range(each if full else 0):
                    if k == 0:
                        first = bins.next_id
                        bins.open(length, full)
                    else:
                        bins.runs[capacity - k * length].remove((first, full))
                        bins._place(length, first, full, k * length)
                for k in range(rest):
                    if k == 0:
                        first = bins.next_id
                        bins.open(length, 1)
                    else:
                        bins.runs[capacity - k * length].remove((first, 1))
                        bins._place(length, first, 1, k * length)
                left[length] = 0
            else:
                left[length] -= bins.fill(length, left[length], room)
    return bins.plan


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, remember: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, one row per piece.

    Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  Rows that share a ``doc_id`` are packed as
    separate documents.  An empty table gives no rows; other columns are ignored.  The pieces (no text, no ids) are
    written once to the shared folder, so their ranks stay as they are when a task is run again.  ``remember`` keeps the words
    of a task in the Python worker for its next task.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer, end_id, capacity, remember), "pieces")
    sizes = pieces.groupBy("length", "part").agg(F.max("rank").alias("last"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum(F.col("last") + 1)).collect():  # at most ``capacity`` rows
        counts[length] = n
    places = plan(counts, capacity)
    lookup: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length in {p[0] for p in places}:
        own = np.array([p[1:] for p in places if p[0] == length], np.int64)  # ranks ascend as they were given out
        lookup[length] = own[:, 0], own[:, 2], own[:, 3]
    known = spark.sparkContext.broadcast(lookup)  # bounded by the capacity, not by the data
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "part", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            lengths, ranks = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.append(True, lengths[order][1:] != lengths[order][:-1])) if len(order) else []
            for a, b in zip(edges, [*edges[1:], len(order)]):
                at = order[a:b]
                firsts, ids, offsets = table[int(lengths[at[0]])]
                k = np.searchsorted(firsts, ranks[at], "right") - 1
                sequence[at], offset[at] = ids[k] + ranks[at] - firsts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths), batch.column(4), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
