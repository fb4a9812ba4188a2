"""Helpers that several operators share: tables, folds, shared folders, hashing in numpy, grouped batches."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_folder

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8: runs of anything but the space and the ASCII controls TAB to CR.

    Those are just the bytes at which ``bytes.split`` cuts; ``str.split`` would also cut at other white space.
    """
    return text.encode("utf-8", "surrogatepass").split()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors and don't repeat it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_WORD_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base modulo 2**64, and of its inverse; made once per Python worker."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_WORD_BASE, pow(_WORD_BASE, -1, 1 << 64))):
            powers, at, factor = np.ones(size, np.uint64), 1, np.uint64(base)
            with np.errstate(over="ignore"):
                while at < size:
                    powers[at : 2 * at] = powers[:at] * factor
                    at, factor = 2 * at, factor * factor
            _POWERS[k] = powers
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of several texts, and the number of the text it is in.

    ``data`` holds the UTF-8 bytes of the texts one after the other, ``ends`` where each ends.  A word's hash is a polynomial
    in its bytes, taken as a difference of prefix sums, so no word becomes a Python object.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    last = np.zeros(n, bool)  # the last byte of a word's text ends the word
    last[ends[ends > 0] - 1] = True
    after = ~inside | last
    starts = np.flatnonzero(inside & np.append(True, after[:-1]))
    stops = np.flatnonzero(inside & np.append(after[1:] & ~inside[1:], True) | inside & last) + 1
    powers, inverse = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        values = (sums[stops] - sums[starts]) * inverse[starts]
    return mix(values, 9), np.searchsorted(ends, starts, "right")


def texts_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a column in slices of about ``limit`` bytes: number of the first text, bytes, ends; null is empty.

    A longer text is a slice of its own.
    """
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, from the hashes of the words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[:count].copy()
        for k in range(1, n):
            total = total * np.uint64(0x100000001B3 * 2 + 1) + hashes[k : k + count]
            total ^= total >> np.uint64(29)
    return mix(total, n)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``: each group lies in one table, which may hold many groups.

    Only the last, perhaps unfinished, group of a batch is carried over.  Callers bound the size of a group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        last = len(arrays[0]) - 1
        same = np.ones(last + 1, bool)
        for a in arrays:
            same &= a == a[last]
        start = last + 1 - int(np.argmin(same[::-1])) if not same.all() else 0
        if start == 0 and held and all(
            held[-1].column(k)[held[-1].num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys
        ):
            held.append(batch)
            continue
        # The head of this batch may finish the held group; its last group may go on in the next batch.
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
        elif held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(*sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in sorted_keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def few(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size``, so that few of them are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, size):
            yield batch.slice(first, size)


def give_back() -> None:
    """Hand memory that this process has freed back to the system; Arrow's and the C library's allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, which gives memory back when its task ends.

    Python workers wait for the next task beside the JVM, on the memory of one executor; over a chain of operators each
    would stay as large as its largest task.
    """

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def filter_texts(docs: DataFrame, judge: Callable[[list[str | None]], list[bool]], size: int = 1024) -> DataFrame:
    """Rows of ``docs`` whose ``text`` the judge accepts, ``size`` at a time; rows stay where they are read and keep their columns."""
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, size):
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
