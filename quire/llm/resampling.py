"""Importance resampling towards a target distribution of hashed n-grams.

Every run of one to three words falls into one of 10,000 buckets by its CRC-32.  How much more often a bucket occurs in the
target texts than in the corpus says what one of its features is worth; a document's weight is the sum over its features,
and the documents to draw are those whose weight with Gumbel noise is highest, which is sampling without replacement in
proportion to the importance.

CRCs are taken of the distinct features of a slice of texts at a time.  Features of equal length lie in one two-dimensional
array of bytes, one row each; all CRCs of the array are updated column by column, and the buckets go back to the places
where the features occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import rows, stored, texts_of

BUCKETS = 10_000
LONGEST = 3
# Bytes of text whose features are made distinct together.
SLICE = 1 << 22
WORDS = 1 << 20


def _letters() -> np.ndarray:
    """What each byte becomes: digits, small letters and all bytes from 128 on stay, capitals become small, the rest separates words."""
    table = np.full(256, 32, np.uint8)
    for a, b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[a:b] = np.arange(a, b)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def _crc_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> np.uint32(1)) ^ (steps & np.uint32(1)) * np.uint32(0xEDB88320)
    return steps


_LETTERS, _STEPS = _letters(), _crc_steps()


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional array of bytes, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _STEPS[(crc.astype(np.uint8)) ^ column] ^ (crc >> np.uint32(8))
    return ~crc


def crc32_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of ``lengths[i]`` bytes of ``data`` from ``starts[i]`` on, bucketed by length.

    A bucket with fewer rows than columns is not worth the columns: its rows are taken one by one, with the same values.
    """
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    for size, at in zip(sizes.tolist(), np.split(order, first[1:])):
        if len(at) >= size:
            # A bounded number of rows at a time: the array holds each byte twice.
            for part in np.array_split(at, max(1, len(at) * size >> 24)):
                out[part] = crc32_rows(np.lib.stride_tricks.sliding_window_view(data, size)[starts[part]])
        else:
            view = memoryview(data)
            out[at] = [zlib.crc32(view[s : s + size]) for s in starts[at].tolist()]
    return out


def text_buckets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts laid end to end: the bucket of every feature, the number of its text, and the number of words of each text."""
    plain = _LETTERS[data]
    inside = plain != 32
    after = ~inside
    after[ends[ends > 0] - 1] = True  # a word ends with its text
    starts = np.flatnonzero(inside & np.append(True, after[:-1]))
    stops = np.flatnonzero(inside & (after | np.append(~inside[1:], True))) + 1
    text = np.searchsorted(ends, starts, "right")
    n_words = np.bincount(text, minlength=len(ends))
    if not len(starts):
        return np.empty(0, np.uint16), np.empty(0, np.int64), n_words
    # A long text goes by so many words at a time; the last runs of a part reach into the next one.
    parts = [_part_buckets(plain, starts[k : k + WORDS + LONGEST - 1], stops[k : k + WORDS + LONGEST - 1], text[k : k + WORDS + LONGEST - 1], WORDS) for k in range(0, len(starts), WORDS)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([t for _, t in parts]), n_words


def _part_buckets(plain: np.ndarray, starts: np.ndarray, stops: np.ndarray, text: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and texts of the features that begin at one of the first ``own`` words."""
    # The words once more, one space apart: a run of words is then a slice of bytes.
    sizes = stops - starts
    joined_at = np.append(0, np.cumsum(sizes + 1))
    joined = np.full(joined_at[-1], 32, np.uint8)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[np.repeat(joined_at[:-1], sizes) + inner] = plain[np.repeat(starts, sizes) + inner]
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(joined_at.astype(np.int64)), pa.py_buffer(joined)])
    word = pc.dictionary_encode(names).indices.to_numpy().astype(np.int64)  # words with the space after them
    vocabulary, code, buckets, texts = int(word.max()) + 1, word, [], []
    for n in range(1, LONGEST + 1):
        count = len(word) - n + 1
        if count <= 0:
            break
        # Runs are named by the words' numbers, so distinct names are distinct features, exactly: at most WORDS + 2 numbers,
        # so three of them fit into 63 bits.
        if n > 1:
            code = code[:count] * vocabulary + word[n - 1 :]
        here = np.flatnonzero(text[:count] == text[n - 1 :])  # runs do not cross texts
        here = here[: np.searchsorted(here, own)]
        _, one, back = np.unique(code[here], return_index=True, return_inverse=True)
        from_word = here[one]
        crc = crc32_slices(joined, joined_at[from_word], joined_at[from_word + n] - 1 - joined_at[from_word])
        buckets.append((crc % np.uint32(BUCKETS)).astype(np.uint16)[back])
        texts.append(text[here])
    return np.concatenate(buckets), np.concatenate(texts)


_COUNT = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all ``docs.text`` fall into each bucket: a task sends at most one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, ends in texts_of(batch.column(0), SLICE):
                total += np.bincount(text_buckets(data, ends)[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield rows(_COUNT, bucket=seen, n=total[seen])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, each count raised by one; rounded down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (float(corpus.sum()) + BUCKETS) / ((s + 1) * (float(target.sum()) + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


_WEIGHT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row; a text without words weighs nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, ends in texts_of(batch.column(1), SLICE):
                bucket, text, n_words = text_buckets(data, ends)
                # Long sums by differences of running ones, as weighted bincounts would be doubles.
                order = np.argsort(text, kind="stable")
                running = np.append(0, np.cumsum(shared.value[bucket[order]]))
                n_features = np.bincount(text, minlength=len(ends))
                stop = np.cumsum(n_features)
                yield rows(_WEIGHT, doc_id=batch.column(0).slice(first, len(ends)), n_words=n_words, n_features=n_features, weight=running[stop] - running[stop - n_features])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` counts the drawn rows from 1, others have none.

    ``share`` percent, rounded down, of the rows of at least ``least_words`` words are drawn: the highest scores, ties to the
    smaller ``doc_id``, then to fewer features and the smaller weight, so that only wholly equal rows share an order.  The
    noise in a score depends on ``seed`` and ``doc_id`` alone.  Rows without ``doc_id`` have no score, and are neither drawn nor
    counted; a null text has no words; rows that repeat an id are rows of their own.  Other columns of ``docs`` and
    ``target`` are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stored(weights(docs, gain).withColumn("score", F.col("weight") + gumbel), "resampling-scores")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    # Ranks of any number of rows: sorted by ranges, numbered inside them, and raised by the sizes of the ranges before.
    by = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    place = F.monotonically_increasing_id()
    ordered = stored(scored.where(able).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", place), "resampling-order")
    part = F.shiftright("place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    # One row per range.
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("of"))
    numbered = ordered.withColumn("part", part).join(F.broadcast(before), "part")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.when(rank <= F.floor(F.col("of") * share / 100), rank)
    out = ["doc_id", "n_features", "weight", "score"]
    return numbered.select(*out, drawn.cast("long").alias("rank")).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))
