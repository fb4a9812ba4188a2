"""Document fingerprints by winnowing.

All k-grams of code points are hashed; in every window of ``window`` consecutive k-grams the smallest hash is kept, the
rightmost one among equals, with its position.  Any passage of ``k + window - 1`` code points that two texts share has a
k-gram kept in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mix, rows

K = 16
WINDOW = 16
_BASE = 0x2545F4914F6CDD1D


def rolling(values: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of every run of ``k`` values, modulo 2**64, built by doubling."""
    if len(values) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total, done = None, 0
        power, size, bits = values, 1, k
        factor = np.uint64(base)
        while bits:
            n = len(values) - done - size + 1
            if bits & 1:
                total = power[:n].copy() if total is None else total[:n] * factor + power[done : done + n]
                done += size
            bits >>= 1
            if bits:
                n = len(power) - size
                power = power[:n] * factor + power[size:] if n > 0 else power[:0]
                size *= 2
                factor = factor * factor
        return mix(total, k)


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """Hash of every k-gram of code points; a shorter text is one gram."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return rolling(points + np.uint64(1), min(k, len(points))) if len(points) else points


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every window of consecutive values the place of the smallest, the rightmost among equals."""
    value, place = hashes, np.arange(len(hashes))

    def join(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = b <= a
        return np.where(right, b, a), np.where(right, q, p)

    size = 1
    while 2 * size <= window:
        value, place = join(value[:-size], place[:-size], value[size:], place[size:])
        size *= 2
    rest = window - size
    if rest:
        value, place = join(value[:-rest], place[:-rest], value[rest:], place[rest:])
    return place


def winnow(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values kept: per window the smallest value, the rightmost among equals."""
    if not len(hashes):
        return np.empty(0, np.int64), hashes
    place = window_minima(hashes, min(window, len(hashes)))
    kept = place[np.append(True, place[1:] != place[:-1])]
    return kept, hashes[kept]


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    return winnow(gram_hashes(text, k), window)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


class _Doc:
    __slots__ = ("key", "text", "name", "values")

    def __init__(self, key: int | None, text: str, k: int, window: int):
        import xxhash

        self.key, self.text = key, text
        places, values = fingerprint(text, k, window)
        self.name = xxhash.xxh3_128_hexdigest(places.astype("<i8").tobytes() + values.astype("<u8").tobytes())
        self.values = np.unique(values)


def positions(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """The fingerprints themselves: ``doc_id, position, hash`` of every kept k-gram; null texts have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                places, values = fingerprint(text.as_py() or "", k, window)
                yield rows(schema, doc_id=[key] * len(places), position=places, hash=values.view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, position long, hash long")


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, blocks_per_partition: int = 8) -> DataFrame:
    """Fingerprint of every text, of its edited text, and of how alike they and the next document are.

    The edited text has its last quarter of code points replaced by the first as many (or all) of the next document in
    ascending ``doc_id``; the first follows the last.  A null text counts as empty.  Rows without a ``doc_id`` come first
    in the order; rows that share one are ordered by text.  A single document follows itself.

    Documents are cut into blocks of consecutive ids.  The first document of a block is also sent to the block before, so
    every document meets its successor and the text crosses the network once.  Blocks are sized by quantiles of the ids;
    the driver sees one id per block.
    """
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions")) * blocks_per_partition
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    steps = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    cuts = np.array(sorted(set(named.agg(F.percentile_approx("doc_id", steps, 100 * blocks)).first()[0] or [])), np.int64)

    @F.pandas_udf(T.IntegerType())
    def block_of(ids):
        # A null id comes as NaN and belongs to the first block.
        found = np.searchsorted(cuts, ids.fillna(0).astype("int64"), "right")
        return ids.isna().map({True: 0, False: 1}).astype("int32") * found.astype("int32")

    heads = {r[0]: (r[1], r[2]) for r in named.groupBy(block_of("doc_id").alias("block")).agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).collect()}
    order = sorted(heads)
    # Where the first document of a block is needed once more: the block before, around the end.
    before = {heads[b][0] if not heads[b][1] else None: order[i - 1] for i, b in enumerate(order)}
    known = np.array(sorted(k for k in before if k is not None), np.int64)
    targets = np.array([before[k] for k in known.tolist()], np.int32)
    null_target = before.get(None, -1)

    @F.pandas_udf(T.IntegerType())
    def also_to(ids):
        values = ids.fillna(0).astype("int64").to_numpy()
        at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        out = np.where(known[at] == values, targets[at], -1) if len(known) else np.full(len(values), -1)
        out[ids.isna().to_numpy()] = null_target
        return ids.__class__(out.astype("int32"))

    copies = F.filter(F.array(F.struct(block_of("doc_id").alias("block"), F.lit(0).alias("extra")), F.struct(also_to("doc_id").alias("block"), F.lit(1).alias("extra"))),
                      lambda c: c["block"] >= 0)
    dealt = named.select("doc_id", "text", copies.alias("copies")).select("doc_id", "text", F.explode_outer("copies").alias("c"))
    dealt = dealt.select("c.block", "c.extra", "doc_id", "text").repartition(blocks // blocks_per_partition, "block").sortWithinPartitions("block", "extra", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash  # noqa: F401

        held, block_held = None, None
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _SCHEMA}
            for block, extra, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if extra and (held is None or block != block_held):
                    continue
                doc = _Doc(key, text.as_py(), k, window)
                if held is not None and block == block_held:
                    cut = len(held.text) // 4
                    edited = _Doc(None, held.text[: len(held.text) - cut] + doc.text[:cut], k, window)
                    values = (held.key, len(held.text), hashlib.sha256(edited.text.encode("utf-8", "surrogatepass")).hexdigest(), held.name, edited.name,
                              likeness(held.values, edited.values), likeness(held.values, doc.values))
                    for name, value in zip(out, values):
                        out[name].append(value)
                held, block_held = (None if extra else doc), block
            if out["doc_id"]:
                yield rows(_SCHEMA, **out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
