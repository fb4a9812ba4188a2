"""Token ids in binary shards with a minimal perfect hash index.

Format: a Parquet table, one row per shard.  A shard holds consecutive documents in key order.

* ``payload``: the ids of its documents, one after the other, little-endian unsigned integers of ``width`` bytes;
* ``keys``, ``lengths``: key and number of ids of each document in payload order (signed 64 and unsigned 32 bits);
* ``index``: the hash index (see ``KeyIndex``), which maps a key to the place of its first document;
* ``part, shard, first_key, last_key, n_docs, n_tokens, width``: the manifest, readable without the binaries.

A lookup finds the shard by its key range (Parquet statistics prune the rest), hashes the key to its slot, compares the
stored fingerprint and slices the payload: constant time whatever the number of documents in the shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import mix, rows
from quire.llm.pieces import encoder

SHARD_TOKENS = 1 << 19
_SCHEMA = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()),
    ("n_tokens", pa.int64()), ("width", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()), ("index", pa.binary()), ("payload", pa.binary())])
_STORE = "part int, shard int, first_key long, last_key long, n_docs long, n_tokens long, width int, keys binary, lengths binary, index binary, payload binary"
_FOUND = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class KeyIndex:
    """A minimal perfect hash over distinct 64-bit keys, with fingerprint, offset and length per slot.

    Level by level, each remaining key is hashed into a bit array twice as long as the number of keys; a bit is set where
    exactly one key falls, the others go on.  The slot of a key is the rank of its bit, counted by 64-bit words.  Every
    level settles over half of the keys, so a lookup takes two probes on average.
    """

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        self.levels, self.fingerprints, self.offsets, self.lengths = levels, fingerprints, offsets, lengths
        # Rank before each word, over all levels in a row.
        self.starts = np.cumsum([0, *[len(x) for x in levels]])
        words = np.concatenate(levels) if levels else np.empty(0, np.uint64)
        self.words, self.ranks = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys, 2 * level + 1) % np.uint64(size * 64)).astype(np.int64)

    @staticmethod
    def _fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> KeyIndex:
        left, levels = keys.astype(np.int64).view(np.uint64), []
        while len(left):
            size = len(left) * 2 // 64 + 1
            place = cls._place(left, len(levels), size)
            single = np.bincount(place, minlength=size * 64)[place] == 1
            bits = np.zeros(size, np.uint64)
            at = place[single]
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            levels.append(bits)
            left = left[~single]
        index = cls(levels, *[np.zeros(len(keys), t) for t in (np.uint32, np.uint64, np.uint32)])
        slots = index.slots(keys)
        index.fingerprints[slots] = cls._fingerprint(keys.astype(np.int64).view(np.uint64))
        index.offsets[slots], index.lengths[slots] = offsets, lengths
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where every level has a zero bit."""
        keys = keys.astype(np.int64).view(np.uint64)
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            place = self._place(keys[open_], level, len(bits))
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.ranks[self.starts[level] + word] + np.bitwise_count(below)
            found[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return found

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Found flag, offset and length in tokens; a key that is not stored is refused by the fingerprint."""
        slots = self.slots(keys)
        if not len(self.fingerprints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.maximum(slots, 0)
        same = (slots >= 0) & (self.fingerprints[at] == self._fingerprint(keys.astype(np.int64).view(np.uint64)))
        return same, self.offsets[at].astype(np.int64), self.lengths[at].astype(np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<II{len(self.levels)}I", len(self.levels), len(self.fingerprints), *map(len, self.levels))
        return head + b"".join(x.tobytes() for x in (*self.levels, self.fingerprints, self.offsets, self.lengths))

    @classmethod
    def from_bytes(cls, data: bytes) -> KeyIndex:
        n, size = struct.unpack_from("<II", data)
        lengths = struct.unpack_from(f"<{n}I", data, 8)
        at, levels = 8 + 4 * n, []
        for k in lengths:
            levels.append(np.frombuffer(data, "<u8", k, at))
            at += 8 * k
        return cls(levels, np.frombuffer(data, "<u4", size, at), np.frombuffer(data, "<u8", size, at + 4 * size), np.frombuffer(data, "<u4", size, at + 12 * size))


def write_store(docs: DataFrame, path: str, tokenizer: str, byte_level: bool = False, end_id: int = 1, width: int = 2,
                shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text, append ``end_id``, and write shards of consecutive documents in ascending ``doc_id`` order.

    Null and empty texts hold the end id alone.  Rows without a ``doc_id`` have no key and are not stored.  Rows that
    share a ``doc_id`` are all stored, one after the other in text order; the index leads to the first.  Other columns
    are ignored.  ``width`` is the bytes per id; an id that does not fit raises.  The text crosses the network once, in
    key order.  A shard is closed at ``shard_tokens``; a longer document makes a longer shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = encoder(tokenizer, byte_level), TaskContext.get().partitionId()
        keys, lengths, payload, held, shard = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(payload)
            if len(ids) and int(ids.max()) >= 1 << (8 * width):
                raise ValueError("a token id does not fit the width")
            names, sizes = np.array(keys, np.int64), np.array(lengths, np.int64)
            offsets = np.cumsum(sizes) - sizes
            first = np.append(True, names[1:] != names[:-1])
            index = KeyIndex.build(names[first], offsets[first], sizes[first])
            return rows(_SCHEMA, part=[part], shard=[shard], first_key=[keys[0]], last_key=[keys[-1]], n_docs=[len(keys)], n_tokens=[len(ids)],
                        width=[width], keys=[names.astype("<i8").tobytes()], lengths=[sizes.astype("<u4").tobytes()], index=[index.to_bytes()], payload=[ids.astype(f"<u{width}").tobytes()])

        for batch in batches:
            for first, ids, sizes in codec.batches(batch.column(1), end_id):
                at = 0
                for key, size in zip(batch.column(0).slice(first, len(sizes)).to_pylist(), sizes.tolist()):
                    # A shard never ends between rows of one key, so that a key range names one shard.
                    if held >= shard_tokens and keys[-1] != key:
                        yield close()
                        keys, lengths, payload, held, shard = [], [], [], 0, shard + 1
                    keys.append(key)
                    lengths.append(size)
                    payload.append(ids[at : at + size])
                    held, at = held + size, at + size
        if keys:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, _STORE).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORE).parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """Tokens before each shard, from the manifest alone: within a part, then over the parts (one row each)."""
    shards = store.select("part", "shard", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside"))
    return inside.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inside")).alias("shard_start"))


def fetch(store: DataFrame, keys: list[int]) -> DataFrame:
    """Ids of a few documents by key: ``doc_id, ids``; keys that are not stored are left out."""
    wanted = sorted(set(keys))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asked = np.array([k for k in wanted if r["first_key"] <= k <= r["last_key"]], np.int64)
                ids = np.frombuffer(r["payload"], f"<u{r['width']}")
                for k, ok, at, n in zip(asked, *KeyIndex.from_bytes(r["index"]).lookup(asked)):
                    if ok:
                        yield pa.RecordBatch.from_pydict({"doc_id": [int(k)], "ids": [ids[at : at + n].astype(np.int64).tolist()]},
                                                         pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    hit = F.lit(False)
    for k in wanted:
        hit = hit | ((F.col("first_key") <= k) & (F.col("last_key") >= k))
    return store.where(hit).mapInArrow(look, "doc_id long, ids array<long>")


def digest(store: DataFrame) -> DataFrame:
    """One row per stored document, read from the files: its place among all ids, its length and the crc32 of its ids.

    Every key is looked up in the index; rows that repeat a key follow the row that the index names.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, shard, _, _, n_docs, _, width, keys, sizes, index, payload = (c[r].as_py() for c in batch.columns)
                names = np.frombuffer(keys, "<i8")
                found, offset, length = KeyIndex.from_bytes(index).lookup(names)
                if not found.all():
                    raise ValueError("the index does not know a key of its own shard")
                ids = np.frombuffer(payload, f"<u{width}").astype("<u4")
                # The index has the first row of a key; the rows that repeat it follow.
                sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
                again = np.flatnonzero(names[1:] == names[:-1]) + 1
                for k in again.tolist():
                    offset[k], length[k] = offset[k - 1] + length[k - 1], sizes[k]
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(offset.tolist(), length.tolist())]
                yield rows(_FOUND, part=np.full(n_docs, part), shard=np.full(n_docs, shard), doc_id=names, offset=offset, n_tokens=length, ids_crc32=crc)

    found = store.mapInArrow(read, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    placed = found.join(shard_starts(store), ["part", "shard"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
