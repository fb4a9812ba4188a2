"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are collapsed first and stand for their copies with a count.  Each table cuts the space by ``bits`` random
planes; vectors in one cell of a table are compared.  Cells that hold many vectors are cut into blocks, and each pair of
blocks is a group of its own, so no task holds a whole cell.  A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import links
from quire.llm.common import bounds, groups, rows, stored

THRESHOLD = 0.9
BITS = 12
TABLES = 32
BLOCK = 1024

_VECTOR = pa.schema([("vec_id", pa.int64()), ("digest", pa.string()), ("vector", pa.binary()), ("cells", pa.list_(pa.int32()))])


def planes(dimension: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, bits * tables))


def usable(vector: np.ndarray | None) -> bool:
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool((vector != 0).any())


def _hashed(vectors: DataFrame, key: str, column: str, bits: int, tables: int, seed: int) -> DataFrame:
    """Usable vectors with a digest of their exact value, their unit vector in doubles, and their cell in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _VECTOR}
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name is None or values is None or any(v is None for v in values):
                    continue
                vector = np.array(values, np.float64)
                if not usable(vector):
                    continue
                vector = vector + 0.0  # a negative zero equals zero
                digest = xxhash.xxh3_128_hexdigest(vector.tobytes())
                # Scaled first, so that neither the largest nor the smallest doubles break the norm.
                unit = vector / np.abs(vector).max()
                unit /= np.sqrt(unit @ unit)
                if len(unit) not in known:
                    known[len(unit)] = planes(len(unit), bits, tables, seed)
                signs = (unit @ known[len(unit)] >= 0).reshape(tables, bits)
                for column_, value in zip(out, (name, digest, unit.tobytes(), signs @ (1 << np.arange(bits)))):
                    out[column_].append(value)
            yield rows(_VECTOR, **out)

    return vectors.select(F.col(key).cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, "vec_id long, digest string, vector binary, cells array<int>")


def _compare(threshold: float):
    """Exact cosines inside groups of (table, cell, dimension, block, other block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["table", "cell", "dimension", "i", "j"]
        for part in groups(batches, keys):
            columns = [part.column(k).to_numpy() for k in (*keys, "block", "node", "size")]
            edges = bounds(*columns[:5])
            cells = part.column("cells").combine_chunks()
            width = len(cells[0]) if len(cells) else 0
            cells = np.asarray(cells.flatten()).reshape(-1, width)
            vectors = part.column("vector").to_pylist()
            found: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < 2:
                    continue
                table, own = int(columns[0][a]), columns[5][a:b] == columns[3][a]
                matrix = np.frombuffer(b"".join(vectors[a:b]), np.float64).reshape(b - a, -1)
                node, size, cell = columns[6][a:b], columns[7][a:b], cells[a:b]
                inside = columns[3][a] == columns[4][a]
                left, right = (slice(None), slice(None)) if inside else (np.flatnonzero(own), np.flatnonzero(~own))
                near = matrix[left] @ matrix[right].T >= threshold
                if inside:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                # A pair that shares a cell in an earlier table was counted there.
                x, y = np.nonzero(near)
                for start in range(0, len(x), 1 << 20):
                    p, q = x[start : start + (1 << 20)], y[start : start + (1 << 20)]
                    met = np.zeros(len(p), bool)
                    for t in range(table):
                        met |= cell[left][p, t] == cell[right][q, t]
                    near[p[met], q[met]] = False
                got = links.local_links(near, node, size) if inside else links.local_links(near, node[left], size[left], node[right], size[right])
                for k in range(3):
                    found[k].append(got[k])
            if found[0]:
                a, b, n = (np.concatenate(f) for f in found)
                yield rows(links.FOUND, a=a, b=b, n=n)

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, bits: int = BITS,
                    tables: int = TABLES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors link when their cosine, in doubles, is at least ``threshold`` and they share a cell: with the defaults a pair at
    0.9 is missed once in two hundred times, one at 0.95 hardly ever.  Choose ``bits`` so that cells stay small: about the
    binary logarithm of the number of vectors less four; ``tables`` then follows from the recall wanted.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, and vectors of different
    length do not link.  Rows that repeat an id and a vector are one vector; different vectors under one id pool their
    links under the id.  A null id has no links, a null component, and is kept.  Other columns are ignored.
    """
    hashed = stored(_hashed(vectors, key, column, bits, tables, seed), "vectors")
    single = hashed.select("vec_id", "digest").distinct()
    classes = stored(single.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size")), "classes")
    chosen = hashed.join(classes, [hashed.digest == classes.digest, hashed.vec_id == classes.node]).drop(classes.digest)
    chosen = chosen.dropDuplicates(["digest"]).select("node", "size", "vector", "cells", (F.octet_length("vector") / 8).cast("int").alias("dimension"))
    chosen = stored(chosen, "representatives")
    # One row per table; a cell with one vector has nothing to compare.
    placed = chosen.select("node", "dimension", F.posexplode("cells").alias("table", "cell"))
    full = placed.groupBy("table", "cell", "dimension").count().where("count > 1")
    many = placed.join(full, ["table", "cell", "dimension"]).withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int"))
    pairs = many.select("node", "table", "cell", "dimension", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    pairs = pairs.select("node", "table", "cell", "dimension", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    dealt = pairs.join(chosen.drop("dimension"), "node")
    order = ["table", "cell", "dimension", "i", "j"]
    dealt = dealt.select(*order, "block", "node", "size", "vector", "cells").repartition(*order).sortWithinPartitions(*order)
    result = links.summary(dealt.mapInArrow(_compare(threshold), links.FOUND_TYPE), "links")
    # Links of a vector: the other copies of itself and the members of the classes that its class is linked with.
    own = single.join(classes, "digest").join(result, "node", "left")
    # A class without links stands for its copies alone.
    own = own.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    own = own.groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    ids = vectors.select(F.col(key).cast("long").alias("vec_id"))
    out = ids.join(own, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
