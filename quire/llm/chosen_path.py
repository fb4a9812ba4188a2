"""Similarity join of documents on word shingles by chosen paths, with exact verification.

Each set of shingles is embedded as ``SKETCH`` minimum hashes; two sets share a coordinate with a probability equal to
their Jaccard similarity.  A node of the recursion picks, by a hash of its path, each coordinate with probability
``1 / (threshold * SKETCH)`` and sends a set to the child named by its value there (Christiani, Pagh and Sivertsen, "Scalable
and robust set similarity join").  A pair at the threshold goes on together in one child on average at each node, so it
meets in a leaf with a probability that falls only as one over the depth; ``runs`` independent trees make misses rare.

A bucket of at most ``LEAF`` sets is a leaf and is brute-forced on the sketches.  Buckets still larger at the last level hold
sets that agree almost everywhere; they are dealt into leaves at random and the leaders of the leaves are compared pair
of blocks by pair of blocks.  What comes out are candidate clusters; inside them exact similarities are computed on
the whole shingle sets, block by block.  Equal sets are collapsed first and stand for their copies with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import links
from quire.llm.common import bounds, few, groups, lean, mix, rows, shingles, stored, texts_of, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 128
RUNS = 12
LEVELS = 3
LEAF = 512
BLOCK = 256

FEW_TEXTS = 1024
_SET = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("shingles", pa.int64()), ("sketch", pa.binary())])
_PATH = pa.schema([("path", pa.int64()), ("node", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("leader", pa.bool_()), ("path", pa.int64())])
_EXACT = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("set", pa.binary())])


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text the distinct hashes of all runs of ``n`` words; a text of fewer words is one shingle; no word, no shingle."""
    for _, data, ends in texts_of(column):
        hashes, owner = word_hashes(data, ends)
        grams = shingles(hashes, n)
        limits = np.searchsorted(owner, np.arange(len(ends) + 1)).tolist()
        for a, b in zip(limits[:-1], limits[1:]):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            else:
                yield shingles(hashes[a:b], b - a) if b > a else hashes[:0]


def factors(seed: int, size: int = SKETCH) -> np.ndarray:
    return mix(np.arange(size, dtype=np.uint64), seed) | np.uint64(1)


def sketch(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Minimum hash of the set under every factor; large sets go in slices so that the working set stays small."""
    best = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(values), 1024):
            part = values[a : a + 1024]
            best = np.minimum(best, (by[:, None] * part[None, :]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def _sketches(docs: DataFrame, seed: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        by = factors(seed)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _SET}
            for name, values in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                if name is None or not len(values):
                    continue
                for column, value in zip(out, (name, xxhash.xxh3_128_hexdigest(values.tobytes()), len(values), sketch(values, by).tobytes())):
                    out[column].append(value)
            yield rows(_SET, **out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest string, shingles long, sketch binary")


def _children(paths: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For every set on its path: the row and the path of each child it is sent to."""
    size = sketches.shape[1]
    limit = np.uint64(int((1 << 64) / (threshold * size)))
    out_row, out_path = [], []
    for a in range(0, len(paths), 4096):
        own = paths[a : a + 4096, None]
        chosen = mix(own ^ (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :], 3) < limit
        row, coordinate = np.nonzero(chosen)
        value = sketches[a + row, coordinate].astype(np.uint64)
        out_row.append(a + row)
        out_path.append(mix(own[row, 0] ^ mix(value + (coordinate.astype(np.uint64) << np.uint64(32)), 5), 4))
    return (np.concatenate(out_row), np.concatenate(out_path)) if out_row else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _split(sets: DataFrame, threshold: float, runs: int | None, seed: int) -> DataFrame:
    """Rows of (path, node) one level down; ``runs`` starts that many trees from the roots."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            nodes = batch.column(0).to_numpy()
            if runs is None:
                starts = [batch.column(2).to_numpy().view(np.uint64)]
            else:
                starts = [np.full(len(nodes), r, np.uint64) for r in mix(np.arange(runs, dtype=np.uint64), seed)]
            for paths in starts:
                at, path = _children(paths, data, threshold)
                yield rows(_PATH, path=path.view(np.int64), node=nodes[at])

    return sets.mapInArrow(run, "path long, node long")


def _estimate(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal coordinates for every pair; one byte per coordinate is compared."""
    out = np.empty((len(own), len(other)), np.float32)
    step = max(1, (1 << 22) // max(1, other.size))
    for a in range(0, len(own), step):
        out[a : a + step] = (own[a : a + step, None, :] == other[None, :, :]).mean(axis=2, dtype=np.float32)
    return out


def _leaves(near: float, least: float):
    """Brute force of a leaf on the sketches: pairs whose estimate is at least ``least`` join their members.

    What leaves the leaf is one edge per member, to the smallest member of its local component.  In a leaf of a cut bucket
    the leaders are reported too: sets that are not within ``near`` of an earlier leader.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["path", "salt"]):
            path, salt, node, cut = (part.column(k).to_numpy(zero_copy_only=False) for k in ("path", "salt", "node", "cut"))
            data = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(len(node), -1).astype(np.uint8)
            out_a, out_b, out_leader, out_path = [], [], [], []

            def put(a: np.ndarray, b: np.ndarray, leader: bool, at: int, out_a=out_a, out_b=out_b, out_leader=out_leader, out_path=out_path, path=path) -> None:
                out_a.append(a)
                out_b.append(b)
                out_leader.append(np.full(len(a), leader))
                out_path.append(np.full(len(a), path[at]))

            edges = bounds(path, salt)
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a == 1 and not cut[a]:
                    continue
                own, name = data[a:b], node[a:b]
                alike = _estimate(own, own)
                joined = alike >= least
                np.fill_diagonal(joined, False)
                x, y, _ = links.local_links(joined, name, np.ones(b - a, np.int64))
                put(x[x != y], y[x != y], False, a)
                if cut[a]:
                    is_leader = np.ones(b - a, bool)
                    for k in range(1, b - a):
                        is_leader[k] = not (alike[k, :k][is_leader[:k]] >= near).any()
                    put(name[is_leader], name[is_leader], True, a)
            if out_a:
                yield rows(_EDGE, a=np.concatenate(out_a), b=np.concatenate(out_b), leader=np.concatenate(out_leader), path=np.concatenate(out_path))

    return run


def _block_edges(least: float):
    """Edges between the leaders of a cut bucket, for groups of (path, i, j)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["path", "i", "j"]):
            path, i, j, block, node = (part.column(k).to_numpy() for k in ("path", "i", "j", "block", "node"))
            data = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(len(node), -1).astype(np.uint8)
            edges = bounds(path, i, j)
            out_a, out_b = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                left = np.flatnonzero(block[a:b] == i[a]) + a
                right = np.flatnonzero(block[a:b] == j[a]) + a
                if not len(left) or not len(right):
                    continue
                near = _estimate(data[left], data[right]) >= least
                # A spanning set of edges is enough here: every member to the first one it is near to.
                one = np.ones(1, np.int64)
                if i[a] == j[a]:
                    np.fill_diagonal(near, False)
                    x, y, _ = links.local_links(near, node[left], np.ones(len(left), np.int64))
                else:
                    x, y, _ = links.local_links(near, node[left], np.repeat(one, len(left)), node[right], np.repeat(one, len(right)))
                out_a.append(x)
                out_b.append(y)
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield rows(_EDGE, a=a, b=b, leader=np.zeros(len(a), bool), path=np.zeros(len(a), np.int64))

    return run


def _candidates(sets: DataFrame, threshold: float, runs: int, levels: int, leaf: int, seed: int) -> DataFrame:
    """Edges between sets that may be similar: ``a, b``."""
    counted, leaves = _split(sets.select("node", "sketch"), threshold, runs, seed), []
    for level in range(levels):
        counted = stored(counted, "paths")
        full = counted.groupBy("path").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
        rows_ = counted.join(full, "path")
        if level == levels - 1:
            leaves.append(rows_)
            break
        leaves.append(rows_.where(F.col("count") <= leaf))
        large = rows_.where(F.col("count") > leaf).join(sets.select("node", "sketch"), "node")
        counted = _split(large.select("node", "sketch", "path"), threshold, None, seed)
    met = leaves[0]
    for more in leaves[1:]:
        met = met.unionByName(more)
    met = met.withColumn("cut", F.col("count") > leaf)
    # A bucket above the leaf size is dealt at random into leaves.
    met = met.withColumn("salt", F.when(F.col("cut"), F.pmod(F.xxhash64("node", "path"), F.ceil(F.col("count") / leaf))).otherwise(0).cast("int"))
    dealt = met.join(sets.select("node", "sketch"), "node").select("path", "salt", "node", "cut", "sketch")
    dealt = dealt.repartition("path", "salt").sortWithinPartitions("path", "salt")
    # Estimates from SKETCH coordinates err by at most 0.15 in all but one of ten thousand cases.
    distance, slack = 1 - threshold, 0.15
    edges = stored(dealt.mapInArrow(_leaves(1 - distance, 1 - distance - slack), "a long, b long, leader boolean, path long"), "edges")
    # A set of a cut bucket is within one link distance of a leader of its leaf, so by the triangle inequality linked sets of
    # two leaves have leaders within three link distances of each other.
    chosen = edges.where("leader").select("path", F.col("a").alias("node"))
    total = chosen.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("blocks"))
    chosen = chosen.join(total, "path").withColumn("block", F.pmod(F.xxhash64("path", "node"), F.col("blocks")).cast("int"))
    pairs = chosen.select("path", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    pairs = pairs.select("path", "node", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    pairs = pairs.join(sets.select("node", "sketch"), "node").select("path", "i", "j", "block", "node", "sketch")
    between = pairs.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_block_edges(1 - 3 * distance - slack), "a long, b long, leader boolean, path long")
    return edges.where("NOT leader").select("a", "b").union(between.select("a", "b")).distinct()


def _overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection for every pair of sets, by products of incidence matrices over the shared elements."""
    both = left + right
    sizes = np.array([len(s) for s in both])
    values, owner = np.concatenate(both), np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = bounds(values)
    count = np.diff(starts)
    shared = np.repeat(count > 1, count)
    column = (np.cumsum(count > 1) - 1).repeat(count)[shared]
    owner = owner[shared]
    width = int((count > 1).sum())
    out = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        matrix = np.zeros((len(both), min(step, width - a)), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - a] = 1
        out += matrix[: len(left)] @ matrix[len(left) :].T
    return out


def _verify(threshold: float):
    """Exact Jaccard similarities inside groups of (cluster, band, i, j)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["cluster", "band", "i", "j"]):
            cluster, band, i, j, own_band, block, node, size = (part.column(k).to_numpy() for k in ("cluster", "band", "i", "j", "own_band", "block", "node", "size"))
            data = part.column("set")
            edges = bounds(cluster, band, i, j)
            found: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(edges[:-1], edges[1:]):
                # j below zero: the partner block, one band up, has number -1 - j.
                same = j[a] >= 0
                first = (own_band[a:b] == band[a]) & (block[a:b] == i[a])
                left = np.flatnonzero(first) + a
                right = (np.flatnonzero(block[a:b] == j[a]) if same else np.flatnonzero((own_band[a:b] != band[a]) & (block[a:b] == -1 - j[a]))) + a
                if not len(left) or not len(right) or (same and i[a] == j[a] and len(left) < 2):
                    continue
                x, y = ([np.frombuffer(data[int(k)].as_py(), np.uint64) for k in at] for at in (left, right))
                common = _overlap(x, y)
                total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
                near = common >= threshold * (total - common) - 1e-6
                if same and i[a] == j[a]:
                    np.fill_diagonal(near, False)
                    got = links.local_links(near, node[left], size[left])
                else:
                    got = links.local_links(near, node[left], size[left], node[right], size[right])
                for k in range(3):
                    found[k].append(got[k])
            if found[0]:
                a, b, n = (np.concatenate(f) for f in found)
                yield rows(links.FOUND, a=a, b=b, n=n)

    return run


def _exact_sets(docs: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in few(batches, FEW_TEXTS):
            sets = [values.tobytes() for values in shingle_sets(batch.column(1))]
            yield rows(_EXACT, doc_id=batch.column(0), digest=[xxhash.xxh3_128_hexdigest(s) for s in sets], set=sets)

    return docs.mapInArrow(run, "doc_id long, digest string, set binary")


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, levels: int = LEVELS, leaf: int = LEAF, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """``doc_id, class_id, n_links, kept``, one row per input row.

    Documents link when the Jaccard similarity of their sets of 5-word shingles is at least ``threshold``; ``class_id`` is the
    smallest ``doc_id`` reachable by links, ``n_links`` the number of other documents linked directly.  Words are runs of
    anything but spaces and ASCII controls, unchanged.  A text of fewer than five words is one shingle.  Null and empty
    texts link with nothing.  Rows that repeat an id and a text are one document; different texts under one id pool their
    links.  A null id has no links, a null class, and is kept.  Other columns are ignored.
    """
    sketches = stored(_sketches(docs, seed), "sketches")
    members = sketches.select("doc_id", "digest").distinct()
    classes = stored(members.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size")), "classes")
    sets = sketches.join(classes, [sketches.digest == classes.digest, sketches.doc_id == classes.node]).drop(classes.digest)
    sets = stored(sets.dropDuplicates(["node", "digest"]).select("node", "size", "shingles", "sketch", "digest"), "sets")
    clusters = links.components(_candidates(sets, threshold, runs, levels, leaf, seed), "clusters")
    # Only documents with a set of similar size can be similar: sets of a cluster are cut into bands by size.
    banded = sets.join(clusters, "node").select("node", "size", "digest", F.col("component").alias("cluster"),
                                              F.floor(F.log(F.col("shingles").cast("double")) / F.log(F.lit(1 / threshold))).cast("int").alias("own_band"))
    banded = stored(banded, "banded")
    per_band = banded.groupBy("cluster", "own_band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    above = per_band.select("cluster", (F.col("own_band") - 1).alias("own_band"), F.col("blocks").alias("above"))
    below = per_band.select("cluster", (F.col("own_band") + 1).alias("own_band"), F.col("blocks").alias("below"))
    shape = per_band.join(above, ["cluster", "own_band"], "left").join(below, ["cluster", "own_band"], "left")
    placed = banded.join(shape, ["cluster", "own_band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Same band: with every block.  One band up: this block first.  One band down: this block second, numbered below zero.
    upto = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda band, i, j: F.struct(band.alias("band"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own, at = F.col("own_band"), F.col("block")
    met = F.concat(
        F.transform(upto(F.col("blocks")), lambda k: key(own, F.least(at, k), F.greatest(at, k))),
        F.transform(upto(F.col("above")), lambda k: key(own, at, -1 - k)),
        F.transform(upto(F.col("below")), lambda k: key(own - 1, k, -1 - at)),
    )
    # The members grow with the corpus; without the hint a small corpus would broadcast them and have another plan.
    members_of_clusters = banded.select(F.col("node").alias("doc_id")).distinct()
    exact = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members_of_clusters.hint("merge"), "doc_id", "left_semi")
    exact = _exact_sets(exact).dropDuplicates(["doc_id", "digest"])
    dealt = placed.select("node", "digest", "size", "cluster", "own_band", "block", F.explode(met).alias("k")).select("node", "digest", "size", "cluster", "own_band", "block", "k.*")
    dealt = dealt.join(exact.withColumnRenamed("doc_id", "node"), ["node", "digest"]).select("cluster", "band", "i", "j", "own_band", "block", "node", "size", "set")
    dealt = dealt.repartition("cluster", "band", "i", "j").sortWithinPartitions("cluster", "band", "i", "j")
    result = links.summary(dealt.mapInArrow(_verify(threshold), links.FOUND_TYPE), "links")
    own_rows = members.join(classes, "digest").join(result, "node", "left")
    own_rows = own_rows.select("doc_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    own_rows = own_rows.groupBy("doc_id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(own_rows, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
