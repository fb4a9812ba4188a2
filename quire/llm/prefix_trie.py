"""Prefix trie of conversations: which share their first turns, and how many words that sharing saves.

Every conversation becomes a path: the 16-byte digests of its turns one after the other, so that the order of paths as bytes
puts conversations with a common beginning next to each other.  Equal paths become one row with a count.  The distinct paths
are sorted by ranges and cut into blocks of a bounded number of turns.  Inside a block the longest common prefix (LCP) of
neighbours is known, and a node of the trie is an interval of paths whose inner LCPs reach its depth.  A sparse table over
the LCPs answers range minima, so each candidate prefix finds its left and its right extent by a binary search of its own,
all of them at once and without any stack.  Nodes between two branchings share one interval and are listed from it.

Only nodes on the first and the last path of a block can reach into the next one, and all their numbers are sums, minima or
maxima over blocks, as words saved are (words of all members) less (words of the nodes themselves).  So one small
aggregation over the nodes that span an edge makes them whole, and no other node is ever shuffled but to look up a parent
that spans an edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import rows, stored

DIGEST = 16
# Turns of distinct paths that one block holds; a longer path is a block of its own.
BLOCK_TURNS = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """``conv_id, path, words``: the first h turns of the conversation that starts the family of ``family`` ids, then the own turns after the first h.

    h is crc32 of the id modulo ``shared``.  Turns are ordered by ``turn``, null first, those of one turn by the digest of
    role and text; repeated rows are turns of their own.  A null role or text is empty.  Rows without ``conv_id`` belong to
    no conversation.  A conversation is one row: 20 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    ).withColumn("family", F.col("conv_id") - F.col("conv_id") % family)
    # Dealt by family once: a family's conversations and the one that they start from meet without another exchange.
    own = turns.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, shared))).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    none = F.slice("own", 1, 0)
    together = own.withColumn("first", F.coalesce(first, none)).withColumn("h", h).select(
        "conv_id", F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))
    return together.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


_ENDS = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, smallest id and digest of all ids of each key, from rows sorted by key and id; a key of any size takes one hash state."""
    key, count, least, state = None, 0, 0, None
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _ENDS}
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, conv in zip(keys, ids):
            if k == key:
                count += 1
                state.update(b",%d" % conv)
                continue
            if key is not None:
                for name, value in zip(out, (key, count, least, state.hexdigest())):
                    out[name].append(value)
            key, count, least, state = k, 1, conv, hashlib.sha256(b"%d" % conv)
        yield rows(_ENDS, **out)
    if key is not None:
        yield rows(_ENDS, key=[key], copies=[count], conv_id=[least], ends=[state.hexdigest()])


_BLOCK = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("paths", pa.list_(pa.binary())), ("words", pa.list_(pa.list_(pa.int32()))),
                    ("copies", pa.list_(pa.int64())), ("conv_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.string()))])
_BLOCK_DDL = "part int, slice int, first binary, last binary, paths array<binary>, words array<array<int>>, copies array<bigint>, conv_ids array<bigint>, ends array<string>"


def _pack(limit: int):
    """Blocks of sorted paths of about ``limit`` turns; one row each, numbered by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[list] = [[], [], [], [], []]

        def block() -> pa.RecordBatch:
            paths = held[0]
            return rows(_BLOCK, part=[part], slice=[number], first=[paths[0]], last=[paths[-1]], paths=[paths], words=[held[1]], copies=[held[2]], conv_ids=[held[3]], ends=[held[4]])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                turns = len(row[0]) // DIGEST + 1
                if held[0] and size + turns > limit:
                    yield block()
                    held, number, size = [[], [], [], [], []], number + 1, 0
                for column, value in zip(held, row):
                    column.append(value)
                size += turns
        if held[0]:
            yield block()

    return run


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two paths begin with alike."""
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, np.uint64)[: 2 * n].reshape(n, 2) for p in (a, b))
    unlike = np.flatnonzero((x != y).any(axis=1))
    return int(unlike[0]) if len(unlike) else n


_EDGE = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("before", pa.int32()), ("after", pa.int32())])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, number, first, last, previous, following = (batch.column(k).to_pylist() for k in range(6))
        yield rows(_EDGE, part=part, slice=number, before=[-1 if p is None else common_turns(p, f) for p, f in zip(previous, first)],
                   after=[-1 if n is None else common_turns(x, n) for x, n in zip(last, following)])


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row k holds the minimum of every run of 2**k values."""
    table, step = [values], 1
    while 2 * step <= len(values):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        step *= 2
    return table


def range_minimum(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum over ``left`` to ``right``, both included, of each pair."""
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), table[0].dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][left[at]], table[k][right[at] - (1 << int(k)) + 1])
    return out


def extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last path that share at least ``depth`` turns with path ``at``, by two binary searches for every candidate.

    ``table`` is over the LCPs with the path before (of the first path: -1).
    """
    n = len(table[0])
    left, right = at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        step, row = 1 << k, table[k]
        start = left - step + 1  # the LCPs of the paths start to left join them to path start - 1
        left = np.where((start >= 1) & (row[np.maximum(start, 0)] >= depth), left - step, left)
        inside = right + step <= n - 1
        right = np.where(inside & (row[np.where(inside, right + 1, 0)] >= depth), right + step, right)
    return left, right


def _chain(path: bytes, depth: int) -> list[bytes]:
    """Keys of the prefixes of 0 to ``depth`` turns."""
    state, keys = hashlib.md5(), []
    keys.append(state.digest())
    for d in range(depth):
        state.update(path[DIGEST * d : DIGEST * (d + 1)])
        keys.append(state.digest())
    return keys


_NODE = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("node_key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())])
_NODE_DDL = "part int, slice int, node_key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def block_nodes(paths: list[bytes], words: list[np.ndarray], copies: np.ndarray, convs: np.ndarray, ends: list[str], before: int, after: int) -> Iterator[dict]:
    """Columns of the nodes of one block, in slices; ``before`` and ``after`` are the LCPs with the neighbouring blocks, -1 without one.

    Nodes that span an edge get a key and what this block adds to them; the others are whole, but for the parent's id where the parent spans one.
    """
    n = len(paths)
    length = np.array([len(p) for p in paths], np.int64) // DIGEST
    offset = np.append(0, np.cumsum(length))
    turns = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    # Compare every path with the one before it, turn by turn, up to the shorter of both.
    both = np.minimum(length[1:], length[:-1])
    ends_at = np.cumsum(both)
    inner = np.arange(both.sum()) - np.repeat(ends_at - both, both)
    same = (turns[np.repeat(offset[:-2], both) + inner] == turns[np.repeat(offset[1:-1], both) + inner]).all(axis=1) if n > 1 else np.empty(0, bool)
    unlike = np.flatnonzero(~same)
    nearest = np.append(unlike, len(same))[np.searchsorted(unlike, ends_at - both)] if n > 1 else np.empty(0, np.int64)
    lcp = np.append(-1, np.minimum(nearest - (ends_at - both), both)) if n > 1 else np.array([-1])
    table, least = sparse_table(lcp), sparse_table(convs)
    # Candidates: every whole path, every LCP, the root, and the depths to which the neighbouring blocks reach in.
    at = np.concatenate([np.arange(n), np.arange(1, n), [0], [0] * (before >= 0), [n - 1] * (after >= 0)]).astype(np.int64)
    depth = np.concatenate([length, lcp[1:], [0], [before] * (before >= 0), [after] * (after >= 0)]).astype(np.int64)
    left, right = extents(table, at, depth)
    once = np.unique(left * (int(length.max()) + 1) + depth, return_index=True)[1]
    left, right, depth = left[once], right[once], depth[once]
    # A node's chain goes up to the deepest shallower candidate that holds its interval.
    above = np.maximum(np.where(left > 0, lcp[left], -1), np.where(right < n - 1, lcp[np.minimum(right + 1, n - 1)], -1))
    above = np.maximum(above, np.where((left == 0) & (before < depth), before, -1))
    above = np.maximum(above, np.where((right == n - 1) & (after < depth), after, -1))
    above = np.where(depth > 0, np.maximum(above, 0), -1)
    up_left, up_right = extents(table, left, np.maximum(above, 0))
    # Running totals of words along the paths, and of what whole paths hold and own.
    sums = np.append(0, np.cumsum(np.concatenate(words) if offset[-1] else np.empty(0, np.int64)))
    prefix = lambda i, d: sums[offset[i] + d] - sums[offset[i]]
    total = prefix(np.arange(n), length)
    members, held = np.append(0, np.cumsum(copies)), np.append(0, np.cumsum(copies * total))
    owned = np.append(0, np.cumsum(total - prefix(np.arange(n), np.maximum(lcp, 0))))
    leaf = np.append(0, np.cumsum(np.append(lcp[1:], after) < length))
    branches = np.sort(lcp * n + np.arange(n))
    ending = np.array(ends, object)
    first_keys, last_keys = _chain(paths[0], max(before, 0)), _chain(paths[-1], max(after, 0))
    # List the nodes of the chains, a bounded number at a time.
    count = depth - above
    stops = np.cumsum(count)
    for low in range(0, int(stops[-1]), BLOCK_TURNS):
        number = np.arange(low, min(low + BLOCK_TURNS, int(stops[-1])))
        node = np.searchsorted(stops, number, "right")
        d, l, r = depth[node] - (stops[node] - 1 - number), left[node], right[node]
        bottom, parent = d == depth[node], d - 1
        pl, pr = np.where(parent > above[node], l, up_left[node]), np.where(parent > above[node], r, up_right[node])
        spans = (l == 0) & (before >= d) | (r == n - 1) & (after >= d)
        parent_spans = (parent >= 0) & ((pl == 0) & (before >= parent) | (pr == n - 1) & (after >= parent))
        goes_on = (l == 0) & (before > d)  # the first child is the block before's
        split = np.searchsorted(branches, d * n + r, "right") - np.searchsorted(branches, d * n + l, "right")
        stop = length[l] == d
        above_words = prefix(l, np.maximum(np.maximum(parent, 0), np.where(l == 0, np.minimum(before, length[0]), 0)))
        n_convs = members[r + 1] - members[l]
        saved = held[r + 1] - held[l] - n_convs * prefix(l, np.maximum(parent, 0)) - (owned[r + 1] - owned[l + 1] + total[l] - above_words)
        up = range_minimum(least, pl, pr)
        yield {
            "node_key": [first_keys[x] if p == 0 and before >= x else last_keys[x] if s else None for x, p, s in zip(d.tolist(), l.tolist(), spans.tolist())],
            "parent_key": [None if not s else first_keys[x] if p == 0 and before >= x else last_keys[x] for x, p, s in zip(parent.tolist(), pl.tolist(), parent_spans.tolist())],
            "conv_id": range_minimum(least, l, r), "depth": d,
            "parent_conv_id": pa.array(up, pa.int64(), mask=parent_spans | (parent < 0)),
            "n_convs": n_convs, "n_children": np.where(bottom, 1 + split - stop, 1) - goes_on, "n_leaves": leaf[r + 1] - leaf[l],
            "saved_tokens": saved, "ends": pa.array(np.where(stop, ending[l], None), pa.string()),
        }


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, number, paths, words, copies, convs, ends, before, after = (batch.column(c)[k] for c in range(9))
            lengths = [np.asarray(w, np.int64) for w in words.as_py()]
            for columns in block_nodes(paths.as_py(), lengths, np.asarray(copies.as_py(), np.int64), np.asarray(convs.as_py(), np.int64), ends.as_py(), before.as_py(), after.as_py()):
                size = len(columns["depth"])
                yield rows(_NODE, part=[part.as_py()] * size, slice=[number.as_py()] * size, **columns)


def trie(paths: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of ``conv_id, path, words`` (digests of the turns, and words in each): see ``conversation_trie``."""
    paths = stored(paths.withColumn("key", F.unhex(F.md5("path"))), "trie-paths")
    # The ids of equal paths meet as narrow sorted rows; the paths themselves are made distinct before they move.
    ends = paths.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key binary, copies long, conv_id long, ends string")
    distinct = paths.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"))
    ordered = distinct.join(ends, "key").select("path", "words", "copies", "conv_id", "ends").repartitionByRange("path").sortWithinPartitions("path")
    blocks = stored(ordered.mapInArrow(_pack(block_turns), _BLOCK_DDL), "trie-blocks")
    # One row per block, so a single window is bounded by the number of blocks.
    order = Window.orderBy("part", "slice")
    edges = blocks.select("part", "slice", "first", "last", F.lag("last").over(order).alias("previous"), F.lead("first").over(order).alias("following"))
    edges = stored(edges.mapInArrow(_edges, "part int, slice int, before int, after int"), "trie-edges")
    inputs = blocks.join(edges, ["part", "slice"]).select("part", "slice", "paths", "words", "copies", "conv_ids", "ends", "before", "after")
    nodes = stored(inputs.mapInArrow(_nodes, _NODE_DDL), "trie-nodes")
    return _whole(nodes)


def _whole(nodes: DataFrame) -> DataFrame:
    """Add up the nodes that span edges of blocks, and look up parents among them."""
    spanning = F.col("node_key").isNotNull()
    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.where(spanning).groupBy("node_key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *summed, F.max("ends").alias("ends"))
    merged = stored(merged, "trie-spanning")  # a path of nodes per block
    parents = merged.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    here = nodes.where(spanning).select("part", "slice", F.col("node_key").alias("parent_key")).join(parents, "parent_key")
    below = nodes.where(~spanning & F.col("parent_key").isNotNull()).drop("parent_conv_id").join(here, ["part", "slice", "parent_key"])
    out: list[str | Column] = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256")]
    parts = (nodes.where(~spanning & F.col("parent_key").isNull()), below, merged.join(parents, "parent_key", "left"))
    return parts[0].select(*out).unionByName(parts[1].select(*out)).unionByName(parts[2].select(*out))


def conversation_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, the empty one (the root) included.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the beginning one turn shorter (null for the root),
    ``n_convs`` the members, ``n_children`` the beginnings one turn longer, ``n_leaves`` the childless nodes below or at the
    node, ``saved_tokens`` the words that its subtree need not store twice, ``ends_sha256`` a digest of the members that end
    there (of nothing where none does).  Without conversations there is no node.  Other columns are ignored.
    """
    return trie(rebuilt(conversations), block_turns)
