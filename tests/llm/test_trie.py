"""The prefix trie against a plain one, whatever the blocks, and on odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_plain import multiset, words

from quire.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(rows, family=20, shared=4):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % shared
        start = c - (c % family if c >= 0 else -(-c % family))
        out[c] = own.get(start, [])[:h] + own[c][h:]
    return out


def plain_trie(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node, convs in members.items():
        cost = (len(convs) - 1) * len(words(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += node not in children
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, count=60, letters="ab", longest=6):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-40, 400), count):
        for turn in range(draw.randint(1, longest)):
            rows.append((c, turn, draw.choice(["user", "bot"]) if turn % 2 else "user", " ".join([draw.choice(letters)] * draw.randint(1, 2))))
    draw.shuffle(rows)
    return rows


def compare(spark, rows, block_turns):
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), block_turns)
    assert found.columns == COLUMNS
    assert multiset(found.collect()) == multiset(plain_trie(plain_rebuilt(rows)))


@pytest.mark.parametrize("block_turns", [1, 7, 40, 1 << 16])
def test_blocks_of_any_size_give_the_same_trie(spark, block_turns):
    compare(spark, conversations(1), block_turns)


@pytest.mark.parametrize("seed", range(2, 5))
def test_random_conversations(spark, seed):
    compare(spark, conversations(seed, 40 + 30 * seed, "abc"[: 1 + seed % 3], 3 + seed), 12)


def test_odd_rows(spark):
    rows = [(5, None, "user", "first, though it has no turn"), (5, 1, None, None), (5, 1, None, None), (5, 1, "user", None), (5, 1, None, "user"), (None, 3, "user", "no conversation"), (None, None, None, None)]
    rows += [(0, 0, "user", "x"), (7, 0, "user", ""), (9, 0, "u", "ser"), (11, 0, "us", "er"), (13, 2**62, "user", "日本語 😀\u2003b\tc"), (27, 0, "user", "its family has no first conversation"), (-5, 0, "user", "below zero")]
    rows += [(40, t, "user", "hot") for t in range(3)] + [(c, t, "user", "hot") for c in range(41, 60) for t in range(3)]
    rows += [(80, t, "user", f"turn {t % 7}") for t in range(900)] + [(81, t, "user", f"turn {t % 7}") for t in range(700)] + [(100, 0, "user", "word " * 200_000), (101, 0, "user", "y" * 1_000_000)]
    for block in (3, 1 << 16):
        compare(spark, rows, block)


def test_turnless_and_empty(spark):
    only = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    compare(spark, [(only, 0, "user", "goes, as the start of its family is not here")], 10)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = conversations(9, 20)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("family", "own", "first", "h", "path", "words", "key", "part", "slice", "depth", "digest", "ends", "copies")})
    assert multiset(prefix_trie.conversation_trie(df, 9).collect()) == multiset(plain_trie(plain_rebuilt(rows)))


def test_extents_against_scans():
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        lcp = np.append(-1, draw.integers(0, 4, n - 1))
        at, depth = draw.integers(0, n, 200), draw.integers(0, 5, 200)
        left, right = prefix_trie.extents(prefix_trie.sparse_table(lcp), at, depth)
        for i, d, a, b in zip(at, depth, left, right):
            want_left = next((k for k in range(i, 0, -1) if lcp[k] < d), 0)
            want_right = next((k - 1 for k in range(i + 1, n) if lcp[k] < d), n - 1)
            assert (a, b) == (want_left, want_right)
