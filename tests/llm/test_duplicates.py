"""Embedding near-duplicates, the chosen-path join, substring removal, winnowing, components: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from llm_plain import SCHEMA, multiset, odd_documents, words
from pyspark.sql import functions as F

from quire.llm import chosen_path, links, simhash, substrings, winnow


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + k) for k in range(200)] + [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(70)] + [(7, 7)]
    draw.shuffle(edges)
    union = Union()
    for a, b in edges:
        union.join(a, b)
    found = links.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in found} == {(x, union.find(x)) for e in edges if e[0] != e[1] for x in e}
    assert len(found) == len({x for e in edges if e[0] != e[1] for x in e})


def test_components_of_nothing(spark):
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- embeddings --------------------------------------------------------------------------------------------------


def plain_embeddings(rows, threshold=0.9):
    """Links and components; equal (id, vector) rows are one vector."""
    good = {}
    for name, v in rows:
        if name is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[name, tuple(x + 0.0 for x in v)] = np.array(v, float) / np.linalg.norm(v)
    keys, union, count = list(good), Union(), {}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(a[1]) == len(b[1]) and good[a] @ good[b] >= threshold:
                union.join(a[0], b[0])
                for k in (a, b):
                    count[k[0]] = count.get(k[0], 0) + 1
    return multiset((n, count.get(n, 0), None if n is None else union.find(n), n is None or union.find(n) == n) for n, _ in rows)


def vectors(seed, n=150, groups=6, size=16):
    random_ = np.random.default_rng(seed)
    rows = [random_.normal(size=size) for _ in range(n)]
    for _ in range(groups):
        centre = random_.normal(size=size)
        rows += [centre + random_.normal(size=size) * 0.1 for _ in range(12)] + [centre] * 3
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [8, 1024])
def test_embeddings(spark, block):
    """Also where cells are cut into many blocks."""
    rows = vectors(1)
    found = simhash.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), bits=4, tables=24, block=block)
    assert multiset(found.collect()) == plain_embeddings(rows)


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [1.0, 0.01]), (9, [1.0, 0.01]), (1, None), (2, []), (4, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 0.0]),
            (10, [1.0, 0.0, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (13, [1e30, 1e30]), (14, [1e-30, 1e-30]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("node", "size", "table", "cell", "label", "component", "links", "digest", "vector")})
    assert multiset(simhash.near_duplicates(df).collect()) == plain_embeddings(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# ---- chosen path -------------------------------------------------------------------------------------------------


def plain_sets(rows):
    sets = {}
    for doc, text, *_ in rows:
        own = words(text)
        if doc is not None and own:
            n = min(5, len(own))
            sets[doc, text] = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
    return sets


def plain_similar(rows, threshold=0.8):
    sets, union, count = plain_sets(rows), Union(), {}
    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                union.join(a[0], b[0])
                for k in (a, b):
                    count[k[0]] = count.get(k[0], 0) + 1
    return multiset((d, None if d is None else union.find(d), count.get(d, 0), d is None or union.find(d) == d) for d, *_ in rows)


def near_copies(seed, groups=5, each=25):
    """Groups around the threshold, small to large edits, and texts that share passages without being similar."""
    draw = random.Random(seed)
    fresh = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    texts, passage = [], fresh(30)
    for _ in range(groups):
        base = fresh(draw.randint(20, 150))
        for _ in range(each):
            own = [*base]
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
            texts.append(own if draw.random() < 0.8 else own[: len(own) * 4 // 5])
    texts += [fresh(40) + passage + fresh(40) for _ in range(30)] + [fresh(60) for _ in range(40)]
    draw.shuffle(texts)
    return [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("leaf, block", [(512, 256), (8, 4)])
def test_chosen_path(spark, leaf, block):
    """Also where buckets are split over levels, dealt into leaves, and clusters are cut into blocks."""
    rows = near_copies(3)
    found = chosen_path.similar_documents(spark.createDataFrame(rows, SCHEMA), leaf=leaf, block=block)
    assert multiset(found.collect()) == plain_similar(rows)


def test_chosen_path_odd_rows(odd, empty):
    assert multiset(chosen_path.similar_documents(odd).collect()) == plain_similar(odd_documents())
    assert chosen_path.similar_documents(empty).count() == 0


def test_overlap():
    random_ = np.random.default_rng(2)
    sets = [np.unique(random_.integers(0, 300, n)).astype(np.uint64) for n in (1, 5, 50, 120, 200, 3)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3]]
    assert chosen_path._overlap(sets[:3], sets[3:]).tolist() == expected


# ---- substrings --------------------------------------------------------------------------------------------------


def plain_repeats(rows, window=13):
    firsts, out = {}, []
    for doc, text, *_ in rows:
        own = words(text)
        for i in range(len(own) - window + 1 if doc is not None else 0):
            key = tuple(own[i : i + window])
            firsts[key] = min(firsts.get(key, doc), doc)
    for doc, text, *_ in rows:
        own, gone = words(text), set()
        for i in range(len(own) - window + 1 if doc is not None else 0):
            if firsts[tuple(own[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return multiset(out)


def passages(seed):
    """Passages of all lengths around the window at any place, also overlapping, periodic and in many documents."""
    draw = random.Random(seed)
    fresh = lambda n: [f"{draw.choice('ab')}{draw.randrange(40)}" for _ in range(n)]
    shared = [fresh(n) for n in (12, 13, 14, 20, 60)] + [["la"] * 30, ["da", "di"] * 15]
    rows = []
    for i in range(120):
        parts = [draw.choice(shared) if draw.random() < 0.5 else fresh(draw.randint(1, 25)) for _ in range(draw.randint(1, 6))]
        rows.append((i * 2 % 119, " ".join(w for p in parts for w in p), "en", "s", 0))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rows = passages(seed)
    found = substrings.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert multiset(found) == plain_repeats(rows)


def test_repeats_odd_rows(odd, empty):
    found = substrings.drop_repeats(odd)
    assert multiset(found.collect()) == plain_repeats(odd_documents())
    digests = multiset((r.doc_id, r.kept_sha256) for r in substrings.digested(found).collect())
    assert digests == multiset((d, hashlib.sha256(k.encode()).hexdigest()) for d, _, _, k in plain_repeats(odd_documents()))
    assert substrings.drop_repeats(empty).count() == 0


# ---- winnowing ---------------------------------------------------------------------------------------------------


def test_winnow_guarantees():
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choice("ab ü😀") for _ in range(draw.randint(0, 80)))
        k, window = draw.choice([1, 3, 5, 8]), draw.choice([1, 2, 4, 7])
        grams = winnow.gram_hashes(text, k)
        names = {}
        if len(text) >= k:
            assert len(grams) == len(text) - k + 1
            assert all(names.setdefault(text[i : i + k], g) == g for i, g in enumerate(grams)) and len(set(names.values())) == len(names)
        expected = set()
        for i in range(len(grams) - min(window, len(grams)) + 1 if len(grams) else 0):
            part = grams[i : i + window]
            expected.add(i + max(j for j, v in enumerate(part) if v == part.min()))
        places, values = winnow.winnow(grams, window)
        assert places.tolist() == sorted(expected) and (values == grams[places]).all()


def plain_fingerprints(rows):
    rows = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (doc, text) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, last = (set(winnow.fingerprint(t)[1].tolist()) for t in (text, edited, after))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(own, other), 9), round(like(own, last), 9)))
    return multiset(out)


def fingerprint_rows(df, **kw):
    return multiset((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in winnow.edited_fingerprints(df, **kw).collect())


def test_fingerprints_odd_rows(spark, odd, empty):
    assert fingerprint_rows(odd) == plain_fingerprints(odd_documents())
    assert fingerprint_rows(odd, blocks_per_partition=1) == plain_fingerprints(odd_documents())
    assert winnow.edited_fingerprints(empty).count() == 0
    for rows in ([(5, "x")], [(None, "abc" * 20)], [(5, None), (7, "abcdefgh" * 5)], [(1, "a"), (None, "zz"), (3, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert fingerprint_rows(df) == plain_fingerprints(rows)
    names = {}
    for r in winnow.edited_fingerprints(odd).join(odd.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect():
        assert names.setdefault(r.t or "", r.fingerprint) == r.fingerprint


def test_positions(odd):
    found = winnow.positions(odd.where("doc_id = 36")).orderBy("position").collect()
    text = next(t for d, t, *_ in odd_documents() if d == 36)
    places, values = winnow.fingerprint(text)
    assert [(r.position, r.hash) for r in found] == list(zip(places.tolist(), values.view(np.int64).tolist()))


def test_word_hashes():
    """Equal words hash alike wherever they stand; words end where texts end; other white space is part of a word."""
    import pyarrow as pa

    from quire.llm.common import texts_of, word_hashes, words_of

    texts = [t for _, t, *_ in odd_documents()] + ["ab", "ab", "", "a\x1cb c d  ab", None, "\x0bab\x0c"]
    for limit in (1, 50, 1 << 21):
        names, seen = {}, 0
        for first, data, ends in texts_of(pa.array(texts).slice(0), limit):
            hashes, owner = word_hashes(data, ends)
            own = [(first + k, w) for k in range(len(ends)) for w in words_of(texts[first + k] or "")]
            assert [first + int(k) for k in owner] == [k for k, _ in own]
            assert all(names.setdefault(w, h) == h for (_, w), h in zip(own, hashes.tolist()))
            seen += len(ends)
        assert seen == len(texts) and len(set(names.values())) == len(names)


@pytest.mark.parametrize("carry", [(), ("text", "lang")])
@pytest.mark.parametrize("kind", ["long", "int"])
def test_both_passes_over_the_text_share_its_shuffle(spark, carry, kind):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id").cast(kind))
    plan = substrings.digested(substrings.drop_repeats(docs, carry=carry))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum("REPARTITION_BY_NUM" in line and "ReusedExchange" not in line for line in plan.split("\n")) == 1
