"""Resampling against a plain version with zlib, and the arrays of CRCs against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_plain import SCHEMA, multiset, odd_documents

from quire.llm import resampling

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return RUN.findall((text or "").translate(LOWER))


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, share=5, least=20):
    """Rows ``(doc_id, text)``; gives every row's result."""
    buckets = [plain_buckets(t) for _, t in docs]
    s, t = Counter(b for x in buckets for b in x), Counter(b for x in target for b in plain_buckets(x))
    total, aim = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in s}
    out = []
    for (doc, text), x in zip(docs, buckets):
        weight, score = sum(gain[b] for b in x), None
        if doc is not None:
            h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(x), weight, score, None, len(plain_words(text)) >= least and doc is not None])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_crc_arrays():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 5000).astype(np.uint8)
    lengths = np.concatenate([draw.integers(1, 12, 800), [0, 1, 700, 700, 2500]])
    starts = np.array([draw.integers(0, 5000 - n + 1) for n in lengths])
    got = resampling.crc32_slices(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    matrix = draw.integers(0, 256, (300, 17)).astype(np.uint8)
    assert resampling.crc32_rows(matrix).tolist() == [zlib.crc32(r.tobytes()) for r in matrix]


def test_buckets_of_texts():
    texts = ["", "One two THREE four", "a", "ÀÉ é\u00a0x-y_z 12,3", " \t ", "one two three four", "日本語 😀 words" * 3, "\x00a\x7fb{c}", "x" * 5000, "end"]
    data = [t.encode() for t in texts]
    bucket, text, n_words = resampling.text_buckets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    assert n_words.tolist() == [len(plain_words(t)) for t in texts]
    for k, t in enumerate(texts):
        assert sorted(bucket[text == k]) == sorted(plain_buckets(t))


def test_parts_of_a_long_text_meet(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i % 7}" for i in range(200)), "a b c d", "", "e"]
    data = [t.encode() for t in texts]
    for size in (1, 2, 7, 501, 10_000):
        monkeypatch.setattr(resampling, "WORDS", size)
        bucket, text, _ = resampling.text_buckets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
        for k, t in enumerate(texts):
            assert sorted(bucket[text == k]) == sorted(plain_buckets(t))


@pytest.mark.parametrize("share", [5, 50, 100])
def test_odd_documents(spark, odd, share):
    docs = [(r[0], r[1]) for r in odd_documents()]
    target = ["one two three", None, "", "Don't stop", "bans koti rera"]
    found = resampling.resample(odd, spark.createDataFrame([(t, 1) for t in target], "text string, score int"), share, 3)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert multiset(found.collect()) == multiset(plain_resample(docs, target, share, 3))


def test_empty_tables(spark, empty):
    aim = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, aim).collect() == []
    docs = spark.createDataFrame([(1, "x y " * 20, "en", "s", 80)], SCHEMA)
    assert multiset(resampling.resample(docs, aim.limit(0), 100).collect()) == multiset(plain_resample([(1, "x y " * 20)], [], 100))


def test_one_text_holds_a_third_of_the_rows(spark):
    docs = [(i, "the same text of quite a few words " * 4 if i % 3 == 0 else f"word{i % 11} and word{i % 5} " * 12) for i in range(300)] + [(None, "word " * 30)] * 100
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([("word1 and",)], "text string"), 20)
    assert multiset(found.collect()) == multiset(plain_resample(docs, ["word1 and"], 20))


def test_very_long_texts(spark):
    docs = [(1, "y" * 2_000_000), (2, "many words " * 300_000), (3, "short but with enough of words to be drawn " * 3)]
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("many words",)], "text string"), 100)
    assert multiset(found.collect()) == multiset(plain_resample(docs, ["many words"], 100))
