"""The quality classifier against plain statistics and densities, and on held-out labels."""

import math
import zlib

import numpy as np
import pyarrow as pa
from llm_plain import FOLDER, odd_documents, words

from quire.llm import discriminant
from quire.llm.common import table, texts_of
from quire.llm.queries import QUERIES


def plain_statistics(text):
    text = text or ""
    data, w = text.encode(), words(text)
    sizes = [len(x.encode()) for x in w]
    n, per = len(w), max(len(w), 1)
    letters = sum(chr(b).isalpha() and b < 128 or b >= 0xC0 for b in data)
    marks = ".,;:'\"()-?"
    other = [chr(b) for b in data if 0x20 < b < 0x7F and not chr(b).isalnum() and chr(b) not in marks]
    mean = sum(sizes) / per
    spread = math.sqrt(max(sum(s * s for s in sizes) / per - mean**2, 0))
    small = ["".join(c.lower() if c.isascii() else c for c in x) for x in w]
    share = lambda x, of: math.log(x / max(of, 1) + 0.01)
    return [
        math.log1p(n), math.log1p(mean), math.log(spread + 0.5), share(sum(0x41 <= b <= 0x5A for b in data), letters), share(len(other), n), share(text.count("!"), n),
        share(sum(0x30 <= b <= 0x39 for b in data), len(data)), share(sum(text.count(m) for m in marks), n),
        share(sum(all(0x20 < ord(c) < 0x7F and not c.isalnum() for c in x) for x in w), n), share(sum(a == b for a, b in zip(small, small[1:])), n),
        math.log1p(len(set(small))) / math.log1p(per), math.log1p(n / (text.count("\n") + 1)), share(sum(b >= 0xC0 for b in data), letters),
    ]


def found_of(texts):
    return np.concatenate([discriminant.statistics_of(d, e) for _, d, e in texts_of(pa.array(texts, pa.string()), 2000)])


def plain_scores(x, y, asked, shrinkage):
    """Densities with inverse and determinant of the covariances."""
    scale = np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    logs = []
    for k in (0, 1):
        own = x[y == k] / scale
        mean, cov = own.mean(axis=0), np.cov(own.T, bias=True)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        d = asked / scale - mean
        logs.append(math.log(len(own) / len(x)) - np.linalg.slogdet(cov)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) / 2)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_statistics_of_odd_texts():
    texts = [r[1] for r in odd_documents()] + ["SHOUTING!! AT!! YOU", "a | b | c", "so so SO so\nnot", "### && x#", "7 8 9 10", "\x00\x01", "é"]
    assert np.allclose(found_of(texts), [plain_statistics(t) for t in texts], rtol=1e-9)


def test_scores_equal_plain_densities(spark, odd):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    held = docs.collect()
    labels = [(r[0], int(len(r[1] or "") > 60)) for r in held] + [(None, 1), (held[0][0], None), (10**9, 0)]
    frame = spark.createDataFrame(labels + labels[:4], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in discriminant.quality(odd, frame, 0.3, 0.2).collect() if r["doc_id"] is not None}
    seen = odd.where("doc_id IS NOT NULL").select("doc_id", "text").collect()  # repeated rows count as often as they occur
    x, y = np.array([plain_statistics(r[1]) for r in seen]), np.array([dict(labels[: len(held)])[r[0]] for r in seen])
    asked = np.array([plain_statistics(r[1]) for r in held])
    want = plain_scores(x, y, asked, 0.2)
    assert np.allclose([got[r[0]]["score"] for r in held], want, atol=1e-6)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_every_row_gets_a_score(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (6, 0), (9, 1), (12, 0)], "doc_id long, quality int")
    out = discriminant.quality(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (0, 3)}) == 1  # null and empty
    assert discriminant.quality(empty, labels).collect() == []


def test_missing_classes(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in discriminant.quality(odd, none).collect()} == {0.5}
    ones = spark.createDataFrame([(3, 1), (6, 1)], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in discriminant.quality(odd, ones).collect()} == {(1.0, 1)}


def test_very_long_texts(spark):
    texts = ["y" * 1_000_000, "many words " * 200_000, "WORD!! " * 1000]
    docs = spark.createDataFrame([*enumerate(texts), (3, "a b"), (4, "C!! D!!")], "doc_id long, text string")
    assert discriminant.quality(docs, spark.createDataFrame([(0, 1), (1, 1), (3, 1), (2, 0), (4, 0)], "doc_id long, quality int")).count() == 5
    assert np.allclose(found_of(texts), [plain_statistics(t) for t in texts])


def test_held_out_labels(spark):
    folder = FOLDER.replace("0.001", "0.01")
    got = QUERIES["op11_quality"](spark, folder)
    assert sorted(got.columns) == ["doc_id", "held_out", "predicted", "score"]
    rows = got.join(table(spark, folder, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) >= 0.95
    assert np.mean([1 - r["predicted"] for r in held if r["quality"] == 0]) >= 0.9
