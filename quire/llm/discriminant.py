"""Text quality by a regularised quadratic discriminant over statistics of a document.

A text becomes thirteen numbers: its length, how long its words and lines are, and the shares of capitals, symbols, digits,
marks, repeated words and the like, on logarithmic scales so that they look roughly normal.  Each class is a normal
distribution with a mean and a covariance of its own.  Covariances are shrunk towards a multiple of the identity, on
scales on which every statistic has variance one, since clean texts hardly vary in some of them.  The score compares the
two log densities, which need the Mahalanobis distance to each mean: the Cholesky factors are made once and kept.

Sums, and sums of products, are all that fitting needs from the corpus, so every labelled text takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mix, rows, stored, texts_of, word_hashes

THRESHOLD = 0.3
STATISTICS = ("words", "word_length", "word_spread", "capitals", "symbols", "exclamations", "digits", "marks", "lone_marks", "repeated", "distinct", "line_words", "foreign")
# Share that is added before the logarithm of a share is taken: one in a hundred counts as hardly any.
FAINT = 0.01


def _classes() -> dict[str, np.ndarray]:
    """By name, which bytes belong to a class."""
    byte = np.arange(256)
    capital, small, digit = ((byte >= a) & (byte <= b) for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39)))
    foreign = byte >= 0xC0  # the first byte of a character beyond ASCII
    mark = np.isin(byte, [ord(c) for c in ".,;:'\"()-?"])
    printable = (byte > 0x20) & (byte < 0x7F)
    return {"capital": capital, "letter": capital | small | foreign, "digit": digit, "foreign": foreign, "mark": mark, "exclamation": byte == ord("!"),
            "symbol": printable & ~(capital | small | digit | mark), "line": byte == 10, "word": ~((byte == 32) | ((byte >= 9) & (byte <= 13)))}


_CLASSES = _classes()
_SMALL = np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def statistics_of(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of statistics for each of several texts laid end to end."""
    n = len(ends)
    starts = np.append(0, ends[:-1])
    filled = np.flatnonzero(ends > starts)

    def count(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(filled):
            out[filled] = np.add.reduceat(mask, starts[filled], dtype=np.int64)
        return out

    seen = {name: count(members[data]) for name, members in _CLASSES.items()}
    # Words: where they begin and end, and how they repeat.
    inside = _CLASSES["word"][data]
    first = np.zeros(len(data), bool)
    first[starts[filled]] = True
    begin = np.flatnonzero(inside & (first | ~np.append(False, inside[:-1])))
    stop = np.flatnonzero(inside & np.append(first[1:] | ~inside[1:], True)) + 1
    text = np.searchsorted(ends, begin, "right")
    size = (stop - begin).astype(np.float64)
    words = np.bincount(text, minlength=n)
    total, squares = np.bincount(text, size, n), np.bincount(text, size**2, n)
    symbol = np.append(0, np.cumsum(_CLASSES["symbol"][data] | _CLASSES["mark"][data], dtype=np.int32))
    lone = np.bincount(text[symbol[stop] - symbol[begin] == size], minlength=n)
    hashes, _ = word_hashes(_SMALL[data], ends)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) + 1
    repeated = np.bincount(text[again], minlength=n)
    one = np.unique(mix(hashes ^ mix(text.astype(np.uint64), 3), 4), return_index=True)[1]
    distinct = np.bincount(text[one], minlength=n)
    per = np.maximum(words, 1)
    mean = total / per
    spread = np.sqrt(np.maximum(squares / per - mean**2, 0))
    share = lambda x, of: np.log(x / np.maximum(of, 1) + FAINT)
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log(spread + 0.5), share(seen["capital"], seen["letter"]), share(seen["symbol"], words), share(seen["exclamation"], words),
        share(seen["digit"], ends - starts), share(seen["mark"], words), share(lone, words), share(repeated, words), np.log1p(distinct) / np.log1p(per), np.log1p(words / (seen["line"] + 1)),
        share(seen["foreign"], seen["letter"]),
    ])


_ROW = pa.schema([("doc_id", pa.int64()), ("statistics", pa.list_(pa.float64()))])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, statistics`` of every row, over whole texts; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, ends in texts_of(batch.column(1)):
                found = statistics_of(data, ends)
                lists = pa.ListArray.from_arrays(np.arange(len(ends) + 1, dtype=np.int32) * len(STATISTICS), found.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends)), lists], schema=_ROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, statistics array<double>")


class Discriminant:
    """Class means and covariances, given as counts, sums and sums of products of the statistics of each class.

    ``shrinkage`` is the part of a covariance that is replaced by the identity times the mean variance.  A class without
    rows leaves no density to compare: then every score is the share of label 1, one half without any labels.
    """

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float):
        self.share = counts[1] / counts.sum() if counts.sum() else 0.5
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        if counts.min() == 0:
            return
        p, n = len(sums[0]), counts.sum()
        centre = sums.sum(axis=0) / n
        variance = np.diag(products.sum(axis=0)) / n - centre**2
        self.centre, self.scale = centre, np.sqrt(np.maximum(variance, 1e-6))
        for k in (0, 1):
            mean = sums[k] / counts[k]
            covariance = (products[k] / counts[k] - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            level = max(np.trace(covariance) / p, 1e-3)
            covariance = (1 - shrinkage) * covariance + shrinkage * level * np.eye(p)
            factor = np.linalg.cholesky(covariance)
            # A density needs the factor's inverse and its diagonal only.
            rest = np.log(counts[k] / n) - np.log(np.diag(factor)).sum()
            self.classes.append(((mean - centre) / self.scale, np.linalg.inv(factor), float(rest)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of statistics."""
        if not self.classes:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        low, high = (rest - (((z - mean) @ inverse.T) ** 2).sum(axis=1) / 2 for mean, inverse, rest in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


_SUMS = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def fit(found: DataFrame, labels: DataFrame, shrinkage: float = 0.05) -> Discriminant:
    """Learn from all rows of ``found`` (``statistics``) that ``labels.quality`` knows by ``doc_id``.

    Null labels and ids teach nothing, labels other than 1 count as 0; repeated rows count as often as they occur, a repeated label once.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("label")).distinct()
    p = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = np.zeros(2, np.int64), np.zeros((2, p)), np.zeros((2, p, p))
        for batch in batches:
            label, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for k in (0, 1):
                part = x[label == k]
                n[k] += len(part)
                sums[k] += part.sum(axis=0)
                products[k] += part.T @ part
        yield rows(_SUMS, label=[0, 1], n=n, sums=sums.tolist(), products=products.reshape(2, p * p).tolist())

    # One pair of rows per task, of a size that depends on the number of statistics only.
    parts = found.join(known, "doc_id").select("label", "statistics").mapInArrow(run, "label int, n long, sums array<double>, products array<double>")
    add = lambda c, size: F.array(*[F.sum(F.col(c)[i]) for i in range(size)]).alias(c)
    n, sums, products = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for row in parts.groupBy("label").agg(F.sum("n").alias("n"), add("sums", p), add("products", p * p)).collect():
        n[row["label"]], sums[row["label"]], products[row["label"]] = row["n"], row["sums"], np.reshape(row["products"], (p, p))
    return Discriminant(n, sums, products, shrinkage)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(found: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row of statistics."""
    shared = found.sparkSession.sparkContext.broadcast(model)  # two small matrices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.score(_matrix(batch.column(1)))
            yield rows(_OUT, doc_id=batch.column(0), score=values, predicted=(values >= threshold).astype(np.int32))

    return found.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, shrinkage: float = 0.05) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``, learned from all of ``labels``.

    Null, empty and blank texts get the score of a text without words; a row without ``doc_id`` is scored like any other.
    Equal texts score alike.  Other columns are ignored.
    """
    found = stored(statistics(docs), "quality-statistics")  # the texts are read once, for learning and for scoring
    return score(found, fit(found, labels, shrinkage), threshold)
