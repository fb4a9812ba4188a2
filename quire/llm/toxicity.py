"""Toxicity by a linear classifier that is regularised with counterfactuals.

Texts that differ only in the group they mention should score alike.  For every training text with identity terms, the
terms are swapped for others of the same kind and the change of the score is penalised, so that the weight of the mention
itself, and of what merely comes with it, goes to zero while insults keep theirs.

Features of a text: its distinct lower-case words, and the first letters and the last letters of each, so that a stem is
known with endings that were never seen.  The score is a logistic of the sum over distinct words, so a whole text of any
length is scored in one pass with one remembered number per word.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import few, filter_texts, lean, rows, stored

# Groups of terms that can stand for each other; a parameter of the operator.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "natives"), ("immigrant", "native"), ("african", "european", "american"), ("blind", "deaf", "disabled"),
)
# At most so many labelled texts are fitted on, and so many features kept.  Both bound what the driver holds.
SAMPLE_ROWS = 20_000
FEATURES = 4096
MIN_TEXTS = 4
BUCKET_BITS = 22
THRESHOLD = 0.7
# Texts whose features are Python objects at a time.
FEW_TEXTS = 64
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word, its beginnings of 4 to 6 letters and its last 4 letters."""
    return [word, *["^" + word[:n] for n in (4, 5, 6) if len(word) > n], *(["$" + word[-4:]] if len(word) > 5 else [])]


def text_features(text: str) -> dict[str, int]:
    """Number of distinct words of the text that have each feature."""
    counts: dict[str, int] = defaultdict(int)
    for word in set(_WORD.findall(text.lower())):
        for feature in features_of(word):
            counts[feature] += 1
    return counts


def swapped(text: str, terms: tuple[tuple[str, ...], ...]) -> str | None:
    """The text with every identity term replaced by the next of its group; None if it has none."""
    partner = {t: g[(i + 1) % len(g)] for g in terms for i, t in enumerate(g)}
    found = False

    def change(match: re.Match) -> str:
        nonlocal found
        other = partner.get(match[0])
        found = found or other is not None
        return other or match[0]

    out = _WORD.sub(change, text.lower())
    return out if found else None


class Classifier:
    """``bias`` and a weight per feature; the logit of a text is the sum over its distinct words."""

    def __init__(self, bias: float, weights: dict[str, float], limit: int = 300_000):
        self.bias, self.weights, self.limit = bias, weights, limit
        self.words: dict[str, float] = {}

    def __getstate__(self):
        return self.bias, self.weights, self.limit

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        words, known = set(_WORD.findall((text or "").lower())), self.words
        new = words.difference(known)
        if new:
            if len(known) >= self.limit:
                known.clear()
                new = words
            for word in new:
                known[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        # math.fsum does not depend on the order of the set.
        logit = self.bias + math.fsum([known[w] for w in words])
        return 1 / (1 + math.exp(-logit)) if logit > -700 else 0.0


_SAMPLE = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("swap", pa.list_(pa.int32())), ("swap_counts", pa.list_(pa.int32()))])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
        counterfactual: float = 10.0, selection: float = 5e-3, penalty: float = 2e-5, features: int = FEATURES, min_texts: int = MIN_TEXTS) -> Classifier:
    """Learn from ``docs.text`` and ``labels.toxic``, joined by ``doc_id``.

    At most ``sample_rows`` labels take part, those with the smallest hash of ``doc_id``; null labels, ids and texts teach
    nothing, a ``doc_id`` with two different labels counts twice.  Without a label of each kind the classifier knows no
    word and scores the share of toxic labels (0 without labels).
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)  # a bounded sample, so it can be broadcast
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    @lean
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mask = (1 << BUCKET_BITS) - 1
        code = lambda f: xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) & mask
        for batch in few(batches, FEW_TEXTS):
            out: dict[str, list] = {f.name: [] for f in _SAMPLE}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = text_features(text)
                twin = swapped(text, terms)
                other = text_features(twin) if twin is not None else {}
                changed = {f: own.get(f, 0) - other.get(f, 0) for f in {*own, *other}} if twin is not None else {}
                changed = {f: n for f, n in changed.items() if n}
                for name, value in zip(out, (toxic, [code(f) for f in own], [*own.values()], [code(f) for f in changed], [*changed.values()])):
                    out[name].append(value)
            yield rows(_SAMPLE, **out)

    # One job over the texts; the sample is written so that counting and fitting read the same rows.
    sample = stored(joined.mapInArrow(extract, "toxic int, features array<int>, counts array<int>, swap array<int>, swap_counts array<int>"), "toxicity-sample")
    n, positive = sample.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    positive = positive or 0
    if positive == 0 or positive == n:
        share = positive / n if n else 0.0
        return Classifier(math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0), {})
    # The features that tell most, by a chi-squared statistic over all rows of the sample.
    seen = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p"))
    expected = F.col("n") * (positive / n)
    gain = (F.col("p") - expected) ** 2 / (expected * (1 - positive / n) * (1 - F.col("n") / n + 1e-9))
    best = [r[0] for r in seen.where(F.col("n") >= min_texts).orderBy(gain.desc(), "f").limit(features).select("f").collect()]
    swaps = [r[0] for r in sample.select(F.explode("swap").alias("f")).groupBy("f").count().orderBy(F.desc("count"), "f").limit(features).select("f").collect()]
    place = {f: i for i, f in enumerate(dict.fromkeys([*best, *swaps]))}
    y, own, twins = _collect(sample, place)
    # A strong penalty picks the features, a weak one sets their weights: few words decide, and they decide clearly.
    picked = _train(y, own, twins, len(place), counterfactual, selection)[1] != 0
    inside = [tuple(a[picked[part[1]]] for a in part) for part in (own, twins)]
    bias, weights = _train(y, *inside, len(place), counterfactual, penalty)
    return Classifier(bias, HashedWeights({f: float(weights[i]) for f, i in place.items() if weights[i]}))


def _collect(sample: DataFrame, place: dict[int, int]) -> tuple:
    """The chosen features of the bounded sample, on the driver: rows, columns and values, and the labels."""
    known = sample.sparkSession.sparkContext.broadcast(place)
    schema = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("swap_at", pa.list_(pa.int32())), ("swap_n", pa.list_(pa.int32()))])

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = known.value
        for batch in few(batches, FEW_TEXTS):
            out: dict[str, list] = {f.name: [] for f in schema}
            for toxic, f, c, sf, sc in zip(*(batch.column(k).to_pylist() for k in range(5))):
                own = [(places[a], b) for a, b in zip(f, c) if a in places]
                changed = [(places[a], b) for a, b in zip(sf, sc) if a in places]
                for name, value in zip(out, (toxic, [a for a, _ in own], [b for _, b in own], [a for a, _ in changed], [b for _, b in changed])):
                    out[name].append(value)
            yield rows(schema, **out)

    got = sample.mapInArrow(keep, "toxic int, at array<int>, n array<int>, swap_at array<int>, swap_n array<int>").collect()
    y = np.array([float(r[0] == 1) for r in got])

    def sparse(at: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(r[at]) for r in got]
        flat = lambda k, t: np.fromiter((x for r in got for x in r[k]), t, sum(sizes))
        return np.repeat(np.arange(len(got)), sizes), flat(at, np.int64), flat(n, np.float64)

    return y, sparse(1, 2), sparse(3, 4)


class HashedWeights:
    """Weights by feature, kept under the hash of the feature."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def get(self, feature: str, default: float) -> float:
        import xxhash

        return self.weights.get(xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) & ((1 << BUCKET_BITS) - 1), default)


def _train(y: np.ndarray, own: tuple, swaps: tuple, size: int, counterfactual: float, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on logistic loss + counterfactual * mean squared score change + penalty * |weights|.

    Classes weigh the same in total, so a rare class is not drowned.  Features are scaled to unit root mean square.
    """
    n = len(y)
    row, column, value = own
    scale = np.sqrt(np.bincount(column, value**2, size) / n)
    scale[scale == 0] = 1.0
    cf_row, cf_column, cf_value = swaps
    cf_scale = np.sqrt(np.bincount(cf_column, cf_value**2, size) / n)
    scale = np.maximum(scale, np.maximum(cf_scale, 1e-3))
    value = value / scale[column]
    cf_value = cf_value / scale[cf_column]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    # A safe step: the power method bounds the curvature.
    probe = np.ones(size) / math.sqrt(max(size, 1))
    lipschitz = 1.0
    for _ in range(15):
        z = np.bincount(row, value * probe[column], n) * weight * 0.25
        d = np.bincount(cf_row, cf_value * probe[cf_column], n) * (2 * counterfactual / n)
        back = np.bincount(column, value * z[row], size) + np.bincount(cf_column, cf_value * d[cf_row], size)
        lipschitz = max(float(np.linalg.norm(back)), 1e-6)
        probe = back / lipschitz
    step = 1 / (1.1 * lipschitz + 0.25)
    w, b, w_ahead, b_ahead, t = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
    for _ in range(steps):
        z = np.bincount(row, value * w_ahead[column], n) + b_ahead
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        d = np.bincount(cf_row, cf_value * w_ahead[cf_column], n) * (2 * counterfactual / n)
        gradient = np.bincount(column, value * error[row], size) + np.bincount(cf_column, cf_value * d[cf_row], size)
        new = w_ahead - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = b_ahead - step * error.sum()
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w_ahead, b_ahead = new + (t - 1) / ahead * (new - w), new_b + (t - 1) / ahead * (new_b - b)
        w, b, t = new, new_b, ahead
    return float(b), w / scale


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row; null and empty texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # bounded by the number of features

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = shared.value.score
        for batch in batches:
            found = [rate(t.as_py()) for t in batch.column(1)]
            yield rows(_OUT, doc_id=batch.column(0), score=found, predicted=[int(s >= threshold) for s in found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text scores below the threshold, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    return filter_texts(docs, lambda texts: [shared.value.score(t) < threshold for t in texts])
