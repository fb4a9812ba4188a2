"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed text.

A word's score for a language is the log-probability of its letter trigrams, hashed into a fixed table.  Counting adds up
over all training rows; the model is ``buckets`` numbers per language, whatever the size of the corpus.  Along a text, the
best path of languages is found, where every change of language costs ``penalty``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import few, filter_texts, lean, rows

# Blocks of the Unicode standard, first and last code point.  Letters outside belong to no script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
BUCKETS = 1 << 15
CHUNK = 1 << 12
PENALTY = 12.0
# A script belongs to a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.01
_SCRIPT_STARTS = sorted((a, b, k) for k, spans in enumerate(SCRIPTS.values()) for a, b in spans)
_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """One flag per code point, made once per Python worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point, -1 for none."""
    firsts, lasts, numbers = (np.array(x) for x in zip(*_SCRIPT_STARTS))
    at = np.searchsorted(firsts, points, "right") - 1
    return np.where((at >= 0) & (points <= lasts[at]), numbers[at], -1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts with anything but letters as 0, a 0 after each text, and where each text ends."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    return np.where(is_letter()[points], points, 0), ends


def trigrams(points: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter (the space counts as a letter at word ends), and where the letters are."""
    at = np.flatnonzero(points)
    if not len(at):
        return at, at
    left = np.where(at > 0, points[np.maximum(at - 1, 0)], 0)
    h = (left * 0x1F1F1F1F + points[at] * 0x2E5BF3D1 + points[np.minimum(at + 1, len(points) - 1)] * 0x61C88647) & 0x7FFFFFFFFFFFFFFF
    return (h ^ (h >> 17) ^ (h >> 31)) % buckets, at


class Model:
    """``languages`` in order, ``scores[bucket, language]`` in natural logarithms, ``allowed[script, language]``."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        totals = counts.sum(axis=0, keepdims=True)
        self.scores = np.log((counts + 0.5) / (totals + 0.5 * len(counts))).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        allowed = share >= SCRIPT_SHARE
        allowed[~allowed.any(axis=1)] = True  # a script that no language uses narrows nothing
        self.allowed = np.vstack([allowed, np.ones((1, len(languages)), bool)])


_SUMS = pa.schema([("lang", pa.string()), ("chunk", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


@lean
def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum vectors by language and chunk over whatever rows a task has; a task holds one vector per key, not the rows."""
    sums: dict[tuple, np.ndarray] = {}
    salts: dict[tuple, int] = {}
    for batch in batches:
        for lang, chunk, salt, data in zip(*(batch.column(k) for k in range(4))):
            key = lang.as_py(), chunk.as_py()
            values = np.frombuffer(data.as_py(), "<f8")
            sums[key] = sums[key] + values if key in sums else values
            salts[key] = salt.as_py() // 64
    if sums:
        yield rows(_SUMS, lang=[k[0] for k in sums], chunk=[k[1] for k in sums], salt=[salts[k] for k in sums], counts=[v.astype("<f8").tobytes() for v in sums.values()])


def fit(labelled: DataFrame, buckets: int = BUCKETS) -> Model:
    """Learn from ``text, lang``; rows with a null text or language teach nothing.

    Tasks add up their rows to one vector per language, cut into chunks; chunks are added up over tasks in two steps.
    The driver gets ``buckets`` counts per language.  Without any row the model knows no language.
    """
    letters_chunk = -1  # the chunk number under which the letters per script travel

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in few(batches, 1024):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text.as_py())
            for lang, texts in by_lang.items():
                total = sums.setdefault(lang, np.zeros(buckets + len(SCRIPTS)))
                for part in portions(texts):
                    points, _ = code_points(part)
                    grams, at = trigrams(points, buckets)
                    total[:buckets] += np.bincount(grams, minlength=buckets)
                    own = scripts_of(points[at])
                    total[buckets:] += np.bincount(own[own >= 0], minlength=len(SCRIPTS))
        part = TaskContext.get().partitionId()
        for lang, total in sums.items():
            cuts = [*range(0, buckets, CHUNK)]
            yield rows(_SUMS, lang=[lang] * (len(cuts) + 1), chunk=[*range(len(cuts)), letters_chunk], salt=[part] * (len(cuts) + 1),
                       counts=[*[total[a : min(a + CHUNK, buckets)].tobytes() for a in cuts], total[buckets:].tobytes()])

    sums = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, chunk int, salt int, counts binary")
    for modulus in (64, 1):
        sums = sums.repartition("lang", "chunk", F.col("salt") % modulus).mapInArrow(_add_up, "lang string, chunk int, salt int, counts binary")
    found = sums.select("lang", "chunk", "counts").collect()
    languages = sorted({r[0] for r in found})
    counts, scripts = np.zeros((buckets, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    for lang, chunk, data in found:
        values, column = np.frombuffer(bytes(data), "<f8"), languages.index(lang)
        if chunk == letters_chunk:
            scripts[:, column] += values
        else:
            counts[chunk * CHUNK : chunk * CHUNK + len(values), column] += values
    return Model(languages, counts, scripts)


def portions(texts: list[str], limit: int = 250_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``limit`` characters; a longer text stands alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of all texts in a row: scores per language, number of letters; and the number of words per text."""
    points, ends = code_points(texts)
    grams, at = trigrams(points, len(model.scores))
    if not len(at):
        return np.empty((0, len(model.languages)), np.float32), at, np.zeros(len(texts), np.int64)
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    scores = np.add.reduceat(model.scores[grams], starts, axis=0)
    # Scripts by the first letter of a word; a language that does not use it is far behind.
    scores = np.where(model.allowed[scripts_of(points[at[starts]])], scores, scores.min(axis=1, keepdims=True) - 50)
    scores -= scores.max(axis=1, keepdims=True)
    per_text = np.diff(np.searchsorted(at[starts], np.append(0, ends)))
    return scores, np.diff(np.append(starts, len(at))), per_text


def best_paths(scores: np.ndarray, per_text: np.ndarray, penalty: float) -> np.ndarray:
    """Language of every word on the best path of its text; all texts advance together, word by word."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-per_text, kind="stable")
    first = (np.cumsum(per_text) - per_text)[order]
    lengths = per_text[order]
    longest = int(lengths[0]) if len(lengths) else 0
    if not longest or scores.shape[1] < 2:
        return labels
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with more than t words
    stay, came = np.ones(scores.shape, bool), np.zeros(len(scores), np.int16)
    delta = scores[first[: active[0]]].astype(np.float64)
    last = np.zeros((len(lengths), scores.shape[1]))
    for t in range(1, longest):
        a, before = active[t], active[t - 1]
        if a < before:
            last[a:before] = delta[a:]
            delta = delta[:a]
        at = first[:a] + t
        source = delta.argmax(axis=1)
        jump = delta[np.arange(a), source][:, None] - penalty
        keep = delta >= jump
        stay[at], came[at] = keep, source
        delta = np.where(keep, delta, jump) + scores[at]
    last[: len(delta)] = delta
    state = last.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        labels[at] = state[:a]
        if t:
            state[:a] = np.where(stay[at, state[:a]], state[:a], came[at])
    return labels


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.int64())])


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row.

    ``lang_pred`` is the language that most letters were labelled with (the first in order among equals), ``score`` its
    share of the letters, ``spans`` the number of runs of one language.  Null texts, texts without a letter and all texts
    under a model that knows no language give ``und``, 0 and no span.  Rows are neither dropped nor moved.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 1024):
            yield rows(_OUT, doc_id=batch.column(0), **label(shared.value, batch.column(1).to_pylist(), penalty))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans long")


def label(model: Model, texts: list[str | None], penalty: float = PENALTY, limit: int = 3_000_000) -> dict[str, list]:
    """Language, its share of the letters and the number of spans of each text; about ``limit`` characters at a time."""
    out: dict[str, list] = {"lang_pred": [], "score": [], "spans": []}
    for part in portions([t or "" for t in texts], limit):
        for name, values in _label(model, part, penalty).items():
            out[name] += values
    return out


def _label(model: Model, texts: list[str], penalty: float) -> dict[str, list]:
    n = len(model.languages)
    if not n:
        return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "spans": [0] * len(texts)}
    parts = [word_scores(model, part) for part in portions(texts)]
    scores, letters, per_text = (np.concatenate([p[k] for p in parts]) for k in range(3))
    del parts
    labels = best_paths(scores, per_text, penalty)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    votes = np.bincount(owner * n + labels, weights=letters, minlength=len(per_text) * n).reshape(-1, n)
    total = votes.sum(axis=1)
    best = votes.argmax(axis=1)
    change = np.append(True, (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])) if len(labels) else np.empty(0, bool)
    spans = np.bincount(owner[change], minlength=len(per_text))
    return {"lang_pred": [model.languages[b] if t else "und" for b, t in zip(best, total)],
            "score": (votes[np.arange(len(best)), best] / np.maximum(total, 1)).tolist(), "spans": spans.tolist()}


def accepted(docs: DataFrame, model: Model, share: float, penalty: float = PENALTY) -> DataFrame:
    """Rows whose text has a letter and at least this share of its letters in one language, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str | None]) -> list[bool]:
        found = label(shared.value, texts, penalty)
        return [p != "und" and s >= share for p, s in zip(found["lang_pred"], found["score"])]

    return filter_texts(docs, judge)
