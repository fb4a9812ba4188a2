"""Log-likelihood of whole documents under a gated recurrent language model in numpy.

Words are lower-cased (A-Z) runs of non-space; an end token closes a document.  Each token belongs to a class.  The
``HEAD`` most frequent ones are grouped by frequency, and the network scores the words inside such a class; all others
fall into ``TAIL`` classes by their last letters, inside which a word has its relative frequency.  So

    P(token) = P(class | state) * P(token | class, state)

sums to one over the known words and one unknown word per tail class.  Before training this is the unigram model.

Counts cover every training document: a distributed count of every word, joined to the rare words of every document.
The network learns every token of every training document once, by truncated backpropagation in parallel tasks whose
weights are averaged after every round.  A document is cut into segments over whose windows the state is carried; the
segments are dealt over the tasks and the rounds.  Scoring carries the state over the windows of a document from its first
to its last token.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import few, lean, rows, stored

HEAD = 1024
CLASS = 32
TAIL = 64
HIDDEN = 16
WINDOW = 16
SEGMENT = 64  # windows per training segment at most, the state is carried over them
ROUNDS = 3  # each learns from its share of the segments
BATCH = 128
RATE = 0.05
# Words whose counts every task knows; a bounded broadcast.  Longer words are never in it.
KNOWN = 400_000
KNOWN_LENGTH = 64
SCORE_WINDOW = 32
SCORE_ROWS = 768
# No word holds a space, so this cannot be one.
END = b" "


def words_by_text(column: pa.Array, limit: int = 1 << 24) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """The words of the texts of a column, A to Z lower-cased, without the end tokens, in slices of about ``limit`` bytes of text.

    Of each slice the number of its first text, how many words each text has, and the words; null has none.  Arrow's ASCII
    white space is just the space and TAB to CR.
    """
    column = column.fill_null("")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + limit, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(first, last - first)))
        lengths, words = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().cast(pa.string())
        real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # spaces around a text leave empty words
        if not real.all():
            lengths, words = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths)), words.filter(pa.array(real))
        yield first, lengths, words
        first = last


def tail_class(word: bytes) -> int:
    """Class of a word outside the head, by its last letters."""
    letters = [c for c in word.decode("utf-8", "replace") if c.isalpha()]
    return zlib.crc32("".join(letters[-3:]).encode()) % TAIL


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of every word of a column; a regular expression finds the letters of ASCII words."""
    out = np.empty(len(words), np.int32)
    plain = pc.string_is_ascii(words)
    other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    out[other] = [tail_class(w) for w in words.take(pa.array(other)).cast(pa.binary()).to_pylist()]
    if len(other) < len(words):
        ends = pc.utf8_slice_codeunits(pc.replace_substring_regex(words.filter(plain), "[^A-Za-z]+", ""), -3).dictionary_encode()
        classes = np.array([tail_class(w) for w in ends.dictionary.cast(pa.binary()).to_pylist()], np.int32)
        out[plain.to_numpy(zero_copy_only=False)] = classes[ends.indices.to_numpy()]
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n, tail`` over all rows; the end token counts once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            for _, _, words in words_by_text(batch.column(0)):
                found = words.value_counts()
                yield rows(schema, word=found.field(0), n=found.field(1))
            yield rows(schema, word=[END.decode()], n=[batch.num_rows])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("tail", pa.int32())])
        for batch in batches:
            yield rows(schema, word=batch.column(0), n=batch.column(1), tail=tail_classes(batch.column(0)))

    total = texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    return total.mapInArrow(classify, "word string, n long, tail int")


class Counts:
    """What tasks know of the corpus: ``total`` tokens, ``distinct`` ones, and the frequent words with their counts."""

    def __init__(self, total: int, distinct: int, words: list[bytes], counts: np.ndarray, tails: np.ndarray, tail_totals: np.ndarray, tail_words: np.ndarray):
        self.total, self.distinct = total, distinct
        self.words = pa.array(words, pa.binary()).cast(pa.string())
        self.logs = np.log10(counts + 1.0)
        # The id that the network sees: a head word's place, or HEAD + tail class.
        ids = np.arange(len(words), dtype=np.int32)
        self.ids = np.where(ids < HEAD, ids, HEAD + tails).astype(np.int32)
        self.head = counts[:HEAD].astype(np.float64)
        self.tail_totals, self.tail_words = tail_totals, tail_words

    @cached_property
    def index(self) -> dict[bytes, int]:
        """Place of each frequent word; tasks look up whole columns in ``words`` instead."""
        return {w: i for i, w in enumerate(self.words.cast(pa.binary()).to_pylist())}


def gather_counts(table: DataFrame, known: int = KNOWN) -> Counts:
    """Totals, and the most frequent words as whole steps of an eighth of a power of two in count, at most ``known``."""
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("n") * 8).cast("int")
    short = table.where(F.length("word") <= KNOWN_LENGTH)
    sizes = sorted(((r[0], r[1]) for r in short.groupBy(step.alias("s")).count().collect()), reverse=True)  # at most 8 * 63 rows
    least, seen = None, 0
    for s, n in sizes:
        if seen + n > known:
            break
        least, seen = s, seen + n
    frequent = short.where(step >= least).toArrow() if least is not None else None
    if frequent is None or not frequent.num_rows:
        words, counts, tails = [], np.zeros(0), np.zeros(0, np.int64)
    else:
        words, counts, tails = frequent.column("word").cast(pa.binary()).to_pylist(), frequent.column("n").to_numpy(), frequent.column("tail").to_numpy()
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        words, counts, tails = [words[i] for i in order], counts[order], tails[order]
    tail_totals, tail_words = np.zeros(TAIL), np.zeros(TAIL)
    for tail, n, k in table.groupBy("tail").agg(F.sum("n"), F.count(F.lit(1))).collect():
        tail_totals[tail], tail_words[tail] = n, k
    np.subtract.at(tail_totals, tails[:HEAD], counts[:HEAD])
    np.subtract.at(tail_words, tails[:HEAD], 1)
    return Counts(total, distinct, words, counts, tails, tail_totals, tail_words)


# The arrays of the network, in the order in which they are laid out in one vector.
CLASSES = HEAD // CLASS + TAIL
SHAPES = {"x": (HEAD + TAIL + 1, 3 * HIDDEN), "u": (HIDDEN, 2 * HIDDEN), "v": (HIDDEN, HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (HEAD, HIDDEN), "wb": (HEAD,)}
SIZE = sum(math.prod(s) for s in SHAPES.values())


def unpack(vector: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = math.prod(shape)
        out[name] = vector[at : at + size].reshape(shape)
        at += size
    return out


def start_vector(counts: Counts, seed: int = 5) -> np.ndarray:
    """Small random weights, and biases that make the untrained network the unigram model."""
    random = np.random.default_rng(seed)
    vector = np.zeros(SIZE, np.float32)
    net = unpack(vector)
    for name, scale in (("x", 0.5), ("u", 0.3), ("v", 0.3), ("c", 0.1), ("w", 0.1)):
        net[name][...] = random.standard_normal(SHAPES[name]) * scale
    net["x"][:, :HIDDEN] += 2.0  # gates start out keeping most of the state
    head = np.zeros(HEAD)
    head[: len(counts.head)] = counts.head
    net["cb"][: HEAD // CLASS] = np.log(head.reshape(-1, CLASS).sum(axis=1) + 0.5)
    net["cb"][HEAD // CLASS :] = np.log(counts.tail_totals + 1)
    net["wb"][...] = np.where(head > 0, np.log(np.maximum(head, 1)), -30.0)
    return vector


def advance(net: dict[str, np.ndarray], state: np.ndarray, ids: np.ndarray, trace: bool = True) -> tuple[np.ndarray, tuple]:
    """States before each token of a window (time, row, hidden) and after it; ``ids`` are the tokens before each one.

    With ``trace`` also what backpropagation needs: gates and new values of all steps.  In memory the rows of a window lie
    last, (time, hidden, row), so that each operation of a step runs over one piece of memory.
    """
    batch, time = ids.shape
    states = np.empty((time + 1, HIDDEN, batch), state.dtype)
    states[0] = state.T
    inputs = np.ascontiguousarray(net["x"][ids.T].transpose(0, 2, 1))
    gate_weights, new_weights = -net["u"].T, np.ascontiguousarray(net["v"].T)
    np.negative(inputs[:, : 2 * HIDDEN], out=inputs[:, : 2 * HIDDEN])
    # The steps write over the inputs: gates (what to keep, what to reset) and new values.
    with np.errstate(over="ignore"):  # a gate far below zero is zero
        for t in range(time):
            now, after, gates, new = states[t], states[t + 1], inputs[t, : 2 * HIDDEN], inputs[t, 2 * HIDDEN :]
            gates += gate_weights @ now
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new += new_weights @ (gates[HIDDEN:] * now)
            np.tanh(new, out=new)
            np.subtract(now, new, out=after)
            after *= gates[:HIDDEN]
            after += new
    kept = (inputs[:, :HIDDEN], inputs[:, HIDDEN : 2 * HIDDEN], inputs[:, 2 * HIDDEN :]) if trace else ()
    return states.transpose(0, 2, 1), kept


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // CLASS, ids - HEAD + HEAD // CLASS)


def by_class(flat: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Tokens in order of their class, head classes first: their places, classes, where each head class begins, and their columns of ``flat``."""
    wanted = class_of(ids).astype(np.uint8)
    order = np.argsort(wanted, kind="stable")
    wanted = wanted[order]
    return order, wanted, np.searchsorted(wanted, np.arange(HEAD // CLASS + 1)).tolist(), flat.take(order, axis=1)


def columns(states: np.ndarray) -> np.ndarray:
    """States (time, row, hidden) that lie as ``advance`` leaves them, as columns above a row of ones, which the biases are weights of."""
    time, batch, _ = states.shape
    flat = np.empty((HIDDEN + 1, time, batch), states.dtype)
    flat[:HIDDEN], flat[HIDDEN] = states.transpose(2, 0, 1), 1
    return flat.reshape(HIDDEN + 1, time * batch)


def head_weights(net: dict[str, np.ndarray]) -> np.ndarray:
    """Weights and biases of the words of each head class."""
    return np.concatenate([net["w"], net["wb"][:, None]], axis=1).reshape(HEAD // CLASS, CLASS, HIDDEN + 1)


def head_scores(weights: np.ndarray, flat: np.ndarray, limits: list[int]) -> np.ndarray:
    """Scores of the words of each head token's class, a column each; the largest is zero."""
    scores = np.empty((CLASS, limits[-1]), flat.dtype)
    for k, (a, b) in enumerate(zip(limits, limits[1:])):
        if a < b:
            np.matmul(weights[k], flat[:, a:b], out=scores[:, a:b])
    scores -= scores.max(axis=0)
    return scores


def token_logs(net: dict[str, np.ndarray], states: np.ndarray, ids: np.ndarray, size: int = 4096) -> np.ndarray:
    """Natural logarithm of P(class | state), and of P(word | class, state) for head words, per row of ``states``."""
    return column_logs(net, columns(states[None]), ids, size)


def column_logs(net: dict[str, np.ndarray], flat: np.ndarray, ids: np.ndarray, size: int = 4096) -> np.ndarray:
    """``token_logs`` of states that are columns, as ``columns`` gives them.

    Taken ``size`` tokens at a time, whose scores stay in the cache.
    """
    weights, words = np.concatenate([net["c"], net["cb"][None, :]]).T, head_weights(net)
    out = np.empty(len(ids), flat.dtype)
    for at in range(0, len(ids), size):
        own = ids[at : at + size]
        order, wanted, limits, part = by_class(flat[:, at : at + size], own)
        scores = weights @ part
        scores -= scores.max(axis=0)
        logs = scores[wanted, np.arange(len(own))]
        logs -= np.log(np.exp(scores, out=scores).sum(axis=0))
        head = order[: limits[-1]]
        scores = head_scores(words, part, limits)
        logs[: len(head)] += scores[own[head] % CLASS, np.arange(len(head))]
        logs[: len(head)] -= np.log(np.exp(scores, out=scores).sum(axis=0))
        out[at + order] = logs
    return out


def gradients(net: dict[str, np.ndarray], state: np.ndarray, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss, gradient and last state of one window; the gradient stops at the window's first state."""
    states, (keep, reset, new) = advance(net, state, inputs)
    time, batch = inputs.shape[1], len(inputs)
    ids, share = targets.T.ravel(), weight.T.ravel() / weight.dtype.type(max(weight.sum(), 1))
    vector = np.zeros(SIZE, np.float32)
    grad = unpack(vector)
    order, wanted, limits, flat = by_class(columns(states[1:]), ids)
    share, place = share[order], (wanted, np.arange(len(ids)))
    error = np.concatenate([net["c"], net["cb"][None, :]]).T @ flat
    error -= error.max(axis=0)
    logs = error[place]
    total = np.exp(error, out=error).sum(axis=0)
    loss = -((logs - np.log(total)) * share).sum()
    error *= share / total
    error[place] -= share
    both = error @ flat.T
    grad["c"][...], grad["cb"][...] = both[:, :HIDDEN].T, both[:, HIDDEN]
    back = np.empty((HIDDEN, len(ids)), error.dtype)
    size = len(ids) if len(ids) % 512 else 512  # BLAS is faster at pieces that stay in the cache; odd ones would be rounded otherwise
    for at in range(0, len(ids), size):
        np.matmul(net["c"], error[:, at : at + size], out=back[:, at : at + size])
    head = order[: limits[-1]]
    share, place, weights = share[: len(head)], (ids[head] % CLASS, np.arange(len(head))), head_weights(net)
    error = head_scores(weights, flat, limits)
    logs = error[place]
    total = np.exp(error, out=error).sum(axis=0)
    loss -= ((logs - np.log(total)) * share).sum()
    error *= share / total
    error[place] -= share
    both, words, through = np.zeros_like(weights), weights[:, :, :HIDDEN].transpose(0, 2, 1), np.empty((HIDDEN, len(head)), error.dtype)
    for k, (a, b) in enumerate(zip(limits, limits[1:])):
        if a < b:
            own = error[:, a:b]
            through[:, a:b] = words[k] @ own
            np.matmul(own, flat[:, a:b].T, out=both[k])
    back[:, : len(head)] += through
    both = both.reshape(HEAD, HIDDEN + 1)
    grad["w"][...], grad["wb"][...] = both[:, :HIDDEN], both[:, HIDDEN]
    rows_back = np.empty((len(ids), HIDDEN), back.dtype)
    rows_back[order] = back.T
    back = np.ascontiguousarray(rows_back.reshape(time, batch, HIDDEN).transpose(0, 2, 1))
    before = states[:-1].transpose(0, 2, 1)
    # How the new value, what to keep and what to reset follow from a state, for all steps at once.
    renew, reset_state = 1 - keep, before * reset
    by_new, by_keep, by_reset = renew * (1 - new * new), (before - new) * keep * renew, reset_state * (1 - reset)
    d_inputs = np.empty((time, 3 * HIDDEN, batch), np.float32)
    ahead = np.zeros_like(back[0])
    for t in range(time - 1, -1, -1):
        d, d_gates, d_new = back[t], d_inputs[t, : 2 * HIDDEN], d_inputs[t, 2 * HIDDEN :]
        d += ahead
        np.multiply(d, by_new[t], out=d_new)
        np.multiply(d, by_keep[t], out=d_gates[:HIDDEN])
        through = net["v"] @ d_new
        np.multiply(through, by_reset[t], out=d_gates[HIDDEN:])
        ahead = net["u"] @ d_gates
        d *= keep[t]
        ahead += d
        through *= reset[t]
        ahead += through
    grad["v"][...] = (reset_state @ d_inputs[:, 2 * HIDDEN :].transpose(0, 2, 1)).sum(axis=0)
    grad["u"][...] = (before @ d_inputs[:, : 2 * HIDDEN].transpose(0, 2, 1)).sum(axis=0)
    used = inputs.T.ravel().astype(np.int16)  # NumPy sorts short integers by radix
    order = np.argsort(used, kind="stable")
    used = used[order]
    starts = np.flatnonzero(np.append(True, used[1:] != used[:-1]))
    grad["x"][used[starts]] = np.add.reduceat(d_inputs.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN).take(order, axis=0), starts, axis=0)
    return float(loss), vector, states[-1]


def cut_segments(ids: np.ndarray, length: int = WINDOW * SEGMENT) -> list[np.ndarray]:
    """All tokens of a document in runs of at most ``length``, each behind the token before it (-1: the document's start)."""
    whole = np.concatenate([np.full(1, -1, np.int16), ids.astype(np.int16)])
    return [whole[a : a + length + 1] for a in range(0, len(ids), length)]


def train(vector: np.ndarray, segments: list[np.ndarray], rate: float = RATE) -> np.ndarray:
    """One pass of Adam over segments as ``cut_segments`` gives them, windows in order with the state carried on.

    Segments of like length are learned together, so that few rows of a window lie behind the end of theirs.
    """
    vector, first, second, step = vector.copy(), np.zeros_like(vector), np.zeros_like(vector), 0
    order = np.argsort([-len(s) for s in segments], kind="stable")
    batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
    for k in np.random.default_rng(len(batches)).permutation(len(batches)):
        part = [segments[i] for i in batches[k]]
        own = np.array([len(s) - 1 for s in part])
        tokens = np.full((len(part), int(own[0]) + 1), -1, np.int64)
        for row, s in zip(tokens, part):
            row[: len(s)] = s
        state = np.zeros((len(part), HIDDEN), np.float32)
        for t in range(0, int(own[0]), WINDOW):
            active = int(np.searchsorted(-own, -t, "left"))
            inputs, targets = tokens[:active, t : t + WINDOW], tokens[:active, t + 1 : t + 1 + WINDOW]
            weight = (t + np.arange(targets.shape[1])[None, :] < own[:active, None]).astype(np.float32)
            _, grad, state = gradients(unpack(vector), state[:active], inputs[:, : targets.shape[1]], np.maximum(targets, 0), weight)
            step += 1
            grad *= min(1.0, 1.0 / max(math.sqrt(grad @ grad), 1e-9))
            # The sums lack the factors 0.1 and 0.01 of Adam's means, which the last lines make up for.
            first *= 0.9
            first += grad
            second *= 0.99
            grad *= grad
            second += grad
            np.sqrt(second, out=grad)
            pace = rate * 0.1 / (1 - 0.9**step)
            grad *= math.sqrt(0.01 / (1 - 0.99**step)) / pace
            grad += 1e-8 / pace
            vector -= np.divide(first, grad, out=grad)
    return vector


def token_ids(counts: Counts, lengths: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Place among the frequent words (-1: not one of them) and network id of every token of texts that have so many words each.

    An end token follows each text.  Third come the tokens that are not frequent words.
    """
    words = pa.concat_arrays([words, pa.array([END.decode()])])
    place = pc.index_in(words, value_set=counts.words).fill_null(-1).to_numpy().astype(np.int64)
    ids = counts.ids[place] if len(counts.ids) else np.zeros(len(words), np.int32)
    rare = np.flatnonzero(place < 0)
    if len(rare):
        some = words.take(pa.array(rare)).dictionary_encode()
        ids[rare] = HEAD + tail_classes(some.dictionary)[some.indices.to_numpy()]
    source = np.insert(np.arange(len(words) - 1), np.cumsum(lengths), len(words) - 1)
    place, ids = place[source], ids[source]
    return place, ids, words.take(pa.array(source[place < 0]))


_ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("learned", pa.bool_()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()),
                      ("score", pa.float64()), ("ids", pa.binary()), ("rare", pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())])))])


def encode(texts: DataFrame, counts: Counts) -> DataFrame:
    """Per row of ``doc_id, text, learned`` its network ids (int16), all that needs neither the network nor a rare word's count, and its rare words.

    ``first`` is the crc32 of the text, ``known`` and ``logs`` are of its frequent words, ``score`` is the share of the words
    inside the tail classes; ``rare`` has each rare word once, with how often it is there.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, seen = shared.value, TaskContext.get().partitionId() << 40, 0
        spread = np.log10(known.tail_totals + known.tail_words + 1)
        for batch in batches:
            for first, lengths, words in words_by_text(batch.column(1), 1 << 23):
                place, ids, rare = token_ids(known, lengths, words)
                n, found, tail = len(lengths), place >= 0, ids >= HEAD
                owner = np.repeat(np.arange(n), lengths + 1)
                logs = np.zeros(len(ids))
                logs[found] = known.logs[place[found]]
                # Tail words: log10 of (count + 1) / (tokens + words of the class + 1); the counts of rare ones come later.
                score = np.bincount(owner[tail], weights=logs[tail] - spread[ids[tail] - HEAD], minlength=n)
                ends = np.append(0, np.cumsum(lengths + 1)).astype(np.int32)
                some = rare.dictionary_encode()
                pairs, times = np.unique(owner[~found] * max(len(some.dictionary), 1) + some.indices.to_numpy(), return_counts=True)
                holder, which = np.divmod(pairs, max(len(some.dictionary), 1))
                entries = pa.StructArray.from_arrays([some.dictionary.take(pa.array(which)), pa.array(times, pa.int64())], names=["word", "k"])
                limits = np.searchsorted(holder, np.arange(n + 1)).astype(np.int32)
                yield rows(
                    _ENCODED, row=base + seen + np.arange(n), doc_id=batch.column(0).slice(first, n), learned=batch.column(2).slice(first, n),
                    first=[zlib.crc32(text.as_buffer() or b"") for text in batch.column(1).slice(first, n)], n_tokens=lengths + 1, known=np.bincount(owner[found], minlength=n),
                    logs=np.bincount(owner, weights=logs, minlength=n), score=score,
                    ids=pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends * 2), pa.py_buffer(ids.astype(np.int16))]),
                    rare=pa.ListArray.from_arrays(pa.array(limits), entries),
                )
                seen += n

    return texts.mapInArrow(run, "row long, doc_id long, learned boolean, first long, n_tokens long, known long, logs double, score double, ids binary, rare array<struct<word: string, k: long>>")


def fit(texts: DataFrame, counts: Counts, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over every token of every text in ``rounds`` parts, each averaged over the tasks by tokens."""
    return fit_encoded(encode(texts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("learned")), counts), counts, rounds)


def fit_encoded(encoded: DataFrame, counts: Counts, rounds: int = ROUNDS) -> np.ndarray:
    """``fit`` on what ``encode`` gives."""
    spark = encoded.sparkSession
    schema = pa.schema([("round", pa.int32()), ("ids", pa.binary())])

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 2048):
            parts, out = [], []
            for first, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, segment in enumerate(cut_segments(np.frombuffer(ids.as_buffer(), np.int16))):
                    parts.append((first + k) % max(rounds, 1))
                    out.append(segment.tobytes())
            yield rows(schema, round=parts, ids=out)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = stored(encoded.select("first", "ids").mapInArrow(cut, "round int, ids binary").repartition(tasks), "segments")
    vector = start_vector(counts)
    size = 4096
    sums_schema = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("weight", pa.float64()), ("values", pa.binary())])
    sums_type = "chunk int, part int, weight double, values binary"
    for part_of in range(rounds):
        now = spark.sparkContext.broadcast(vector)

        def learn(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, tokens_seen = now.value, 0
            for batch in batches:
                if batch.num_rows:
                    data = [np.frombuffer(s, np.int16) for s in batch.column(0).to_pylist()]
                    own, tokens_seen = train(own, data), tokens_seen + sum(len(s) - 1 for s in data)
            if tokens_seen:
                part = TaskContext.get().partitionId()
                cuts = range(0, len(own), size)
                yield rows(sums_schema, chunk=[*range(len(cuts))], part=[part] * len(cuts), weight=[float(tokens_seen)] * len(cuts),
                           values=[(own[a : a + size].astype(np.float64) * tokens_seen).tobytes() for a in cuts])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for chunk, part, weight, values in zip(*(batch.column(k) for k in range(4))):
                    values = np.frombuffer(values.as_py(), np.float64)
                    held = sums.setdefault(chunk.as_py(), [part.as_py() // 64, 0.0, np.zeros(len(values))])
                    held[1] += weight.as_py()
                    held[2] = held[2] + values
            if sums:
                yield rows(sums_schema, chunk=[*sums], part=[h[0] for h in sums.values()], weight=[h[1] for h in sums.values()], values=[h[2].tobytes() for h in sums.values()])

        learned = segments.where(F.col("round") == part_of).select("ids").mapInArrow(learn, sums_type)
        for modulus in (64, 1):
            learned = learned.repartition("chunk", F.col("part") % modulus).mapInArrow(add_up, sums_type)
        totals = [(r.chunk, r.weight, np.frombuffer(bytes(r["values"]), np.float64)) for r in learned.collect()]  # the size of the network
        if not totals:
            continue
        new = vector.astype(np.float64)
        seen: dict[int, float] = {}
        for chunk, weight, values in totals:
            at = slice(chunk * size, chunk * size + len(values))
            new[at] = values if chunk not in seen else new[at] + values
            seen[chunk] = seen.get(chunk, 0.0) + weight
        for chunk, weight in seen.items():
            new[chunk * size : (chunk + 1) * size] /= weight
        vector = new.astype(np.float32)
        now.unpersist()
    return vector


def document_logs(net: dict[str, np.ndarray], documents: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of the classes, and of head words inside them, summed over each document (ids, in order)."""
    out = np.zeros(len(documents))
    lengths = np.array([len(d) for d in documents], np.int64)
    tokens, first = np.concatenate([*documents, np.empty(0, np.int64)]).astype(np.int64), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    for a in range(0, len(order), SCORE_ROWS):
        at = order[a : a + SCORE_ROWS]
        own = lengths[at]
        state = np.zeros((len(at), HIDDEN), np.float32)
        last = np.full(len(at), -1, np.int64)
        for t in range(0, int(own[0]) if len(own) else 0, SCORE_WINDOW):
            active = int(np.searchsorted(-own, -t, "left"))
            width = min(SCORE_WINDOW, int(own[0]) - t)
            inside = t + np.arange(width)[None, :] < own[:active, None]
            ids = np.zeros((active, width), np.int64)
            ids[inside] = tokens[(first[at[:active], None] + t + np.arange(width)[None, :])[inside]]
            inputs = np.concatenate([last[:active, None], ids[:, :-1]], axis=1)
            states, _ = advance(net, state[:active], inputs, trace=False)
            flat, own_ids, owner = columns(states[1:]), ids.T.ravel(), np.tile(at[:active], width)
            if not inside.all():
                valid = np.flatnonzero(inside.T.ravel())
                flat, own_ids, owner = flat.take(valid, axis=1), own_ids[valid], owner[valid]
            logs = column_logs(net, flat, own_ids)
            out += np.bincount(owner, weights=logs, minlength=len(out))
            state, last = states[-1], ids[:, -1]
    return out


_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])


def _scored(encoded: DataFrame, vector: np.ndarray) -> DataFrame:
    """Rows of ``encode`` with the network's share of the score added; only the counts of rare words are missing."""
    shared = encoded.sparkSession.sparkContext.broadcast(vector)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = unpack(shared.value)
        for batch in few(batches, 8192):
            logs = document_logs(net, [np.frombuffer(ids.as_buffer(), np.int16) for ids in batch.column(6)])
            score = batch.column(5).to_numpy() + logs / np.log(10)
            yield rows(_SCORED, **{f.name: batch.column(k) for k, f in enumerate(_SCORED) if f.name != "score"}, score=score)

    columns = [f.name for f in _SCORED]
    return encoded.select(*columns, "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, logs double, score double")


def score(docs: DataFrame, training: Column, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row; rows with ``training`` true are learned from.

    Both scores are base-10 logarithms of the probability of the whole text with its end.  ``base_score`` is the unigram
    model with one added to every count and one unknown word.  Null and empty texts are the end token alone.  Null and
    repeated ids pass through; other columns are ignored.  Without training rows every word is unknown.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("learned"))
    words = stored(count_words(texts.where("learned")), "words")
    counts = gather_counts(words)
    encoded = stored(encode(texts, counts), "encoded")
    vector = fit_encoded(encoded.where("learned"), counts, rounds)
    scored = stored(_scored(encoded, vector), "scored")
    # Rare words meet their counts by a join; unknown ones add log10(1) = 0.
    rare = encoded.select("row", F.inline("rare"))
    found = rare.join(words.select("word", "n"), "word").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"), F.sum("k").alias("met"))
    out = scored.join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
                      (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(counts.total + counts.distinct + 1)))).alias("base_score"), (F.col("score") + more).alias("score"))
