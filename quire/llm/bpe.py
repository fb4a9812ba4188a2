"""Byte-pair encoding in linear time: longest matches, a pair test, and backtracking; decoding by an offset table.

A sequence of tokens is what the merges give exactly when each two neighbours are what the merges give for the two
together.  So the encoder takes, from left to right, the longest vocabulary entry at the current place (all entries are
found by one Aho-Corasick pass) that is compatible with the token before it; where none fits it steps back.  A place that
once led nowhere is never tried again, hence linear time.  The vocabulary file is read, never trained.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import rows
from quire.llm.pieces import byte_letters

# Stands for the end-of-word mark inside a word; not a letter that stands for a byte.
_END = "\ue000"
_LETTERS = re.compile(r"([^\W\d_]+)([.,;:!?]+)")


class Vocabulary:
    """Tables of a word-level BPE file: entries, merges as pairs and splits, the longest entry that starts another one."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank, self.left, self.right = [0] * size, list(range(size)), list(range(size))
        # Entries that no merge makes come first in the order of merges.
        for entry in vocab.values():
            self.rank[entry] = entry - size
        valid = set(vocab.values())
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if (left, right) not in self.pairs:
                self.pairs[left, right] = made
            if self.left[made] == made:
                self.left[made], self.right[made], self.rank[made] = left, right, n
                if not (left in valid and right in valid and self._compatible(left, right, n)):
                    valid.discard(made)  # the merges never make this entry of its own letters
        self.automaton = ahocorasick.Automaton()
        inner = {self._inner(t): i for t, i in vocab.items() if i in valid}
        for text, entry in inner.items():
            self.automaton.add_word(text, (entry, len(text)))
        self.automaton.make_automaton()
        self.length, self.shorter = [0] * size, [-1] * size
        for text, entry in inner.items():
            self.length[entry] = len(text)
            for n in range(len(text) - 1, 0, -1):
                if (found := inner.get(text[:n])) is not None:
                    self.shorter[entry] = found
                    break
        self.checked: dict[tuple[int, int], bool] = {}
        # Decoding: all entries in one string, entry i between offsets i and i + 1.
        names = {i: t for t, i in (vocab | self.special).items()}
        self.text = "".join(names.get(i, "") for i in range(size))
        self.offsets = np.concatenate([[0], np.cumsum([len(names.get(i, "")) for i in range(size)])]).tolist()
        self.letters = byte_letters()

    def _inner(self, entry: str) -> str:
        return entry[: -len(self.suffix)] + _END if self.suffix and entry.endswith(self.suffix) else entry

    def _compatible(self, first: int, second: int, limit: float) -> bool:
        """Whether the merges leave ``first`` and ``second`` apart: no merge across them comes before their own last ones."""
        rank, pairs, left, right = self.rank, self.pairs, self.left, self.right
        while True:
            across = pairs.get((first, second))
            if across is not None and rank[across] < limit:
                return False
            # Undo the later of the two last merges; in a tie of places the left one came first.
            if rank[first] > rank[second]:
                if right[first] != first:
                    limit, first = rank[first], right[first]
                else:
                    return True
            elif left[second] != second:
                limit, second = rank[second] + 1, left[second]
            elif right[first] != first:
                limit, first = rank[first], right[first]
            else:
                return True

    def compatible(self, first: int, second: int) -> bool:
        key = first, second
        known = self.checked.get(key)
        if known is None:
            if len(self.checked) > 1_000_000:
                self.checked.clear()
            known = self.checked[key] = self._compatible(first, second, float("inf"))
        return known

    def merge_word(self, letters: str) -> list[int]:
        """Ids of one pre-token, written in byte letters."""
        word = letters + _END if self.suffix else letters
        size = len(word)
        best: list[tuple[int, int]] = [(-1, 0)] * size
        for end, (entry, n) in self.automaton.iter(word):
            at = end - n + 1
            if n > best[at][1]:
                best[at] = entry, n
        if best[0][1] == size:
            return [best[0][0]]
        length, shorter, tokens, alive, at = self.length, self.shorter, [], bytearray(b"\x01") * (size + 1), 0
        token = best[0][0]
        while at < size:
            while token >= 0 and not (alive[at + length[token]] and (not tokens or self.compatible(tokens[-1], token))):
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += length[token]
                token = best[at][0] if at < size else -1
            else:
                alive[at] = 0
                if not tokens:
                    raise ValueError(f"the vocabulary has no entries for {letters!r}")
                back = tokens.pop()
                at -= length[back]
                token = shorter[back]
        return tokens

    def encode(self, text: str) -> list[int]:
        """Ids of any text: special strings first, then normalising, pre-tokens and merges."""
        out: list[int] = []
        for part in self.special_cut.split(text) if self.special_cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = part if part.isascii() else unicodedata.normalize("NFC", part)
            part = part.lower() if part.isascii() else "".join([c.lower() for c in part])
            for token in self.words.findall(part):
                letters = token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
                out += self.merge_word(letters)
        return out

    def decode(self, ids: list[int]) -> str:
        text, offsets = self.text, self.offsets
        return " ".join([text[offsets[i] : offsets[i + 1]] for i in ids])


class TextCodec:
    """Ids as decimal text, and their decoding, for whole texts; pieces between spaces are remembered up to ``limit``."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 500_000):
        self.vocabulary, self.limit = vocabulary, limit
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.part_ids: dict[str, bytes] = {}
        self.part_texts: dict[str, bytes] = {}

    def _learn_part(self, part: str) -> None:
        if len(self.part_ids) >= self.limit:
            self.part_ids.clear()
            self.part_texts.clear()
        ids = self.vocabulary.encode(part)
        self.part_ids[part], self.part_texts[part] = " ".join(map(str, ids)).encode(), self.vocabulary.decode(ids).encode()

    def _learn(self, piece: str) -> None:
        # A word and the marks after it are separate pre-tokens; case goes before merging.
        plain = piece.lower() if piece.isascii() else piece
        if self.vocabulary.special_cut and self.vocabulary.special_cut.search(plain):
            plain = piece  # special strings are looked for before case goes: <|ENDOFTEXT|> is none
        cut = _LETTERS.fullmatch(plain)
        parts = cut.groups() if cut else (plain,)
        found = []
        for part in parts:
            if part not in self.part_ids:
                self._learn_part(part)
            found.append((self.part_ids[part], self.part_texts[part]))
        self.ids[piece], self.texts[piece] = (b" ".join(x) for x in zip(*found))

    def run(self, text: str | None) -> tuple[bytes, bytes]:
        """Decimal ids joined by spaces, and the decoded text."""
        pieces = (text or "").split(" ")
        ids, texts = self.ids, self.texts
        if len(ids) >= self.limit:
            ids.clear()
            texts.clear()
        for p in set(pieces).difference(ids):
            self._learn(p)
        found = [ids[p] for p in pieces]
        if not all(found):  # white space alone has no ids
            pieces = [p for p in pieces if ids[p]]
            found = [ids[p] for p in pieces]
        return b" ".join(found), b" ".join([texts[p] for p in pieces])


_CODECS: dict[str, TextCodec] = {}


def codec(path: str) -> TextCodec:
    if path not in _CODECS:
        _CODECS[path] = TextCodec(Vocabulary(path))
    return _CODECS[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row.

    A null text counts as empty: no tokens, digests of the empty string.  Null and repeated ``doc_id`` pass through.  Rows
    stay where they are read; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(path).run
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids, decoded = work(text.as_py())
                n.append(ids.count(b" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
            yield rows(_OUT, doc_id=batch.column(0), n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The ids themselves: ``doc_id, ids``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(path).run
        for batch in batches:
            yield rows(schema, doc_id=batch.column(0), ids=[[int(i) for i in work(t.as_py())[0].split()] for t in batch.column(1)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")
