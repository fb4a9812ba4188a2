"""Token ids of whole texts through the public tokenizers library, one library call per new word instead of per text.

The library needs about a microsecond per character, and a corpus repeats its words.  Both tokenizers used here cut a text
into pre-tokens before merging, and no pre-token reaches from a non-space across a space, so the ids of a text are the ids
of its pieces between single spaces, one after the other.  Texts where that argument does not hold as it stands (runs of
white space, special strings) go through the library whole.

Arrow cuts the texts of a slice into pieces and numbers the different ones, so that Python sees each of those once; the
ids of the texts are then gathered in numpy by these numbers.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPECIAL = "<|"
# Letters and the marks after them, without the apostrophe, which may start a pre-token of its own.
_LETTERS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
# Texts are cut into pieces in slices of about so many bytes, and gathered so many pieces at a time.
SLICE = 1 << 23
_GATHERED = 1 << 17
# Below this code point letters, case and composition are the same in every Unicode version.
_STABLE = "\u0250"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte: itself, or the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = byte_letters()


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _runs(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts`` and are ``widths`` long, one after the other."""
    stops = np.cumsum(widths)
    return np.repeat(starts - (stops - widths), widths) + np.arange(int(stops[-1]) if len(stops) else 0)


class PieceEncoder:
    """``batches(column)`` gives the ids of the texts of an Arrow column, some texts at a time.

    ``byte_level`` pieces carry the space before them; word-level ones drop it.  Parts of pieces are remembered and forgotten
    all at once at ``limit`` entries; at ``remembered`` pieces those that the slice at hand does not have are forgotten.  So
    memory is bounded.  Known pieces lie in arrays: their names, and their ids one after the other.
    """

    def __init__(self, tokenizer, byte_level: bool, limit: int = 300_000, remembered: int = 1_000_000):
        self.tokenizer, self.merges, self.byte_level, self.limit, self.remembered = tokenizer, tokenizer.model, byte_level, limit, remembered
        self.known, self.ids = pa.array([], pa.large_string()), np.empty(0, "<u4")
        self.starts, self.widths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, part: str) -> bytes:
        """A plain word is one pre-token: only the library's merge model has work to do on it."""
        letters = part[1:] if part[:1] == " " else part
        if not letters.isalpha() or not (letters.isascii() or max(letters) < _STABLE and unicodedata.is_normalized("NFC", letters)):
            return self.whole(part)
        plain = part if self.byte_level else part.lower()
        if len(plain) != len(part):
            return self.whole(part)
        if plain.isascii():
            plain = plain.replace(" ", _BYTE_LETTERS[32])
        else:
            plain = plain.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.merges.tokenize(plain)]).tobytes()

    def _cut(self, piece: str) -> list[str]:
        """Parts of a piece that merge on their own: words, the marks after them, and a line feed between two lines."""
        lines = piece.split("\n") if "\n" in piece else [piece]
        if len(lines) > 1 and any(not line or line[0].isspace() or line[-1].isspace() for line in lines):
            return [piece]
        if not self.byte_level and piece.isascii():
            lines = [line.lower() for line in lines]
        parts = []
        for k, line in enumerate(lines):
            if k and self.byte_level:
                parts.append("\n")
            cut = _LETTERS.fullmatch(line)
            parts += cut.groups() if cut else (line,)
        return parts

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= self.limit:
                self.parts.clear()
            ids = self.parts[part] = self._word(part)
        return ids

    def _learn(self, piece: str, space: str) -> bytes:
        if piece.isalpha():
            return self._part(space + piece)
        head, *rest = self._cut(piece)
        return b"".join([self._part(space + head), *[self._part(p) for p in rest]])

    def _pieces(self, names: pa.Array) -> np.ndarray:
        """Place of each piece among the known ones, after new ones are learned; beyond the limit only these names are kept."""
        at = pc.index_in(names, self.known)
        new = names.filter(pc.is_null(at))
        places = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            if len(self.known) + len(new) > self.remembered:
                used = np.unique(places[places >= 0])
                places[places >= 0] = np.searchsorted(used, places[places >= 0])
                self.known, widths = self.known.take(pa.array(used)), self.widths[used]
                self.ids = self.ids[_runs(self.starts[used], widths)]
                self.widths, self.starts = widths, np.cumsum(widths) - widths
            places[places < 0] = len(self.known) + np.arange(len(new))
            space = " " if self.byte_level else ""
            learned = [self._learn(p, space) for p in new.to_pylist()]
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learned), "<u4")])
            self.widths = np.concatenate([self.widths, np.fromiter(map(len, learned), np.int64, len(learned)) // 4])
            self.starts = np.cumsum(self.widths) - self.widths
        return places

    def _slice(self, texts: pa.Array, end: int | None, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lists = pc.split_pattern(texts, " ")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        places, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
        del lists, coded
        starts = np.cumsum(sizes) - sizes
        whole = pc.match_substring(texts, _SPECIAL).to_numpy(zero_copy_only=False)
        kept = np.ones(len(places), bool)
        if self.byte_level:
            trimmed = pc.equal(pc.utf8_trim_whitespace(names), names)
            odd = pc.invert(pc.and_(trimmed, pc.greater(pc.binary_length(names), 0))).to_numpy(zero_copy_only=False)
            if odd.any():
                whole = whole | np.logical_or.reduceat(odd[places], starts)
            kept[starts] = False
        if whole.any():
            kept &= np.repeat(~whole, sizes)
        used = np.zeros(len(names), bool)
        used[places[kept]] = True
        number = np.full(len(names), -1, np.int64)
        number[used] = self._pieces(names.filter(pa.array(used)))
        # Behind the known pieces: the end, first pieces of texts (no space precedes them), and texts that go whole.
        more = [b"" if end is None else end.to_bytes(4, "little")]
        stop = len(self.known)
        places_of = number[places]
        rest, lost = np.flatnonzero(~whole), np.flatnonzero(whole)
        if self.byte_level:
            heads, head_of = np.unique(places[starts[rest]], return_inverse=True)
            places_of[starts[rest]] = stop + len(more) + head_of
            more += [self._learn(p, "") for p in names.take(pa.array(heads)).to_pylist()]
        places_of[starts[lost]] = stop + len(more) + np.arange(len(lost))
        more += [self.whole(texts[k].as_py()) for k in lost.tolist()]
        if len(lost):
            kept[starts] = True
            places_of, sizes = places_of[kept], np.where(whole, 1, sizes)
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(more), "<u4")])
        widths = np.concatenate([self.widths, np.fromiter(map(len, more), np.int64, len(more)) // 4])
        begins = np.cumsum(widths) - widths
        stops, first = np.cumsum(sizes), 0
        starts = stops - sizes
        # Few texts at a time, so that what is gathered stays small.
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(stops, starts[first] + limit, "right")))
            own = sizes[first:last]
            order = places_of[starts[first] : starts[first] + int(own.sum())]
            if end is not None:
                order, own = np.insert(order, np.cumsum(own), stop), own + 1
            each = widths[order]
            lengths = np.add.reduceat(each, np.cumsum(own) - own)
            yield ids[_runs(begins[order], each)], lengths
            first = last

    def batches(self, column: pa.Array, end: int | None = None, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of the first text, ids of the texts one after the other (each with ``end``, if given), and their numbers of ids.

        A slice has about ``limit`` bytes; a longer text is a slice of its own.  Null is empty.
        """
        column = column.fill_null("").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(column):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            for ids, lengths in self._slice(column.slice(first, last - first), end, _GATHERED):
                yield first, ids, lengths
                first += len(lengths)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return next(self.batches(pa.array([text], pa.string())))[1].tobytes()


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, byte_level: bool, remember: bool = True) -> PieceEncoder:
    """The encoder of this Python worker; workers are reused, so words learned in one task serve the next.

    Without ``remember`` the words go with the task, which holds fewer parts, and leave the worker's memory to whatever runs after it.
    """
    if not remember:
        return PieceEncoder(load(path), byte_level, limit=100_000)
    key = (path, byte_level)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(load(path), byte_level)
    return _ENCODERS[key]
