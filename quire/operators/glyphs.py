"""Glyphs put together into lines while they stream by: a task joins what it reads, so that rows of text move instead of rows of glyphs.

A *piece* is a run of glyphs of one page and height, in the order of (``x0``, ``g_idx``, ``ch``).  Pieces move once, by page, and come to their task
sorted, where those of a height follow each other; heights, and then lines, are closed as the next one begins, so no page is held.
Glyphs without a position come first among those of their height, NaN last, as Spark sorts them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["book", "page_num"]
# Numbers of a glyph, in the order in which they are handed over.
NUMBERS = ["page_num", "top", "x0", "g_idx", "size"]
# Glyphs that a height has on average in its place, for a batch to be taken in the order it comes in.
SHORTEST_RUN = 8
_HALF = 1 << 32
# Places of the glyphs of a piece, as bytes, since lists pass between Spark and Python number by number: ``x0`` as doubles; ``g_idx`` less that of the first
# as ints, or whole where they lie far apart; which of both are known (bits 1 and 2), if not all are; the ends of the characters as ints, if not all are of one.
_DETAIL = ("x0s", "steps", "far", "known", "ends")
_PIECE = "text string, sizes double, sized bigint, n bigint, x0 double, g_idx bigint, least double, " + ", ".join(f"{name} binary" for name in _DETAIL)
_LINE = "line_no int, text string, sizes double, sized bigint, y0 double, x0 double"


def page_lines(glyphs: DataFrame, tolerance: float) -> DataFrame:
    """Lines of each page: ``line_no``, ``text``, ``sizes`` and ``sized`` (sum and number of sizes above 0), ``y0`` (least height) and ``x0`` (least).

    A height joins the line before if it is no further than ``tolerance`` from its running mean, which it then halves the distance to,
    once per glyph; a line starts exactly at its first height.  Null keys are keys.
    """
    kinds = dict(glyphs.dtypes)
    # Spark measures an Arrow batch after every row, column by column: one array of numbers is one column.  A number of 64 bits goes as two.
    long = [name for name in ("page_num", "g_idx") if kinds[name] == "bigint"]
    numbers = [_high(name) if name in long else F.col(name).cast("double") for name in NUMBERS] + [_low(name) for name in long]
    read = glyphs.select("book", "ch", F.array(*numbers).alias("numbers"))
    keys = f"book {kinds['book']}, page_num bigint"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_pieces(batch, long) for batch in batches if batch.num_rows)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _lines(batches, tolerance)

    pieces = read.mapInArrow(join, f"{keys}, top double, {_PIECE}").repartition(*PAGE).sortWithinPartitions(*PAGE, "top", "x0", "g_idx")
    lines = pieces.mapInArrow(close, f"{keys}, {_LINE}")
    given = {"page_num": "page_num", "y0": "top", "x0": "x0"}
    return lines.withColumns({name: F.col(name).cast(kinds[source]) for name, source in given.items()})


def _high(name: str) -> Column:
    return F.shiftright(F.col(name), 32).cast("double")


def _low(name: str) -> Column:
    return F.col(name).bitwiseAND(F.lit(_HALF - 1)).cast("double")


def _differ(values: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it; NaN equals NaN."""
    new = np.zeros(len(values[0]), bool)
    new[0] = True
    for value in values:
        unlike = value[1:] != value[:-1]
        new[1:] |= unlike & ~(np.isnan(value[1:]) & np.isnan(value[:-1])) if value.dtype.kind == "f" else unlike
    return new


def _pieces(batch: pa.RecordBatch, long: list[str]) -> pa.RecordBatch:
    """The pieces of a batch: one per height, or more where the glyphs of a height lie apart and yet come in order."""
    count = batch.num_rows
    flat = batch.column("numbers").flatten()
    shape = (count, len(NUMBERS) + len(long))
    known = (pc.is_valid(flat).to_numpy(zero_copy_only=False) if flat.null_count else np.ones(len(flat), bool)).reshape(shape)
    values = (pc.fill_null(flat, 0.0) if flat.null_count else flat).to_numpy(zero_copy_only=False).reshape(shape)
    column = {name: values[:, i] for i, name in enumerate(NUMBERS)}
    valid = {name: known[:, i] for i, name in enumerate(NUMBERS)}
    for name in ("page_num", "g_idx"):
        whole = column[name].astype(np.int64)
        column[name] = whole * _HALF + values[:, len(NUMBERS) + long.index(name)].astype(np.int64) if name in long else whole
    # Zero has one sign.
    top, x0, number, size = column["top"] + 0.0, column["x0"], column["g_idx"], column["size"]
    page, ch = column["page_num"], batch.column("ch")
    book = batch.column("book").dictionary_encode(null_encoding="encode").indices.to_numpy()

    # Readers deliver most glyphs in order.  Then a run of one height is a piece as it stands, if it is long enough.
    group = [top, valid["top"], page, valid["page_num"], book]
    runs = _differ(group)
    ahead = (x0[1:] > x0[:-1]) | ((x0[1:] == x0[:-1]) & (number[1:] > number[:-1]))
    order = None
    if not (runs[1:] | ahead).all() or not (valid["x0"].all() and valid["g_idx"].all()) or runs.sum() * SHORTEST_RUN > count:
        within = [x0, valid["x0"], number, valid["g_idx"]]
        by = [number, valid["g_idx"], x0, valid["x0"], *group]
        order = np.lexsort(by)
        if not _differ([v[order] for v in [*group, *within]]).all():
            chars = ch.to_pylist()
            rank = {c: i for i, c in enumerate(sorted({c for c in chars if c is not None}))}
            order = np.lexsort([np.array([-1 if c is None else rank[c] for c in chars]), *by])
        runs = _differ([v[order] for v in group])
        ch, x0, number, size = ch.take(pa.array(order)), x0[order], number[order], size[order]
        valid = {name: v[order] for name, v in valid.items()}
    starts = np.flatnonzero(runs)
    bounds = np.append(starts, count).astype(np.int32)
    counts = np.diff(bounds)
    firsts = starts if order is None else order[starts]

    ink = pc.fill_null(ch, "")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), ink), "")
    # NaN is more than any number.
    has_size = valid["size"] & ((size > 0) | np.isnan(size))
    sized = np.add.reduceat(has_size.astype(np.int64), starts)
    sums = pa.array(np.add.reduceat(np.where(has_size, size, 0.0), starts), mask=sized == 0)
    # Nulls come first, so the least value of a height is the first that is not null.
    first_valid = np.minimum.reduceat(np.where(valid["x0"], np.arange(count), count), starts)
    no_x0 = first_valid == count
    least = pa.array(x0[np.where(no_x0, 0, first_valid)], mask=no_x0)

    lengths = pc.utf8_length(ink).to_numpy(zero_copy_only=False)
    several = counts > 1
    plain = np.logical_and.reduceat((lengths == 1) & pc.is_valid(ch).to_numpy(zero_copy_only=False), starts)
    steps = number - np.repeat(number[starts], counts)
    near = np.logical_and.reduceat(valid["g_idx"] & (number > -(1 << 62)) & (number < 1 << 62) & (np.abs(steps) < 1 << 31), starts)
    flags = valid["x0"].astype(np.uint8) + 2 * valid["g_idx"].astype(np.uint8)
    total = np.cumsum(lengths)
    ends = total - np.repeat(total[starts] - lengths[starts], counts)

    def packed(items: np.ndarray, keep: np.ndarray) -> pa.Array:
        """The numbers as bytes for each piece of several glyphs that is to have them, else null."""
        keep = keep & several
        data = np.ascontiguousarray(items if keep.all() else items[np.repeat(keep, counts)])
        offsets = np.append(0, np.cumsum(np.where(keep, counts, 0))).astype(np.int32) * items.itemsize
        bits = np.packbits(keep, bitorder="little")
        return pa.Array.from_buffers(pa.binary(), len(keep), [pa.py_buffer(bits), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])

    columns = {
        "book": batch.column("book").take(pa.array(firsts)), "page_num": pa.array(page[firsts], mask=~valid["page_num"][starts]),
        "top": pa.array(top[firsts], mask=~valid["top"][starts]), "text": text, "sizes": sums, "sized": pa.array(sized), "n": pa.array(counts.astype(np.int64)),
        "x0": pa.array(x0[starts], mask=~valid["x0"][starts]), "g_idx": pa.array(number[starts], mask=~valid["g_idx"][starts]), "least": least,
        "x0s": packed(x0, several), "steps": packed(steps.astype(np.int32), near), "far": packed(number, ~near),
        "known": packed(flags, np.minimum.reduceat(flags, starts) < 3), "ends": packed(ends.astype(np.int32), ~plain),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _place(value: float | None) -> tuple[int, float]:
    """Nulls first, NaN last."""
    return (0, 0) if value is None else (2, 0) if value != value else (1, value)


def _glyphs(piece: tuple) -> list[tuple]:
    """The glyphs of a piece as (place, character)."""
    text, x0, number, x0s, steps, far, known, ends = piece
    if x0s is None:
        return [((_place(x0), _place(number)), text)]
    places = np.frombuffer(x0s).tolist()
    numbers = np.frombuffer(far, np.int64).tolist() if steps is None else [number + s for s in np.frombuffer(steps, np.int32).tolist()]
    if known is not None:
        places = [x if k & 1 else None for x, k in zip(places, known)]
        numbers = [n if k & 2 else None for n, k in zip(numbers, known)]
    cuts = None if ends is None else np.frombuffer(ends, np.int32).tolist()
    chars = text if cuts is None else [text[a:b] for a, b in zip([0, *cuts], cuts)]
    return [((_place(x), _place(n)), c) for x, n, c in zip(places, numbers, chars)]


def _merged(pieces: list[tuple]) -> str:
    """The text of pieces of one height, which come in the order of their first glyphs."""
    glyphs: list[tuple] = []
    apart = True
    for piece in pieces:
        found = _glyphs(piece)
        apart = apart and not (glyphs and found[0][0] <= glyphs[-1][0])
        glyphs += found
    return "".join(c for _, c in (glyphs if apart else sorted(glyphs)))


def _added(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else a + b


def _lower(a: float | None, b: float | None) -> float | None:
    return b if a is None or a != a and b is not None else a if b is None or b != b else min(a, b)


def _lines(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    """Heights from sorted pieces, lines from heights."""
    schema: pa.Schema | None = None
    done: list[list] = []
    page: tuple | None = None
    mean: float | None = None
    # The line and the height that are open: text, sum and number of sizes, height, least x0; for a height, its glyphs and its pieces.
    line: list | None = None
    height: list | None = None

    def end_line() -> None:
        nonlocal line
        if line is not None:
            line[3] = "".join(line[3])
            done.append(line)
        line = None

    def end_height() -> None:
        nonlocal height, line, mean
        if height is None:
            return
        top, sizes, sized, n, least, pieces = height
        text = pieces[0][0] if len(pieces) == 1 else _merged(pieces)
        if line is not None and mean is not None and top is not None and abs(top - mean) <= tolerance:
            line[3].append(text)
            line[4], line[5], line[7] = _added(line[4], sizes), line[5] + sized, _lower(line[7], least)
            # n glyphs of one height halve the distance to it n times.
            mean = top + math.ldexp(mean - top, -n)
        else:
            number = 0 if line is None else line[2] + 1
            end_line()
            line, mean = [*page, number, [text], sizes, sized, top, least], top
        height = None

    def found() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(schema)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("book"), batch.schema.field("page_num"), ("line_no", pa.int32()), ("text", pa.string()),
                                      ("sizes", pa.float64()), ("sized", pa.int64()), ("y0", pa.float64()), ("x0", pa.float64())])
        detail = [batch.column(name) for name in _DETAIL]
        columns = [batch.column(name).to_pylist() for name in ("book", "page_num", "top", "text", "sizes", "sized", "n", "x0", "g_idx", "least")]
        more = batch.num_rows - 1
        for i, (book, number, top, text, sizes, sized, n, x0, first, least) in enumerate(zip(*columns)):
            if page != (book, number):
                end_height()
                end_line()
                page = (book, number)
            elif height is not None and (height[0] == top or top is not None and top != top and height[0] is not None and height[0] != height[0]):
                height[1], height[2], height[3], height[4] = _added(height[1], sizes), height[2] + sized, height[3] + n, _lower(height[4], least)
                height[5].append((text, x0, first, *(d[i].as_py() for d in detail)))
                continue
            end_height()
            # Most heights are one piece, of which the text is enough; the last of a batch may go on.
            after = i < more and (columns[0][i + 1], columns[1][i + 1], columns[2][i + 1]) == (book, number, top) or i == more or top is not None and top != top
            height = [top, sizes, sized, n, least, [(text, x0, first, *(d[i].as_py() for d in detail)) if after else (text,)]]
        yield found()
    end_height()
    end_line()
    if done:
        yield found()
