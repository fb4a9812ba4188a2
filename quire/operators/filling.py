"""Greedy filling of chunks, in order, over groups of any length.

Where a chunk ends depends on where it began, so filling looks sequential.  But what a block of consecutive rows does to the
chunk that reaches into it is a small function.  The chunk that is open has a limit: the running size up to which rows still
fit.  The first row of the block beyond the limit begins a new chunk; from there on each row has a successor (the first
row that no longer fits with it), and following successors to the end of the block gives the limit that leaves it.  A later limit
never leaves earlier, so the function from limit to limit is a step function with as many steps as rows can be the last
beginning of a chunk in the block, most of which fall together on the way.

Step functions of blocks are made side by side, chained into those of stretches of blocks, and these are chained over a group.  Back
down, every stretch and then every block learns the limit that enters it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.blocks import BLOCK_WIDTH, with_running

# Blocks whose functions are chained into one.
STRETCH = 1024
_BEFORE_ALL = -1


def successors(ends: np.ndarray, sizes: np.ndarray, budget: int) -> np.ndarray:
    """The first row after each that begins a new chunk if a chunk begins there; the number of rows where none does.

    ``ends`` is the running size with the row itself.
    """
    at = np.arange(len(ends))
    return np.maximum(at + 1, np.searchsorted(ends, ends - sizes + budget, "right"))


def block_function(ends: np.ndarray, sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a block: a limit below ``upto[k]``, and not below the one before, leaves as ``out[k]``; from the last one on it stays."""
    n = len(ends)
    following = successors(ends, sizes, budget)
    last = np.where(following < n, following, np.arange(n))  # doubled until it is the last beginning of a chunk
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    out = (ends - sizes)[last] + budget
    first = np.append(True, ends[1:] != ends[:-1])  # rows of size 0 never begin a chunk when an equal end came before
    return _joined(ends[first], out[first])


def _joined(upto: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring steps with one result are one step."""
    last = np.append(out[1:] != out[:-1], True)
    return upto[last], out[last]


def applied(limit: np.ndarray, upto: np.ndarray, out: np.ndarray) -> np.ndarray:
    step = np.searchsorted(upto, limit, "right")
    return np.where(step < len(upto), out[np.minimum(step, len(out) - 1)], limit)


def chained(functions: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The step function of several blocks, one after the other."""
    upto, out = functions[0]
    for later in functions[1:]:
        own = later[0] > upto[-1]  # limits that pass the earlier blocks as they are
        upto, out = _joined(np.append(upto, later[0][own]), np.append(applied(out, *later), later[1][own]))
    return upto, out


def _functions(df: pd.DataFrame, order: str) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(u, np.int64), np.asarray(o, np.int64)) for u, o in df.sort_values(order)[["upto", "out"]].itertuples(index=False)]


def greedy_chunks(rows: DataFrame, group: str, order: str, size: str, budget: int, width: int = BLOCK_WIDTH, stretch: int = STRETCH) -> DataFrame:
    """``group, order, size, chunk``: rows fill chunks in order; a row that would take the chunk over ``budget`` begins the next one.

    A row larger than the budget is a chunk of its own.  ``order`` counts from a small number and is unique in its group;
    chunks are numbered from 0.  A NULL group is a group, a NULL size is 0; rows without ``order`` are left out.
    """
    sized = rows.where(F.col(order).isNotNull()).select(
        F.col(group).cast("string").alias("of"), F.col(order).cast("long").alias("at"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    placed = with_running(sized, ["of"], "at", {"end": (F.col("size"), F.sum)}, width, counted=True)
    placed = placed.select("of", F.floor(F.col("at") / width).cast("long").alias("block"), "at", "size", "end")
    steps = "upto array<long>, out array<long>"

    def block_steps(key, df):
        df = df.sort_values("at")
        upto, out = block_function(df["end"].to_numpy(), df["size"].to_numpy(), budget)
        return pd.DataFrame({"of": [key[0]], "block": [key[1]], "upto": [upto], "out": [out]})

    def stretch_steps(key, df):
        upto, out = chained(_functions(df, "block"))
        return pd.DataFrame({"of": [key[0]], "stretch": [key[1]], "upto": [upto], "out": [out]})

    def entries(df: pd.DataFrame, order: str, limit: int) -> pd.DataFrame:
        """The limit that enters each part, from the one that enters the first."""
        df, found = df.sort_values(order), []
        for function in _functions(df, order):
            found.append(limit)
            limit = int(applied(np.array([limit]), *function)[0])
        return pd.DataFrame({"of": df["of"], order: df[order], "entry": found})

    blocks = placed.groupBy("of", "block").applyInPandas(block_steps, f"of string, block long, {steps}").withColumn("stretch", F.floor(F.col("block") / stretch).cast("long"))
    stretches = blocks.groupBy("of", "stretch").applyInPandas(stretch_steps, f"of string, stretch long, {steps}")
    into_stretch = stretches.groupBy("of").applyInPandas(lambda df: entries(df, "stretch", _BEFORE_ALL), "of string, stretch long, entry long")
    into_block = blocks.groupBy("of", "stretch").cogroup(into_stretch.groupBy("of", "stretch")).applyInPandas(
        lambda df, entry: entries(df, "block", int(entry["entry"].iloc[0])), "of string, block long, entry long")

    def begin(df: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("at")
        ends, sizes = df["end"].to_numpy(), df["size"].to_numpy()
        following, begins = successors(ends, sizes, budget), np.zeros(len(df), np.int64)
        at = int(np.searchsorted(ends, int(entry["entry"].iloc[0]), "right"))
        while at < len(df):
            begins[at] = 1
            at = int(following[at])
        return pd.DataFrame({"of": df["of"], "at": df["at"], "size": df["size"], "begins": begins})

    begun = placed.groupBy("of", "block").cogroup(into_block.groupBy("of", "block")).applyInPandas(begin, "of string, at long, size long, begins long")
    numbered = with_running(begun, ["of"], "at", {"number": (F.col("begins"), F.sum)}, width, counted=True)
    return numbered.select(F.col("of").cast(rows.schema[group].dataType).alias(group), F.col("at").cast(rows.schema[order].dataType).alias(order), F.col("size").alias(size), (F.col("number") - 1).alias("chunk"))
