"""Running values over long groups without ever putting one group into one task.

A window partitioned by book (or task, or model) sends the whole group to a single task.  One book may hold a
third of the corpus, so these helpers cut the table, ordered by group and key, into blocks.  The window runs inside a
block of a group; one small row per block carries the running value across.

Where to cut is read off the data: the places between blocks are quantiles of (group, key) over a sample of the rows that a hash
picks, so each block holds about ``width`` rows whatever the keys look like: one stray key, hashed keys or bursts
change nothing.  A table of more than ``MOST_BLOCKS`` times ``width`` rows is cut into ``MOST_BLOCKS`` blocks of equal count.
Keys that count from a small number (page numbers, positions) need no cuts: ``width`` consecutive values are a block, and
since keys are unique in their group it holds no more than ``width`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let

BLOCK_WIDTH = 4096
# The cuts of a table are one array that every task holds.  So many sampled rows stand for one block at least: a block's
# share of the rows is then off by a sixth, and hardly ever twice what it should be.
MOST_BLOCKS = 4096
ROWS_PER_CUT = 32
_HASHES = 1 << 31

# How two partial results of an aggregate combine into one.
Merge = Callable[[Column], Column]


def with_running(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    running: dict[str, tuple[Column, Merge]],
    width: int = BLOCK_WIDTH,
    exclusive: bool = False,
    levels: int = 2,
    counted: bool = False,
) -> DataFrame:
    """Add running aggregates over ``group`` ordered by the column ``order``, unique in its group; every row comes out again.

    ``running`` maps an output name to ``(input, aggregate)``; the aggregate must be able to merge its own
    results (``F.sum``, ``F.max``, ``F.min``).  ``exclusive`` leaves the current row out.

    Blocks hold about ``width`` rows, whatever the keys.  ``counted`` says that keys count from a small number, so that nothing
    is read to find the cuts; then each further level blocks the block table again, and two levels carry ``width`` cubed rows per group.
    A NULL group is a group.  Rows with a NULL order key come first in their group, in an order of the hashes of their numbers;
    those that differ in texts alone share a block.
    """
    return _running(with_blocks(df, group, order, width, counted), list(group), order, running, width, exclusive, levels if counted else 1).drop("__block", "__tie")


def with_blocks(df: DataFrame, group: Sequence[str], order: str, width: int = BLOCK_WIDTH, counted: bool = False) -> DataFrame:
    """Number the block of every row as ``__block``, which grows with ``order`` inside a group; ``__tie`` orders rows without a key."""
    # Many rows without a key are cut as well: a hash of their numbers stands in for it.  Texts are left out, as they would be read for it.
    numbers = [F.lit(0), *[F.col(c) for c, kind in df.dtypes if kind in ("int", "bigint", "double", "timestamp", "timestamp_ntz", "date")]]
    tied = df.withColumn("__tie", F.when(F.col(order).isNull(), F.xxhash64(*numbers)).otherwise(F.lit(0)))
    if counted:
        return tied.withColumn("__block", F.coalesce(F.floor(F.col(order).cast("double") / width).cast("long"), F.lit(-1)))
    place = F.struct(*[F.col(g) for g in group], F.col(order), F.col("__tie"))
    number = F.count(F.lit(1))
    picked = F.pmod(F.xxhash64(*group, order, "__tie"), F.lit(_HASHES))
    # Both subqueries run once, when the query does.
    rows = tied.agg(F.greatest(F.lit(1), number).alias("n")).scalar()
    share = F.least(F.lit(ROWS_PER_CUT / width), F.lit(float(ROWS_PER_CUT * MOST_BLOCKS)) / rows)
    sample = tied.where(picked < F.lit(float(_HASHES)) * share).agg(F.sort_array(F.collect_list(place)).alias("places"), number.alias("n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") * width / rows), F.ceil(F.col("n") / MOST_BLOCKS)).cast("int")
    cuts = sample.withColumn("step", step).select(F.filter("places", lambda p, i: (i > 0) & (i % F.col("step") == 0)).alias("cuts")).scalar()
    found = let(F.col("__both"), lambda both: _count_up_to(both["cuts"], both["place"]))
    return tied.withColumn("__both", F.struct(cuts.alias("cuts"), place.alias("place"))).withColumn("__block", found.cast("long")).drop("__both")


def _count_up_to(cuts: Column, place: Column) -> Column:
    """How many of the sorted cuts are not after a place: a binary search by halving steps."""
    steps = [1 << k for k in range(math.ceil(math.log2(MOST_BLOCKS)) + 1, -1, -1)]

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= place), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def _running(df: DataFrame, group: list[str], order: str, running: dict[str, tuple[Column, Merge]], width: int, exclusive: bool, levels: int) -> DataFrame:
    """``with_running`` for rows that carry their ``__block``, a number that grows with the order key, and ``__tie``."""
    inputs = {f"__in_{name}": source for name, (source, _) in running.items()}
    # One column that is never NULL stands for the group, so that windows, totals and the join deal rows out alike.
    staged = df.withColumns(inputs).withColumn("__group", F.struct(*group))
    last = -1 if exclusive else Window.currentRow
    within = Window.partitionBy("__group", "__block").orderBy(order, "__tie").rowsBetween(Window.unboundedPreceding, last)
    local = staged.withColumns({f"__local_{n}": agg(F.col(f"__in_{n}")).over(within) for n, (_, agg) in running.items()})
    totals = staged.groupBy("__group", "__block").agg(*[agg(F.col(f"__in_{n}")).alias(n) for n, (_, agg) in running.items()])
    if levels > 1:
        upper = totals.withColumnsRenamed({"__block": "__order", "__group": "__of"}).withColumns({"__block": F.floor(F.col("__order") / width).cast("long"), "__tie": F.lit(0)})
        carry = _running(upper, ["__of"], "__order", {f"__carry_{n}": (F.col(n), agg) for n, (_, agg) in running.items()}, width, True, levels - 1)
        carry = carry.drop("__block").withColumnsRenamed({"__order": "__block", "__of": "__group"})
    else:
        before = Window.partitionBy("__group").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.withColumns({f"__carry_{n}": agg(F.col(n)).over(before) for n, (_, agg) in running.items()})
    joined = local.join(carry.select("__group", "__block", *[f"__carry_{n}" for n in running]), ["__group", "__block"])
    outputs = {n: _merge(agg, F.col(f"__carry_{n}"), F.col(f"__local_{n}")) for n, (_, agg) in running.items()}
    spare = [f"__{part}_{n}" for n in running for part in ("in", "local", "carry")]
    return joined.withColumns(outputs).drop(*spare, "__group")


def _merge(agg: Merge, carry: Column, local: Column) -> Column:
    if agg is F.sum:
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if agg is F.max:
        return F.when(carry.isNull() | (local >= carry), local).otherwise(carry)
    if agg is F.min:
        return F.when(carry.isNull() | (local <= carry), local).otherwise(carry)
    raise ValueError("running aggregates must be F.sum, F.max or F.min")


def number_rows(
    df: DataFrame, group: Sequence[str], order: str, name: str, width: int = BLOCK_WIDTH, levels: int = 2, counted: bool = False
) -> DataFrame:
    """Dense 1-based position of each row in its group by a unique integer key."""
    return with_running(df, group, order, {name: (F.lit(1).cast("long"), F.sum)}, width, levels=levels, counted=counted)


def with_group_total(df: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Attach the group size; a NULL group is a group.

    Counting is combined map-side; a hot group's join is split by adaptive execution.
    """
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    totals = totals.select(*[F.col(k).alias(f"__k_{k}") for k in group], name)
    same = F.lit(True)
    for k in group:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(totals, same).drop(*[f"__k_{k}" for k in group])
