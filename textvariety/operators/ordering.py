"""Exact ranks and running totals without one task holding a whole group.

Both work on two levels. Rows fall into ordered buckets of bounded size; a
small table of bucket counts gives the offset of each bucket; only rows of one
bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textvariety.functions.hashing import SEED, shuffle_key

# Hash buckets are the leading hex digits of the md5 key: at most 16**4 per
# group, whatever the data. That bounds every bucket table below.
BUCKET_DIGITS = 4
# Equal-depth ranges used for running totals over numbers.
RANGES = 255

# Names no input column may have.
CUT, SELECTED = "__textvariety_cut", "__textvariety_selected"
_HASH = "_hash"
_BUCKET = "_bucket"


def _keyed(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    keyed = df.withColumn(_HASH, shuffle_key(keys, seed))
    return keyed.withColumn(_BUCKET, F.substring(_HASH, 1, BUCKET_DIGITS))


def _bucket_totals(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per bucket, rows before it, and rows of its group."""
    counts = keyed.groupBy(*by, _BUCKET).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    ordered = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns(
        {
            "_before": F.sum("_n").over(ordered) - F.col("_n"),
            "_total": F.sum("_n").over(group),
        }
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    seed: int = SEED,
    name: str = "position",
) -> DataFrame:
    """Number rows 1..n in hash order, within each group if `by` is given.

    `keys` must identify a row.
    """
    keyed = _keyed(df, keys, seed)
    offsets = _bucket_totals(keyed, by).select(*by, _BUCKET, "_before")
    if not by:
        offsets = F.broadcast(offsets)  # at most 16**BUCKET_DIGITS rows
    inside = Window.partitionBy(*by, _BUCKET).orderBy(_HASH, *keys)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*by, _BUCKET])
        .withColumn(name, F.col("_before") + F.col("_rank"))
        .drop(_HASH, _BUCKET, "_before", "_rank")
        .select(*df.columns, name)
    )


def hash_cut(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    quota: Callable[[Column], Column],
    seed: int = SEED,
    small: bool = False,
) -> DataFrame:
    """Last key among the first quota(group size) rows of each group in hash order.

    One row (by, `cut`) per group with a positive quota; test rows against it
    with `within_cut`. Reads the key columns twice: once for bucket counts, once
    to sort the one bucket the cut lies in. `small=True` promises a fixed handful
    of groups and lets their edges be broadcast. `keys` must identify a row and
    hold no null.
    """
    narrow = _keyed(df.select(*dict.fromkeys([*by, *keys])), keys, seed)
    edge = (
        _bucket_totals(narrow, by)
        .withColumn("_take", F.least(quota(F.col("_total")), F.col("_total")))
        .filter("_before < _take AND _take <= _before + _n")
        .select(*by, _BUCKET, (F.col("_take") - F.col("_before")).alias("_need"))
    )
    inside = Window.partitionBy(*by, _BUCKET).orderBy(_HASH, *keys)
    return (
        narrow.join(F.broadcast(edge) if small else edge, [*by, _BUCKET])
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == F.col("_need"))
        .select(*by, F.struct(_HASH, *keys).alias(CUT))
    )


def within_cut(keys: Sequence[str], cut: Column, seed: int = SEED) -> Column:
    """True for rows at or before the cut; false where there is none."""
    here = F.struct(shuffle_key(keys, seed).alias(_HASH), *keys)
    return F.coalesce(here <= cut, F.lit(False))


def with_cut(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    quota: Callable[[Column], Column],
    seed: int = SEED,
    name: str = SELECTED,
) -> DataFrame:
    """Mark the first quota(group size) rows of each of a few fixed groups.

    The mark is a comparison with the group's cut, so wide rows are neither
    shuffled nor sorted. `by` must take a fixed handful of values: the cuts are
    broadcast.
    """
    cut = hash_cut(df, keys, by, quota, seed, small=True)
    if by:
        marked = df.join(F.broadcast(cut), list(by), "left")
        limit = F.col(CUT)
    else:
        marked = df
        limit = cut.select(CUT).scalar()
    return marked.select(*df.columns, within_cut(keys, limit, seed).alias(name))


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
) -> DataFrame:
    """Add `cum_<v>`, the sum of v over rows at or before this one, and `all_<v>`,
    its sum over the group, for each value.

    `(by, order)` must be unique; group first. Ranges of `order` are equal in
    depth over all rows, so none holds much more than 1/RANGES of them however
    the values cluster. Their bounds are fixed once, here, and become literals:
    a recomputed task therefore always sees the same ranges.
    """
    cuts = [i / (RANGES + 1) for i in range(1, RANGES + 1)]
    # An error well under the depth of a range keeps ranges balanced.
    bounds = sorted(set(df.approxQuantile(order, cuts, 0.25 / RANGES)))
    ranged = df.withColumn(_BUCKET, _range_of(F.col(order), bounds))
    sums = [F.sum(v).alias(f"_sum_{v}") for v in values]
    totals = ranged.groupBy(*by, _BUCKET).agg(*sums)

    def upto(window_by: Sequence[str], key: str):
        direction = F.col(key).desc() if descending else F.col(key).asc()
        window = Window.partitionBy(*window_by).orderBy(direction)
        return window.rowsBetween(Window.unboundedPreceding, 0)

    across = upto(by, _BUCKET)  # at most RANGES + 1 rows per group
    group = Window.partitionBy(*by)
    before = totals.select(
        *by,
        _BUCKET,
        *(
            (F.sum(f"_sum_{v}").over(across) - F.col(f"_sum_{v}")).alias(f"_before_{v}")
            for v in values
        ),
        *(F.sum(f"_sum_{v}").over(group).alias(f"all_{v}") for v in values),
    )
    inside = upto([*by, _BUCKET], order)
    return (
        ranged.withColumns({f"_run_{v}": F.sum(v).over(inside) for v in values})
        .join(before, [*by, _BUCKET])
        .select(
            *df.columns,
            *(
                (F.col(f"_before_{v}") + F.col(f"_run_{v}")).alias(f"cum_{v}")
                for v in values
            ),
            *(f"all_{v}" for v in values),
        )
    )


def _range_of(value: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds below the value."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*(F.lit(b) for b in bounds))
    return F.size(F.filter(edges, lambda b: b < value))
