"""Deterministic shuffles, samples, splits and caps.

"Random" order is the hash order of functions.hashing: the same rows come out
on any cluster, partitioning or retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvariety.functions.hashing import SEED, shuffle_key
from textvariety.functions.text import CLASSES, known_label
from textvariety.operators.ordering import (
    CUT,
    SELECTED,
    hash_cut,
    with_cut,
    with_position,
    within_cut,
)
from textvariety.sources.scratch import broadcast_if_small, store

# Above this many rows a sample is cut by key instead of by one top-n task.
TOP_N_LIMIT = 10_000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def shuffle(
    df: DataFrame, key: str | Sequence[str], seed: int = SEED, position: bool = False
) -> DataFrame:
    """Seeded permutation of all rows, optionally numbered 1..n."""
    keys = _keys(key)
    if position:
        return with_position(df, keys, seed=seed)
    return df.orderBy(shuffle_key(keys, seed), *keys)


def sample_per_class(
    df: DataFrame,
    n: int,
    key: str | Sequence[str],
    label: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """Exactly n rows of each class (all of a smaller class); other labels go."""
    known = df.filter(known_label(label))
    marked = with_cut(
        known, _keys(key), [label], lambda size: F.lit(n), seed
    )
    return marked.filter(SELECTED).drop(SELECTED)


def balance(
    df: DataFrame,
    key: str | Sequence[str],
    cap: int | None = None,
    label: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """Equal classes: the size of the smaller one, capped when `cap` is given.

    A class without rows leaves nothing.
    """
    known = df.filter(known_label(label))
    counts = known.groupBy(label).agg(F.count("*").alias("n"))
    both = F.when(F.count("*") == len(CLASSES), F.min("n")).otherwise(0)
    size = both if cap is None else F.least(both, F.lit(cap))
    per_class = counts.agg(size.cast("bigint").alias("size"))
    marked = with_cut(
        known, _keys(key), [label], lambda _: per_class.scalar(), seed
    )
    return marked.filter(SELECTED).drop(SELECTED)


def stratified_split(
    df: DataFrame,
    fraction: float,
    key: str | Sequence[str],
    label: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """Add `split`: int(size * fraction) rows of each class are 'test'."""
    known = df.filter(known_label(label))
    marked = with_cut(
        known,
        _keys(key),
        [label],
        lambda size: F.floor(size * F.lit(float(fraction))),
        seed,
    )
    split = F.when(F.col(SELECTED), "test").otherwise("train")
    return marked.withColumn("split", split).drop(SELECTED)


def sample_n(
    df: DataFrame, key: str | Sequence[str], n: int = 25, seed: int = SEED
) -> DataFrame:
    """min(n, size) rows."""
    keys = _keys(key)
    if n <= TOP_N_LIMIT:
        return df.orderBy(shuffle_key(keys, seed), *keys).limit(n)
    marked = with_cut(df, keys, [], lambda size: F.lit(n), seed)
    # The same order as above; only ties of keys that repeat could differ.
    chosen = marked.filter(SELECTED).drop(SELECTED)
    return chosen.orderBy(shuffle_key(keys, seed), *keys)


def cap_rows(
    df: DataFrame,
    target: int,
    key: str | Sequence[str],
    language: str = "lang",
    shard: str = "shard",
    seed: int = SEED,
) -> DataFrame:
    """Exactly `target` rows per language, filled shard by shard.

    Shards are visited in hash order. Shards that fit are kept whole, the one
    that crosses the target is cut in hash order of `key`, later ones are
    dropped. Fewer rows than the target are all kept.
    """
    keys = _keys(key)
    plan = _shard_plan(df, target, language, shard, seed)
    return cap_by_plan(df, plan, keys, language, shard, seed)


def cap_by_plan(
    df: DataFrame,
    plan: DataFrame,
    key: str | Sequence[str],
    language: str = "lang",
    shard: str = "shard",
    seed: int = SEED,
) -> DataFrame:
    """Keep the rows a shard plan allows: (language, shard, rows, room).

    A shard with rows <= room stays whole; of a larger one, the first `room`
    rows in hash order of `key`. Shards not in the plan are dropped.
    """
    keys = _keys(key)
    # Only rows of the one crossing shard per language are ranked.
    crossing = df.join(plan.filter("rows > room"), [language, shard])
    cuts = hash_cut(
        crossing, keys, [language, shard, "room"], lambda _: F.col("room"), seed
    ).drop("room")
    rooms = broadcast_if_small(store(plan.join(cuts, [language, shard], "left")))
    kept = (F.col("rows") <= F.col("room")) | within_cut(keys, F.col(CUT), seed)
    return df.join(rooms, [language, shard]).filter(kept).select(*df.columns)


def _shard_plan(
    df: DataFrame, target: int, language: str, shard: str, seed: int
) -> DataFrame:
    """Size and remaining room of each shard visited before the target is met.

    Stored, because counting may mean splitting every text of the corpus.
    """
    sizes = df.groupBy(language, shard).agg(F.count("*").alias("rows"))
    # One row per input shard, so the ordered window is over a file list.
    visit = Window.partitionBy(language).orderBy(shuffle_key([shard], seed), shard)
    upto = visit.rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("rows").over(upto) - F.col("rows")
    plan = (
        sizes.withColumn("room", F.lit(target) - start)
        .filter("room > 0")
        .select(language, shard, "rows", "room")
    )
    return broadcast_if_small(store(plan))


def union_all(*frames: DataFrame) -> DataFrame:
    """Concatenate by column name, duplicates kept."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
