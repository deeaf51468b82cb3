"""Join document features with a table that has one row per feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.sources.scratch import store

# A feature with more than this share of the occurrences is joined by
# broadcast. At most 1 / HOT_SHARE features can exceed it.
HOT_SHARE = 1e-3


def feature_join(
    items: DataFrame, table: DataFrame, sample: DataFrame, feature: str
) -> DataFrame:
    """Inner join of `items` and `table` on `feature`, safe from common features.

    `items` is read several times: pass a stored table. `sample` (column
    `feature`, the rows of `items` or some of them) serves to find the hot
    features; it decides only how rows travel, never which rows come out. Hot
    rows stay where they are and meet a broadcast of at most 1 / HOT_SHARE
    rows; the others are joined by shuffle.
    """
    seen = sample.groupBy(feature).agg(F.count("*").alias("_n"))
    every = seen.agg(F.sum("_n")).scalar()
    # Fixed once: both sides of the union below must agree on it.
    hot = F.broadcast(
        store(seen.filter(F.col("_n") > every * HOT_SHARE).select(feature))
    )
    near = items.join(F.broadcast(table.join(hot, feature)), feature)
    far = items.join(hot, feature, "left_anti").join(table, feature)
    return near.unionByName(far)
