"""Deterministic order that does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def shuffle_key(keys: Sequence[str], seed: int = SEED) -> Column:
    """md5 of seed and key: sorting by it is a seeded permutation."""
    parts = [F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))
