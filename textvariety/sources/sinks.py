"""Writers."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textvariety.functions.text import long_enough_line


@dataclass(frozen=True)
class Throughput:
    """Rows written, wall-clock seconds and rows per second."""

    rows: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = ()
) -> Throughput:
    """Write Parquet, replacing what is there; rows are counted in passing."""
    seen = Observation()
    start = time.perf_counter()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return Throughput(seen.get["rows"], time.perf_counter() - start)


def write_labelled_lines(df: DataFrame, path: str, line: str = "line") -> int:
    """Write long enough lines as text, one per row; returns how many."""
    kept = df.filter(F.col(line).isNotNull() & long_enough_line(line)).select(line)
    seen = Observation()
    counted = kept.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").text(path)
    return seen.get["rows"]
