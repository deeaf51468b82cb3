"""Comparisons of models over data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.operators.metrics import confusion, f1_variants


def leaderboard(predictions: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """One row per model, one column per data set: class-0 F1 in percent.

    `predictions` has model, dataset, label and pred. Naming the data sets
    spares the job that would look for them.
    """
    keys = ["model", "dataset"]
    scores = f1_variants(confusion(predictions, keys), keys)
    return scores.groupBy("model").pivot("dataset", list(datasets)).agg(F.first("f1_class0"))


def baseline_delta(
    scores: DataFrame, baseline: DataFrame, value: str = "f1_class0"
) -> DataFrame:
    """Measured minus published value, in percentage points.

    `baseline` has dataset, published and best_known; `scores` has model,
    dataset and `value`. Both are report tables of a few rows.
    """
    measured = F.col(value)
    return scores.join(baseline, "dataset").select(
        "model",
        "dataset",
        measured.alias("measured"),
        (measured - F.col("published")).alias("delta_published"),
        (measured - F.col("best_known")).alias("delta_best"),
    )
