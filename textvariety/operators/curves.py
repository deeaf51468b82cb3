"""Precision-recall curves over any number of rows and distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.functions.text import is_positive
from textvariety.operators.ordering import running_totals
from textvariety.sources.scratch import store

OPERATING_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
POOLED = "pooled"


def pool(df: DataFrame, dataset: str = "dataset", name: str = POOLED) -> DataFrame:
    """Every row twice: in its own data set and in the pooled one."""
    return df.withColumn(dataset, F.explode(F.array(F.col(dataset), F.lit(name))))


def pr_curve(
    df: DataFrame,
    by: Sequence[str] = ("dataset",),
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """One point per distinct score: precision and recall of 'score >= threshold'.

    Plus, per group, the terminal point (precision 1, recall 0, null threshold).
    Ties are merged before anything is accumulated. Without a positive row,
    recall is 1 throughout. Columns beside `by`: threshold, n, positives, tp,
    fp, precision, recall.
    """
    merged = (
        df.groupBy(*by, F.col(score).alias("threshold"))
        .agg(F.count("*").alias("n"), F.sum(is_positive(label)).alias("positives"))
        .filter(F.col("threshold").isNotNull())
    )
    points = store(merged)  # scoring may be costly; read three times below
    upto = running_totals(points, "threshold", ["n", "positives"], by)
    tp, every = F.col("cum_positives"), F.col("all_positives")
    curve = upto.select(
        *by,
        "threshold",
        "n",
        "positives",
        tp.alias("tp"),
        (F.col("cum_n") - tp).alias("fp"),
        (tp / F.col("cum_n")).alias("precision"),
        F.when(every == 0, 1.0).otherwise(tp / every).alias("recall"),
    )
    terminal = points.groupBy(*by).agg(F.count("*")).select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        *(F.lit(0).cast("bigint").alias(c) for c in ("n", "positives", "tp", "fp")),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return curve.unionByName(terminal)


def average_precision(curve: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Step-wise area under a pr_curve.

    The recall step at a score is its share of the positives, so no ordered
    window is needed.
    """
    step = F.sum(F.col("positives") * F.col("precision"))
    area = F.when(F.sum("positives") == 0, 0.0).otherwise(step / F.sum("positives"))
    return curve.groupBy(*by).agg(area.alias("average_precision"))


def operating_points(
    curve: DataFrame,
    by: Sequence[str] = ("dataset",),
    thresholds: Sequence[float] = OPERATING_THRESHOLDS,
) -> DataFrame:
    """Precision and recall at the smallest observed threshold >= each target.

    No row where every threshold is below the target.
    """
    point = F.struct("threshold", "precision", "recall")
    at = [
        F.min(F.when(F.col("threshold") >= F.lit(float(t)), point)).alias(f"_{i}")
        for i, t in enumerate(thresholds)
    ]
    rows = F.array(
        *(
            F.struct(F.lit(float(t)).alias("target"), F.col(f"_{i}").alias("point"))
            for i, t in enumerate(thresholds)
        )
    )
    return (
        curve.groupBy(*by)
        .agg(*at)
        .select(*by, F.inline(rows))
        .filter(F.col("point").isNotNull())
        .select(*by, "target", "point.threshold", "point.precision", "point.recall")
    )
