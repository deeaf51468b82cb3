"""Counts, score summaries and classification metrics.

Everything derives from map-side combined counts; predictions are read once.
Metric values are plain ratios; the F1 variants are percentages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvariety.functions.text import KEEP_THRESHOLD, NEGATIVE_TAG, POSITIVE_TAG
from textvariety.operators.ordering import running_totals
from textvariety.sources.scratch import store


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, and the total over all classes on each row."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("total", counts.agg(F.sum("n")).scalar())


def domain_counts(
    df: DataFrame, domain: str = "domain", label: str = "label"
) -> DataFrame:
    """Rows, class-0 rows and class-1 rows per domain, then a TOTAL row."""
    return (
        df.rollup(domain)
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col(label) == 0).alias("n_class0"),
            F.count_if(F.col(label) == 1).alias("n_class1"),
            F.grouping(domain).alias("_is_total"),
        )
        .withColumn(
            domain, F.when(F.col("_is_total") == 1, "TOTAL").otherwise(F.col(domain))
        )
        .drop("_is_total")
    )


def score_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """One row: n, mean and exact median (midpoint of the central values).

    The median is found through running counts of distinct scores, so no task
    ever holds all values; null scores are ignored.
    """
    counts = store(
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("_s"))
        .agg(F.count("*").alias("_n"))
    )
    upto = running_totals(counts, "_s", ["_n"], descending=False)
    size = F.col("all__n")
    lower_rank = F.col("cum__n") >= F.floor((size + 1) / 2)
    upper_rank = F.col("cum__n") >= F.floor((size + 2) / 2)
    lower = F.min(F.when(lower_rank, F.col("_s")))
    upper = F.min(F.when(upper_rank, F.col("_s")))
    return upto.agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col("_s") * F.col("_n")) / F.sum("_n")).alias("mean"),
        ((lower + upper) / 2).alias("median"),
    )


def kept_ratio(
    df: DataFrame, score: str = "score", threshold: float = KEEP_THRESHOLD
) -> DataFrame:
    """One row: total, kept and kept percentage."""
    kept = F.count_if(F.col(score) >= F.lit(float(threshold)))
    return df.agg(
        F.count("*").alias("total"),
        kept.alias("kept"),
        F.try_divide(kept * 100.0, F.count("*")).alias("kept_pct"),
    )


def confusion(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    pred: str = "pred",
) -> DataFrame:
    """tp, fn, fp, tn per group, with class 0 as the positive class.

    A null or foreign prediction of a known label is a wrong one, so the four
    cells sum to the rows with a known label.
    """
    true0, said0 = F.col(label) == 0, F.col(pred).eqNullSafe(0)
    true1, said1 = F.col(label) == 1, F.col(pred).eqNullSafe(1)
    return df.groupBy(*by).agg(
        F.count_if(true0 & said0).alias("tp"),
        F.count_if(true0 & ~said0).alias("fn"),
        F.count_if(true1 & ~said1).alias("fp"),
        F.count_if(true1 & said1).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _precision_recall_f1(hit: Column, miss: Column, false: Column):
    precision = _ratio(hit, hit + false)
    recall = _ratio(hit, hit + miss)
    f1 = _ratio(2.0 * hit, 2 * hit + miss + false)
    return precision, recall, f1


def _per_class():
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return _precision_recall_f1(tp, fn, fp), _precision_recall_f1(tn, fp, fn)


def _accuracy() -> Column:
    correct = F.col("tp") + F.col("tn")
    return _ratio(correct, correct + F.col("fn") + F.col("fp"))


def classification_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Report rows of a `confusion` table: two classes, accuracy and averages.

    Columns: row, precision, recall, f1, support. The accuracy row repeats the
    accuracy, which is what all three are when averaged over rows.
    """
    class0, class1 = _per_class()
    support0, support1 = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    total = support0 + support1

    def line(name: str, values: Sequence[Column], support: Column) -> Column:
        named = zip(("precision", "recall", "f1"), values, strict=True)
        return F.struct(
            F.lit(name).alias("row"),
            *(v.cast("double").alias(n) for n, v in named),
            support.alias("support"),
        )

    both = list(zip(class0, class1, strict=True))
    macro = [(a + b) / 2 for a, b in both]
    weighted = [_ratio(a * support0 + b * support1, total) for a, b in both]
    lines = F.array(
        line(_display(POSITIVE_TAG), class0, support0),
        line(_display(NEGATIVE_TAG), class1, support1),
        line("accuracy", [_accuracy()] * 3, total),
        line("macro avg", macro, total),
        line("weighted avg", weighted, total),
    )
    return counts.select(*by, F.inline(lines))


def _display(tag: str) -> str:
    return tag.removeprefix("__label__").replace("_", "-")


def f1_variants(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentages side by side: F1 of each class, macro F1 and accuracy.

    f1_class1 is what a default binary F1 reports when class 0 was meant.
    """
    (*_, f1_0), (*_, f1_1) = _per_class()
    return counts.select(
        *by,
        (f1_0 * 100).alias("f1_class0"),
        (f1_1 * 100).alias("f1_class1"),
        ((f1_0 + f1_1) / 2 * 100).alias("f1_macro"),
        (_accuracy() * 100).alias("accuracy"),
    )


def precision_recall_at_k(
    df: DataFrame,
    k: int = 1,
    threshold: float = 0.0,
    predictions: str = "predictions",
    gold: str = "gold",
    by: Sequence[str] = (),
) -> DataFrame:
    """Examples, precision, recall and F1 over the top-k labels per example.

    `predictions` is array<struct<prob, label>> best first, `gold` an array of
    labels. Examples without gold labels are not counted.
    """
    top = F.slice(
        F.filter(predictions, lambda p: p["prob"] >= F.lit(float(threshold))), 1, k
    )
    said = F.transform(top, lambda p: p["label"])
    sums = (
        df.filter(F.size(gold) > 0)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_examples"),
            F.sum(F.size(F.array_intersect(said, F.col(gold)))).alias("_correct"),
            F.sum(F.size(said)).alias("_predicted"),
            F.sum(F.size(gold)).alias("_gold"),
        )
    )
    correct, predicted, expected = (
        F.coalesce(F.col(c), F.lit(0)) for c in ("_correct", "_predicted", "_gold")
    )
    return sums.select(
        *by,
        "n_examples",
        _ratio(correct, predicted).alias("precision"),
        _ratio(correct, expected).alias("recall"),
        _ratio(2.0 * correct, predicted + expected).alias("f1"),
    )
