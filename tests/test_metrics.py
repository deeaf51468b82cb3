"""Metrics and curves, with published figures as goldens."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from textvariety.functions.text import label_tag
from textvariety.operators import curves, metrics
from textvariety.operators.log_odds import predict_top_k
from textvariety.operators.reports import baseline_delta, leaderboard

# Published confusion counts and the figures they must give.
COUNTS = [("a", 237, 32, 130, 458), ("b", 1937, 677, 542, 2070)]
FIGURES = {"a": (84.9722, 79.7502, 81.0968), "b": (77.2532, 76.6592, 76.6743)}
REPORT_A = {
    "PT-PT": (0.65, 0.88, 0.75, 269),
    "PT-BR": (0.93, 0.78, 0.85, 588),
    "macro avg": (0.79, 0.83, 0.80, 857),
    "weighted avg": (0.84, 0.81, 0.82, 857),
}
REPORT_B = {
    "PT-PT": (0.78, 0.74, 0.76, 2614),
    "PT-BR": (0.75, 0.79, 0.77, 2612),
    "macro avg": (0.77, 0.77, 0.77, 5226),
    "weighted avg": (0.77, 0.77, 0.77, 5226),
}


def counts(spark, rows=COUNTS):
    return spark.createDataFrame(rows, "dataset string, tp long, fn long, fp long, tn long")


def test_f1_variants_reproduce_published_figures(spark):
    for r in metrics.f1_variants(counts(spark), ["dataset"]).collect():
        got = tuple(round(r[c], 4) for c in ("f1_class1", "f1_macro", "accuracy"))
        assert got == FIGURES[r["dataset"]]


@pytest.mark.parametrize(("name", "want"), [("a", REPORT_A), ("b", REPORT_B)])
def test_classification_report_reproduces_published_tables(spark, name, want):
    report = metrics.classification_report(counts(spark), ["dataset"])
    rows = {r["row"]: r for r in report.filter(F.col("dataset") == name).collect()}
    for row, values in want.items():
        got = tuple(round(rows[row][c], 2) for c in ("precision", "recall", "f1"))
        assert (*got, rows[row]["support"]) == values
    assert len(rows) == 5


def test_zero_denominators_give_zero(spark):
    empty = counts(spark, [("one class", 0, 5, 0, 0), ("none", 0, 0, 0, 0)])
    report = metrics.classification_report(empty, ["dataset"]).collect()
    assert {r["f1"] for r in report} == {0.0}


def test_confusion_agrees_with_spark_ml(spark):
    rows = [(i % 2, (i // 3) % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "label int, pred int")
    ours = metrics.f1_variants(metrics.confusion(df)).first()
    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in ("label", "pred")))
    judge = MulticlassClassificationEvaluator(
        predictionCol="pred", metricName="fMeasureByLabel", metricLabel=0.0
    )
    assert ours["f1_class0"] == pytest.approx(judge.evaluate(doubles) * 100)


def test_domain_counts_with_a_null_domain(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), (None, 2)], "domain string, label int")
    got = sorted(map(tuple, metrics.domain_counts(df).collect()), key=str)
    assert got == sorted([("a", 2, 1, 1), (None, 1, 0, 0), ("TOTAL", 3, 1, 1)], key=str)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1).map(lambda x: round(x, 3)), min_size=1, max_size=80))
def test_score_summary_is_exact(spark, scores):
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    got = metrics.score_summary(df).first()
    assert got["n"] == len(scores)
    assert got["mean"] == pytest.approx(np.mean(scores))
    assert got["median"] == pytest.approx(np.median(scores))


def test_score_summary_of_nothing(spark):
    got = metrics.score_summary(spark.createDataFrame([], "score double")).first()
    assert tuple(got) == (None, None, None)


def test_kept_ratio_of_nothing(spark):
    got = metrics.kept_ratio(spark.createDataFrame([], "score double")).first()
    assert tuple(got) == (0, 0, None)


def python_curve(scores, positive):
    points, every = [], sum(positive)
    for t in sorted(set(scores), reverse=True):
        hit = sum(p for s, p in zip(scores, positive) if s >= t)
        said = sum(s >= t for s in scores)
        points.append((t, hit / said, hit / every if every else 1.0))
    return points


def curve_of(spark, rows):
    df = spark.createDataFrame(rows, "dataset string, score double, label int")
    return curves.pr_curve(df)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=1, max_size=100))
def test_curve_and_average_precision_equal_python(spark, rows):
    scores = [s / 20 for s, _ in rows]
    positive = [1 - label for _, label in rows]
    curve = curve_of(spark, [("d", s, 1 - p) for s, p in zip(scores, positive)])
    got = curve.filter("threshold IS NOT NULL").orderBy(F.desc("threshold")).collect()
    want = python_curve(scores, positive)
    points = [(r["threshold"], r["precision"], r["recall"]) for r in got]
    assert np.array(points) == pytest.approx(np.array(want))
    area, before = 0.0, 0.0
    for _, precision, recall in want:
        area, before = area + (recall - before) * precision, recall
    ap = curves.average_precision(curve).first()["average_precision"]
    assert ap == pytest.approx(area) and 0 <= ap <= 1 + 1e-9
    terminal = curve.filter("threshold IS NULL").collect()
    assert [(r["precision"], r["recall"]) for r in terminal] == [(1.0, 0.0)]


def test_curve_without_a_positive(spark):
    curve = curve_of(spark, [("d", 0.5, 1), ("d", 0.2, 1)])
    assert {r["recall"] for r in curve.filter("threshold IS NOT NULL").collect()} == {1.0}
    assert curves.average_precision(curve).first()["average_precision"] == 0.0


def test_operating_points(spark):
    curve = curve_of(spark, [("d", 0.7, 0), ("d", 0.85, 1), ("d", 0.55, 1), ("e", 0.1, 0)])
    got = curves.operating_points(curve).orderBy("target").collect()
    # Nothing reaches 0.9, and data set e reaches no target at all.
    assert [(r["target"], r["threshold"]) for r in got] == [
        (0.5, 0.55), (0.6, 0.7), (0.7, 0.7), (0.8, 0.85)
    ]
    assert {r["dataset"] for r in got} == {"d"}


def test_pool_doubles_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, x int")
    got = sorted(map(tuple, curves.pool(df).collect()))
    assert got == [("a", 1), ("b", 2), ("pooled", 1), ("pooled", 2)]


def test_precision_recall_at_k(spark):
    df = spark.createDataFrame([(0.9, 0), (0.4, 0), (0.2, 1)], "score double, label int")
    rows = predict_top_k(df, 2).withColumn("gold", F.array(label_tag("label")))
    one = metrics.precision_recall_at_k(rows, k=1).first()
    assert tuple(one) == pytest.approx((3, 2 / 3, 2 / 3, 2 / 3))
    two = metrics.precision_recall_at_k(rows, k=2).first()
    assert tuple(two) == pytest.approx((3, 0.5, 1.0, 2 / 3))
    none = metrics.precision_recall_at_k(rows, k=2, threshold=0.95).first()
    assert tuple(none) == (3, 0.0, 0.0, 0.0)


def test_leaderboard_and_deltas(spark):
    rows = [("m", "a", 0, 0), ("m", "a", 1, 0), ("m", "b", 0, 0), ("n", "a", 0, 1)]
    df = spark.createDataFrame(rows, "model string, dataset string, label int, pred int")
    board = {r["model"]: r for r in leaderboard(df, ["a", "b"]).collect()}
    assert board["m"]["a"] == pytest.approx(200 / 3) and board["m"]["b"] == 100.0
    assert board["n"]["a"] == 0.0 and board["n"]["b"] is None
    scores = metrics.f1_variants(metrics.confusion(df, ["model", "dataset"]), ["model", "dataset"])
    base = spark.createDataFrame(
        [("a", 50.0, 75.0)], "dataset string, published double, best_known double"
    )
    delta = {r["model"]: r for r in baseline_delta(scores, base).collect()}
    assert delta["m"]["delta_published"] == pytest.approx(200 / 3 - 50)
    assert delta["n"]["delta_best"] == -75.0
