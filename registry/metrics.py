"""Counts, metrics and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import (
    SQL_CLASSED,
    SQL_JUDGED,
    SQL_PREDICTIONS,
    SQL_SCORE,
    classed,
    judged,
    predictions,
    query,
    rounded,
    scored_documents,
    table,
    vowel_score,
)
from textvariety.functions.text import label_tag
from textvariety.operators import curves, metrics
from textvariety.operators.log_odds import predict_top_k
from textvariety.sources.scratch import scratch_path
from textvariety.sources.sinks import write_table

KEYS = ["model", "dataset"]
SQL_CONFUSION = (
    SQL_PREDICTIONS
    + """, c AS (
  SELECT model, dataset, count(*) FILTER (label = 0 AND pred = 0) AS tp,
    count(*) FILTER (label = 0 AND pred = 1) AS fn,
    count(*) FILTER (label = 1 AND pred = 0) AS fp,
    count(*) FILTER (label = 1 AND pred = 1) AS tn
  FROM predictions GROUP BY model, dataset)"""
)


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


SQL_METRICS = (
    SQL_CONFUSION
    + f""", m AS (
  SELECT *, {_div('tp', '(tp + fp)')} AS p0, {_div('tp', '(tp + fn)')} AS r0,
    {_div('2 * tp', '(2 * tp + fp + fn)')} AS f0,
    {_div('tn', '(tn + fn)')} AS p1, {_div('tn', '(tn + fp)')} AS r1,
    {_div('2 * tn', '(2 * tn + fp + fn)')} AS f1,
    tp + fn AS s0, fp + tn AS s1, tp + fn + fp + tn AS s,
    {_div('tp + tn', '(tp + fn + fp + tn)')} AS acc FROM c)"""
)


@query(
    "class_counts",
    f"""WITH {SQL_CLASSED} SELECT label, count(*) AS n,
      (SELECT count(*) FROM classed) AS total FROM classed GROUP BY label""",
)
def _class_counts(spark, sf_dir):
    return metrics.class_counts(classed(spark, sf_dir))


@query(
    "domain_counts",
    f"""WITH {SQL_CLASSED}
    SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS domain, count(*) AS n,
      count(*) FILTER (label = 0) AS n_class0, count(*) FILTER (label = 1) AS n_class1
    FROM classed GROUP BY ROLLUP (source)""",
)
def _domain_counts(spark, sf_dir):
    rows = classed(spark, sf_dir).select(F.col("source").alias("domain"), "label")
    return metrics.domain_counts(rows)


@query(
    "score_summary",
    f"""WITH s AS (SELECT {SQL_SCORE} AS score FROM documents)
    SELECT count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM s""",
)
def _score_summary(spark, sf_dir):
    return rounded(metrics.score_summary(scored_documents(spark, sf_dir)), "mean", "median")


@query(
    "kept_ratio",
    f"""WITH s AS (SELECT {SQL_SCORE} AS score FROM documents)
    SELECT count(*) AS total, count(*) FILTER (score >= 0.7::DOUBLE) AS kept,
      round(count(*) FILTER (score >= 0.7::DOUBLE) * 100.0::DOUBLE / count(*), 6) AS kept_pct
    FROM s""",
)
def _kept_ratio(spark, sf_dir):
    return rounded(metrics.kept_ratio(scored_documents(spark, sf_dir)), "kept_pct")


def _confusion_of(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), KEYS)


@query("confusion", f"WITH {SQL_CONFUSION} SELECT * FROM c")
def _confusion(spark, sf_dir):
    return _confusion_of(spark, sf_dir)


@query(
    "confusion_unmapped",
    f"""WITH {SQL_PREDICTIONS} SELECT model, dataset,
      count(*) FILTER (label = 0 AND pred = 0 AND doc_id % 3 <> 0) AS tp,
      count(*) FILTER (label = 0 AND (pred = 1 OR doc_id % 3 = 0)) AS fn,
      count(*) FILTER (label = 1 AND (pred = 0 OR doc_id % 3 = 0)) AS fp,
      count(*) FILTER (label = 1 AND pred = 1 AND doc_id % 3 <> 0) AS tn, count(*) AS rows
    FROM predictions GROUP BY model, dataset""",
)
def _confusion_unmapped(spark, sf_dir):
    """Every third prediction is null or of a foreign class: all rows still count."""
    foreign = F.when(F.col("doc_id") % 2 == 0, 7)
    said = F.when(F.col("doc_id") % 3 == 0, foreign).otherwise(F.col("pred"))
    counts = metrics.confusion(predictions(spark, sf_dir).withColumn("pred", said), KEYS)
    return counts.withColumn("rows", F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"))


@query(
    "classification_report",
    f"""WITH {SQL_METRICS}, report AS (
      SELECT model, dataset, 'PT-PT' AS row, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m
      UNION ALL SELECT model, dataset, 'PT-BR', p1, r1, f1, s1 FROM m
      UNION ALL SELECT model, dataset, 'accuracy', acc, acc, acc, s FROM m
      UNION ALL SELECT model, dataset, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM m
      UNION ALL SELECT model, dataset, 'weighted avg', (p0 * s0 + p1 * s1) / s,
        (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM m)
    SELECT model, dataset, row, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, support FROM report""",
)
def _classification_report(spark, sf_dir):
    report = metrics.classification_report(_confusion_of(spark, sf_dir), KEYS)
    return rounded(report, "precision", "recall", "f1")


@query(
    "f1_variants",
    f"""WITH {SQL_METRICS} SELECT model, dataset, round(f0 * 100, 6) AS f1_class0,
      round(f1 * 100, 6) AS f1_class1, round((f0 + f1) / 2 * 100, 6) AS f1_macro,
      round(acc * 100, 6) AS accuracy FROM m""",
)
def _f1_variants(spark, sf_dir):
    scores = metrics.f1_variants(_confusion_of(spark, sf_dir), KEYS)
    return rounded(scores, "f1_class0", "f1_class1", "f1_macro", "accuracy")


# Two labels per example are requested, those under 0.4 dropped.
@query(
    "precision_recall_at_k",
    f"""WITH {SQL_JUDGED}, n AS (
      SELECT dataset, label, score, (score >= 0.4::DOUBLE)::INT + (1 - score >= 0.4::DOUBLE)::INT AS said,
        CASE WHEN label = 0 THEN score >= 0.4::DOUBLE ELSE 1 - score >= 0.4::DOUBLE END::INT AS hit FROM judged),
    sums AS (SELECT dataset, count(*) AS n, sum(hit) AS hit, sum(said) AS said FROM n GROUP BY dataset)
    SELECT dataset, n AS n_examples, round({_div('hit', 'said')}, 6) AS precision,
      round({_div('hit', 'n')}, 6) AS recall, round({_div('2 * hit', '(said + n)')}, 6) AS f1 FROM sums""",
)
def _precision_recall_at_k(spark, sf_dir):
    rows = predict_top_k(judged(spark, sf_dir), k=2).withColumn(
        "gold", F.array(label_tag("label"))
    )
    meter = metrics.precision_recall_at_k(rows, k=2, threshold=0.4, by=["dataset"])
    return rounded(meter, "precision", "recall", "f1")


@query("throughput", "SELECT count(*) AS n_rows, true AS measured FROM documents")
def _throughput(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("score", vowel_score())
    seen = write_table(docs, scratch_path(spark, "scored"))
    return spark.range(1).select(
        F.lit(seen.rows).cast("bigint").alias("n_rows"),
        F.lit(seen.rows_per_second > 0).alias("measured"),
    )


SQL_CURVE = (
    SQL_JUDGED
    + """, pool AS (SELECT dataset, score, label FROM judged
    UNION ALL SELECT 'pooled', score, label FROM judged),
points AS (SELECT dataset, score AS threshold, count(*) AS n,
    count(*) FILTER (label = 0) AS positives FROM pool GROUP BY dataset, score),
upto AS (SELECT *, sum(n) OVER w AS cum_n, sum(positives) OVER w AS tp,
    sum(positives) OVER (PARTITION BY dataset) AS every
  FROM points WINDOW w AS (PARTITION BY dataset ORDER BY threshold DESC)),
curve AS (SELECT dataset, threshold, n, positives, tp::BIGINT AS tp, (cum_n - tp)::BIGINT AS fp,
    tp / cum_n AS precision, CASE WHEN every = 0 THEN 1.0 ELSE tp / every END AS recall FROM upto)"""
)


def _curve(spark, sf_dir):
    return curves.pr_curve(curves.pool(judged(spark, sf_dir)))


@query(
    "pr_curve",
    f"""WITH {SQL_CURVE}
    SELECT dataset, threshold, n, positives, tp, fp, round(precision, 6) AS precision,
      round(recall, 6) AS recall FROM curve
    UNION ALL SELECT DISTINCT dataset, 2.0, 0, 0, 0, 0, 1.0, 0.0 FROM curve""",
)
def _pr_curve(spark, sf_dir):
    # Comparable without nulls: the terminal point gets a threshold of 2.
    curve = _curve(spark, sf_dir).fillna({"threshold": 2.0})
    return rounded(curve, "precision", "recall")


@query(
    "average_precision",
    f"""WITH {SQL_CURVE}, steps AS (
      SELECT dataset, precision * (recall - lag(recall, 1, 0.0) OVER (
        PARTITION BY dataset ORDER BY threshold DESC)) AS area FROM curve)
    SELECT dataset, round(sum(area), 6) AS average_precision FROM steps GROUP BY dataset""",
)
def _average_precision(spark, sf_dir):
    return rounded(curves.average_precision(_curve(spark, sf_dir)), "average_precision")


@query(
    "operating_points",
    f"""WITH {SQL_CURVE}, targets AS (
      SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS target),
    reached AS (
      SELECT dataset, target, threshold, precision, recall, row_number() OVER (
        PARTITION BY dataset, target ORDER BY threshold) AS place
      FROM curve JOIN targets ON threshold >= target)
    SELECT dataset, target, threshold, round(precision, 6) AS precision,
      round(recall, 6) AS recall FROM reached WHERE place = 1""",
)
def _operating_points(spark, sf_dir):
    return rounded(curves.operating_points(_curve(spark, sf_dir)), "precision", "recall")
