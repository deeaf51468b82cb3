"""Comparisons of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import predictions, query, rounded
from registry.metrics import KEYS, SQL_METRICS
from textvariety.operators.metrics import confusion, f1_variants
from textvariety.operators.reports import baseline_delta, leaderboard

DATASETS = ["de", "en", "es", "fr"]


@query(
    "leaderboard",
    f"""WITH {SQL_METRICS} SELECT model, {', '.join(
        f"round(max(f0 * 100) FILTER (dataset = '{d}'), 6) AS {d}" for d in DATASETS)}
    FROM m GROUP BY model""",
)
def _leaderboard(spark, sf_dir):
    return rounded(leaderboard(predictions(spark, sf_dir), DATASETS), *DATASETS)


# The published value is the mean over models, the best known the maximum.
@query(
    "baseline_delta",
    f"""WITH {SQL_METRICS}, f AS (SELECT model, dataset, f0 * 100 AS f FROM m),
    b AS (SELECT dataset, avg(f) AS published, max(f) AS best FROM f GROUP BY dataset)
    SELECT model, dataset, round(f, 6) AS measured, round(f - published, 6) AS delta_published,
      round(f - best, 6) AS delta_best FROM f JOIN b USING (dataset)""",
)
def _baseline_delta(spark, sf_dir):
    scores = f1_variants(confusion(predictions(spark, sf_dir), KEYS), KEYS)
    baseline = scores.groupBy("dataset").agg(
        F.avg("f1_class0").alias("published"), F.max("f1_class0").alias("best_known")
    )
    delta = baseline_delta(scores, baseline)
    return rounded(delta, "measured", "delta_published", "delta_best")
