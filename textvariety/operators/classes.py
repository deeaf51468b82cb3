"""Classifier over any number of classes: smoothed log-likelihoods per
(feature, class), a score vector per text, top k over classes.

For class c with N_c feature occurrences in training, D_c documents and V
features in the vocabulary (features seen `min_count` times in all):

    weight(f, c) = ln((n_fc + 1) / (N_c + V)),  default_c = ln(1 / (N_c + V))
    prior_c = ln(D_c / D)
    s_c(text) = prior_c + mean over the text's known feature occurrences of
                weight(f, c)      (prior_c alone for a text without any)
    P(c | text) = softmax over classes of s_c

Only pairs seen in training are stored, as delta = weight - default_c: the
mean of weights is default_c plus the mean of deltas, so a text's vector is one
sparse product of its feature counts with that table; it is taken block by
block of texts, see feature_blocks. A mean, as in the
two-class model, keeps long texts from saturating.

Defined results: rows with a null label are not learned from; a null or empty
text gets the priors alone; repeated rows count as often as they occur; equal
probabilities rank the smaller label first; a single class gets probability 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvariety.operators.feature_blocks import feature_sums
from textvariety.operators.log_odds import FeatureConfig, free_of
from textvariety.sources.scratch import store

SCORE_DIGITS = 6
# Classes travel inside every row's plan as one literal array up to this many.
MAX_CLASSES = 10_000
_KEY = "__textvariety_key"


@dataclass(frozen=True)
class ClassModel:
    """`weights` (feature, label, n, weight, delta), `classes` (label, docs,
    total, prior, default) and the feature settings."""

    weights: DataFrame
    classes: DataFrame
    config: FeatureConfig


def train_log_odds_classes(
    df: DataFrame, config: FeatureConfig | None = None, text: str = "text", label: str = "label"
) -> ClassModel:
    """Fit on rows with a label; both tables are stored."""
    config = config or FeatureConfig()
    known = df.filter(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), F.col(text).alias("text")
    )
    pairs = (
        known.select("label", F.explode(config.features("text")).alias("feature"))
        .groupBy("feature", "label")
        .agg(F.count("*").alias("n"))
    )
    pairs = store(pairs)
    vocabulary = pairs.groupBy("feature").agg(F.sum("n").alias("seen")).filter(
        F.col("seen") >= config.min_count
    )
    kept = store(pairs.join(vocabulary.select("feature"), "feature"))
    size = kept.select("feature").distinct().count()
    docs = known.groupBy("label").agg(F.count("*").alias("docs"))
    totals = kept.groupBy("label").agg(F.sum("n").alias("total"))
    every = docs.join(totals, "label", "left").fillna(0, ["total"])
    all_docs = docs.agg(F.sum("docs")).scalar()
    classes = store(
        every.select(
            "label",
            "docs",
            F.col("total").cast("long").alias("total"),
            F.ln(F.col("docs") / all_docs).alias("prior"),
            (-F.ln(F.col("total") + F.lit(size))).alias("default"),
        )
    )
    if classes.count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    # At most MAX_CLASSES rows, checked above.
    by_class = F.broadcast(classes.select("label", "total", "default"))
    weight = F.ln((F.col("n") + 1) / (F.col("total") + F.lit(size)))
    weights = kept.join(by_class, "label").select(
        "feature", "label", "n", weight.alias("weight"), (weight - F.col("default")).alias("delta")
    )
    return ClassModel(store(weights), classes, config)


def _class_array(model: ClassModel) -> Column:
    """All classes as one literal array of (label, base = prior + default)."""
    rows = model.classes.select("label", "prior", "default").orderBy("label")
    if rows.count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    listed = [
        F.struct(F.lit(r["label"]).alias("label"), F.lit(r["prior"] + r["default"]).alias("base"),
                 F.lit(r["prior"]).alias("prior"))
        for r in rows.collect()
    ]
    return F.array(*listed)


def score_vectors(df: DataFrame, model: ClassModel, key: str, text: str = "text") -> DataFrame:
    """(key, scores): per row of `df` an array of (label, prob), all classes,
    best first. `key` must tell rows apart."""
    free_of(df, _KEY)
    rows = df.select(F.col(key).alias(_KEY), F.col(text).alias("text"))
    names = model.classes.select("label").orderBy("label").collect()
    labels = F.array(*(F.lit(r["label"]) for r in names))
    # At most MAX_CLASSES rows, checked in training.
    places = F.broadcast(
        model.classes.select(
            "label", (F.array_position(labels, F.col("label")) - 1).cast("int").alias("place")
        )
    )
    table = (
        model.weights.join(places, "label")
        .groupBy("feature")
        .agg(F.collect_list(F.struct("place", "delta")).alias("e"))
        .select("feature", F.col("e.place").alias("at"), F.col("e.delta").alias("value"))
    )
    met = feature_sums(rows, table, model.config.features, len(names), _KEY)
    zeros = F.array_repeat(F.lit(0.0), len(names))
    added = F.aggregate(
        F.collect_list("sums"), zeros, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    )
    by_row = met.groupBy(_KEY).agg(F.sum("n").alias("known"), added.alias("sums"))
    every = rows.select(_KEY).join(by_row, _KEY, "left")
    classes = _class_array(model)

    def score(c: Column, i: Column) -> Column:
        mean = c["base"] + F.get("sums", i) / F.col("known")
        s = F.when(F.col("known") > 0, mean).otherwise(c["prior"])
        return F.struct(c["label"].alias("label"), s.alias("s"))

    raw = F.transform(classes, score)
    top = F.array_max(F.transform(raw, lambda x: x["s"]))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + F.exp(x["s"] - top))
    probs = F.transform(
        raw,
        lambda x: F.struct(
            F.round(F.exp(x["s"] - top) / total, SCORE_DIGITS).alias("prob"), x["label"].alias("label")
        ),
    )
    ordered = F.array_sort(
        probs,
        lambda a, b: F.when(a["prob"] > b["prob"], -1)
        .when(a["prob"] < b["prob"], 1)
        .when(a["label"] < b["label"], -1)
        .when(a["label"] > b["label"], 1)
        .otherwise(0),
    )
    return every.select(F.col(_KEY).alias(key), ordered.alias("scores"))


def predict_top_k_classes(
    df: DataFrame, model: ClassModel, key: str, k: int = 3, text: str = "text"
) -> DataFrame:
    """(key, rank, label, prob): the k likeliest classes of every row."""
    vectors = score_vectors(df, model, key, text)
    return vectors.select(key, F.posexplode(F.slice("scores", 1, k))).select(
        key, (F.col("pos") + 1).cast("int").alias("rank"), "col.label", "col.prob"
    )
