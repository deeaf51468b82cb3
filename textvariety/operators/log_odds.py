"""Relational text classifier: smoothed class log-odds per feature.

weight(f) = ln((n0+1)/(N0+V)) - ln((n1+1)/(N1+V)), n0/n1 being the class counts
of feature f, N0/N1 their totals and V the number of features. The score of a
text is the logistic of (mean weight of its known features + ln(D0/D1)), D0/D1
being the document counts; a mean, so long texts do not saturate. A text
without known features scores 0.
"""

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textvariety.functions.features import (
    bucket_name,
    char_ngrams,
    tokens,
    word_ngrams,
)
from textvariety.functions.text import NEGATIVE_TAG, POSITIVE_TAG, known_label
from textvariety.operators.feature_blocks import feature_sums
from textvariety.sources.scratch import store, scratch_root

SCORE_DIGITS = 6
# Weights up to this many features and bytes are sent to every executor. Each of
# its Python workers holds them and a table to look them up, some ten times as much.
BROADCAST_FEATURES = 2_000_000
BROADCAST_BYTES = 32 << 20
# Rows of a batch whose occurrences are summed at a time.
SUMMED_ROWS = 256
# Names no input column may have.
_ROW, _LISTED = "__textvariety_row", "__textvariety_features"


@dataclass(frozen=True)
class FeatureConfig:
    """Which features a text has. Defaults: single words."""

    min_count: int = 2
    word_n: int = 1
    minn: int = 0
    maxn: int = 0
    bucket: int = 1_000_000

    def features(self, text: Column | str) -> Column:
        """All features of a text with repeats, n-grams named by bucket."""
        words = tokens(text)
        out = words
        for n in range(2, self.word_n + 1):
            grams = word_ngrams(words, n)
            out = F.concat(
                out, F.transform(grams, lambda g: bucket_name(g, self.bucket))
            )
        if self.maxn > 0:
            grams = F.flatten(
                F.transform(words, lambda w: char_ngrams(w, self.minn, self.maxn))
            )
            out = F.concat(
                out, F.transform(grams, lambda g: bucket_name(g, self.bucket))
            )
        return out


@dataclass(frozen=True)
class LogOddsModel:
    """`weights` (feature, n0, n1, weight), the prior ln(D0/D1) and its config."""

    weights: DataFrame
    prior: Column
    config: FeatureConfig

    def materialise(self) -> "LogOddsModel":
        """The same model computed once: weights stored, prior a number."""
        return LogOddsModel(store(self.weights), self.known_prior(), self.config)

    def known_prior(self) -> Column:
        """The prior as a number."""
        value = self.weights.sparkSession.range(1).select(self.prior).first()[0]
        return F.lit(value).cast("double")

    def pruned(self, cutoff: int) -> "LogOddsModel":
        """Keep the `cutoff` weights of largest magnitude."""
        return LogOddsModel(
            prune_features(self.weights, cutoff), self.prior, self.config
        )

    def save(self, path: str) -> None:
        """Write weights and settings below `path`."""
        spark = self.weights.sparkSession
        self.weights.write.mode("errorifexists").parquet(f"{path}/weights")
        settings = [F.lit(v).alias(k) for k, v in asdict(self.config).items()]
        meta = spark.range(1).select(self.prior.alias("prior"), *settings)
        meta.coalesce(1).write.mode("errorifexists").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LogOddsModel":
        """Read a saved model."""
        meta = spark.read.parquet(f"{path}/settings").first().asDict()
        prior = F.lit(meta.pop("prior")).cast("double")
        weights = spark.read.parquet(f"{path}/weights")
        return LogOddsModel(weights, prior, FeatureConfig(**meta))


def train_log_odds(
    df: DataFrame,
    config: FeatureConfig | None = None,
    text: str = "text",
    label: str = "label",
) -> LogOddsModel:
    """Fit on the rows with a known label; lazy.

    One scan counts features per class with map-side combine, so a frequent
    feature costs each task one row. Totals are scalar subqueries.
    """
    config = config or FeatureConfig()
    known = df.filter(known_label(label))
    counts = (
        known.select(label, F.explode(config.features(text)).alias("feature"))
        .groupBy("feature")
        .agg(
            F.count_if(F.col(label) == 0).alias("n0"),
            F.count_if(F.col(label) == 1).alias("n1"),
        )
        .filter(F.col("n0") + F.col("n1") >= config.min_count)
    )
    totals = counts.agg(
        F.struct(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("v")
        ).alias("t")
    ).scalar()
    share0 = F.ln((F.col("n0") + 1) / (totals["n0"] + totals["v"]))
    share1 = F.ln((F.col("n1") + 1) / (totals["n1"] + totals["v"]))
    weights = counts.withColumn("weight", share0 - share1)
    docs0 = F.count_if(F.col(label) == 0)
    docs1 = F.count_if(F.col(label) == 1)
    one_class = F.raise_error(F.lit("a classifier needs rows of both classes"))
    both = F.when((docs0 > 0) & (docs1 > 0), docs0 / F.nullif(docs1, F.lit(0)))
    prior = known.agg(
        F.ln(F.coalesce(both, one_class.cast("double"))).alias("prior")
    ).scalar()
    return LogOddsModel(weights, prior, config)


def prune_features(weights: DataFrame, cutoff: int) -> DataFrame:
    """The `cutoff` weights of largest magnitude, ties by feature name."""
    return weights.orderBy(F.abs("weight").desc(), "feature").limit(cutoff)


def _logistic(mean_weight: Column, prior: Column) -> Column:
    p = F.round(1 / (1 + F.exp(-(mean_weight + prior))), SCORE_DIGITS)
    return F.coalesce(p, F.lit(0.0))


def score_positive(
    df: DataFrame,
    model: LogOddsModel,
    key: str,
    text: str = "text",
    score: str = "score",
    broadcast: bool = True,
) -> DataFrame:
    """Add P(class 0) to every row, whatever `key` holds.

    The model decides how: weights within the broadcast bounds travel to the
    texts and nothing is shuffled; larger ones are joined feature by feature,
    after the rows were stored with a number of their own, so null and repeated
    keys do no harm. Both give the same rows and scores. Without `broadcast`
    weights of any size are joined.
    """
    model = model.materialise()
    scorer = broadcast_scorer(model) if broadcast else None
    if scorer is not None:
        return scorer(df, text, score)
    free_of(df, _ROW)
    rows = store(df.withColumn(_ROW, F.monotonically_increasing_id()))
    scores = score_by_join(rows, model, _ROW, text, score)
    kept = [c for c in df.columns if c != score]
    return rows.select(_ROW, *kept).join(scores, _ROW).select(*kept, score)


def free_of(df: DataFrame, *names: str) -> None:
    """Refuse a table that has one of the names used inside."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns reserved for the library: {sorted(taken)}")


def score_by_join(
    df: DataFrame,
    model: LogOddsModel,
    key: str,
    text: str = "text",
    score: str = "score",
) -> DataFrame:
    """(key, score) through a join of features and weights of any size.

    `key` must tell rows apart and hold no null. Texts meet the weights of their
    features block by block, see feature_blocks.
    """
    table = model.weights.select(
        "feature", F.lit(None).cast("array<int>").alias("at"), F.array("weight").alias("value")
    )
    met = feature_sums(df, table, model.config.features, 1, key, text)
    sums = met.groupBy(key).agg(
        (F.sum(F.get("sums", F.lit(0))) / F.sum("n")).alias("_mean")
    )
    every_key = df.select(key).join(sums, key, "left")
    return every_key.select(key, _logistic(F.col("_mean"), model.prior).alias(score))


def broadcast_scorer(
    model: LogOddsModel, limit: int = BROADCAST_FEATURES
) -> Callable[[DataFrame, str, str], DataFrame] | None:
    """A function (df, text, score) adding the score, or None for more than
    `limit` weights or BROADCAST_BYTES of them.

    Features are looked up batch by batch in Arrow; rows stay where they are, so
    this also works on streams. Plain words need no feature array: Arrow splits
    the text itself.
    """
    size = F.sum(F.octet_length("feature") + 16)
    n, taken = model.weights.agg(F.count("*"), size).first()
    if n > limit or (taken or 0) > BROADCAST_BYTES:
        return None
    table = model.weights.select("feature", "weight").toArrow()
    context = model.weights.sparkSession.sparkContext
    shared = context.broadcast(table.combine_chunks())
    # A number, not a subquery: a stream would run that in every micro-batch.
    prior = model.known_prior()
    words_only = model.config.word_n == 1 and model.config.maxn == 0
    mean_weight = F.arrow_udf(_mean_weight_function(shared, words_only), "double")

    def add_score(df: DataFrame, text: str, score: str) -> DataFrame:
        if words_only:
            return df.withColumn(score, _logistic(mean_weight(text), prior))
        # Spark 4.1 fails to hand expressions with nested lambdas to an Arrow
        # function. The one-row generator keeps the two apart.
        free_of(df, _LISTED)
        listed = F.explode(F.array(model.config.features(text)))
        return (
            df.withColumn(_LISTED, listed)
            .withColumn(score, _logistic(mean_weight(_LISTED), prior))
            .drop(_LISTED)
        )

    return add_score


def _mean_weight_function(shared, split: bool):
    def mean_weight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = shared.value.column("feature").combine_chunks()
        weights = np.append(shared.value.column("weight").to_numpy(), 0.0)
        for batch in batches:
            # The same ASCII blanks as features.TOKEN_SEPARATOR.
            features = pc.ascii_split_whitespace(batch) if split else batch
            found = pc.index_in(features.flatten(), value_set=names)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            # Unknown features point at the extra zero weight.
            index = found.fill_null(len(names)).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(features), 0).to_numpy()
            ends = np.concatenate(([0], np.cumsum(sizes)))
            means, counts = np.zeros(len(sizes)), np.zeros(len(sizes))
            for i in range(0, len(sizes), SUMMED_ROWS):
                here = slice(i, i + SUMMED_ROWS)
                n = len(sizes[here])
                part = slice(ends[i], ends[i + n])
                rows = np.repeat(np.arange(n), sizes[here])
                sums = np.bincount(rows, weights=weights[index[part]], minlength=n)
                counts[here] = np.bincount(rows, weights=known[part], minlength=n)
                means[here] = sums / np.maximum(counts[here], 1)
            yield pa.array(means, mask=counts == 0)

    return mean_weight


def predict_top_k(
    df: DataFrame, k: int = 2, threshold: float = 0.0, score: str = "score"
) -> DataFrame:
    """Add `predictions`: at most k (prob, label) pairs, best first.

    Equal probabilities put the positive label first.
    """
    p = F.col(score)
    pairs = F.array(
        F.struct(p.alias("prob"), F.lit(POSITIVE_TAG).alias("label")),
        F.struct((1 - p).alias("prob"), F.lit(NEGATIVE_TAG).alias("label")),
    )
    passed = F.filter(pairs, lambda x: x["prob"] >= F.lit(float(threshold)))
    # Descending structs also place the alphabetically later tag first on ties.
    best = F.slice(F.sort_array(passed, asc=False), 1, k)
    return df.withColumn("predictions", best)
