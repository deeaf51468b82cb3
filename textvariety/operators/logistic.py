"""N-gram logistic regression on Spark ML, and its hyper-parameter search."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvariety.functions.features import char_ngrams, tokens, word_ngrams
from textvariety.functions.text import known_label, non_empty_text, strip
from textvariety.sources.scratch import discard, scratch_path, store


@dataclass(frozen=True)
class LogisticConfig:
    """Features and solver settings."""

    word_n: int = 1
    minn: int = 0
    maxn: int = 0
    bucket: int = 1 << 18
    min_count: int = 1
    epochs: int = 20
    penalty: float = 1e-4


def raw_features(config: LogisticConfig, text: Column | str = "text") -> Column:
    """Words, word n-grams and character n-grams of a text, with repeats."""
    words = tokens(text)
    out = words
    for n in range(2, config.word_n + 1):
        out = F.concat(out, word_ngrams(words, n))
    if config.maxn > 0:
        grams = F.transform(words, lambda w: char_ngrams(w, config.minn, config.maxn))
        out = F.concat(out, F.flatten(grams))
    return out


def train_logistic(
    df: DataFrame,
    config: LogisticConfig | None = None,
    text: str = "text",
    label: str = "label",
) -> PipelineModel:
    """Fit on the rows with a known label and some text.

    Features are hashed, rare buckets zeroed, and the rest averaged over the
    text; the solver's scaling makes up for the smallness of averages. The stored model is a plain PipelineModel; score it with
    `score_logistic` under the same config.
    """
    config = config or LogisticConfig()
    hashing = HashingTF(
        numFeatures=config.bucket, inputCol="features_raw", outputCol="counts"
    )
    texts = df.filter(known_label(label) & non_empty_text(text)).select(
        F.col(label).cast("double").alias("label"),
        raw_features(config, text).alias("features_raw"),
    )
    # Every pass of the solver reads files of hashed features instead of
    # splitting the texts again; adaptive execution sizes them by bytes.
    hashed = hashing.transform(texts).select("label", "counts")
    rows = store(hashed.hint("rebalance"))
    stages = []
    averaged = "counts"
    if config.min_count > 1:
        sums = rows.select(Summarizer.sum(F.col("counts")))
        frequent = sums.first()[0].toArray() >= config.min_count
        stages.append(
            ElementwiseProduct(
                scalingVec=Vectors.dense(frequent.astype(float)),
                inputCol="counts",
                outputCol="frequent",
            )
        )
        averaged = "frequent"
    stages.append(Normalizer(p=1.0, inputCol=averaged, outputCol="features"))
    stages.append(
        LogisticRegression(
            maxIter=config.epochs,
            regParam=config.penalty,
            aggregationDepth=2,
        )
    )
    fitted = Pipeline(stages=stages).fit(rows)
    fitted = PipelineModel([hashing, *fitted.stages])
    # A reloaded model carries no training summary, hence no session: such
    # models cannot be sent to tasks once the session has an Observation.
    discard(rows)
    path = scratch_path(df.sparkSession, "logistic")
    fitted.save(path)
    return PipelineModel.load(path)


def score_logistic(
    df: DataFrame,
    model: PipelineModel,
    config: LogisticConfig | None = None,
    text: str = "text",
    score: str = "score",
) -> DataFrame:
    """Add P(class 0); blank or null text scores 0. Nothing is shuffled."""
    config = config or LogisticConfig()
    raw = F.coalesce(
        raw_features(config, text), F.array().cast("array<string>")
    )
    out = model.transform(df.withColumn("features_raw", raw))
    p = vector_to_array("probability")[0]
    return out.select(
        *df.columns,
        F.when(strip(text) != "", p).otherwise(0.0).alias(score),
    )


def grid(**values: Iterable) -> list[dict]:
    """All combinations of the given settings."""
    return [dict(zip(values, point, strict=True)) for point in product(*values.values())]


def autotune(
    train: DataFrame,
    valid: DataFrame,
    space: Iterable[Mapping],
    base: LogisticConfig | None = None,
    text: str = "text",
    label: str = "label",
    parallelism: int = 2,
    budget_seconds: float | None = None,
) -> tuple[LogisticConfig, DataFrame]:
    """Best config by class-0 F1 on `valid`, and the table of trials.

    Trials are Spark jobs run `parallelism` at a time; both frames are stored
    once. With a budget, no trial but the first starts after it is used up, and
    the table holds the trials that ran. Report quality on rows that are in
    neither frame.
    """
    base = base or LogisticConfig()
    trials = [replace(base, **point) for point in space]
    started = time.monotonic()
    train = store(train.select(text, label))
    held_out = store(valid.filter(known_label(label)).select(text, label))
    evaluator = MulticlassClassificationEvaluator(
        metricName="fMeasureByLabel", metricLabel=0.0, labelCol="y"
    )

    def run(config: LogisticConfig) -> float | None:
        late = budget_seconds is not None and time.monotonic() - started > budget_seconds
        if late and config is not trials[0]:
            return None
        model = train_logistic(train, config, text, label)
        scored = score_logistic(held_out, model, config, text)
        said = F.when(F.col("score") >= 0.5, 0.0).otherwise(1.0)
        return evaluator.evaluate(
            scored.select(
                F.col(label).cast("double").alias("y"), said.alias("prediction")
            )
        )

    with ThreadPool(parallelism) as pool:
        quality = pool.map(run, trials)
    ran = [i for i, q in enumerate(quality) if q is not None]
    best = max(ran, key=lambda i: (quality[i], -i))
    rows = [
        (i, {k: str(v) for k, v in asdict(trials[i]).items()}, quality[i] * 100, i == best)
        for i in ran
    ]
    table = train.sparkSession.createDataFrame(
        rows, "trial int, settings map<string,string>, f1_class0 double, best boolean"
    )
    return trials[best], table


def stamped_name(name: str, now: datetime | None = None) -> str:
    """UTC time stamp and name of a saved model."""
    now = now or datetime.now(timezone.utc)
    return f"{now:%Y%m%d_%H%M%S}_{name}"


def save_model(model, root: str, name: str, now: datetime | None = None) -> str:
    """Save a model below `root` under a stamped name; returns the path."""
    path = f"{root.rstrip('/')}/{stamped_name(name, now)}"
    model.save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a saved Spark ML model."""
    return PipelineModel.load(path)
