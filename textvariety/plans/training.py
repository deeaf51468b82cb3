"""Train, evaluate and log a classifier."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.functions.hashing import SEED
from textvariety.functions.text import (
    FALLBACK_CLASS,
    fallback,
    known_label,
    labelled_line,
    long_enough_line,
    newline_to_space,
)
from textvariety.operators.log_odds import (
    FeatureConfig,
    LogOddsModel,
    score_positive,
    train_log_odds,
)
from textvariety.operators.logistic import stamped_name
from textvariety.operators.metrics import (
    classification_report,
    confusion,
    f1_variants,
)
from textvariety.operators.sampling import balance, stratified_split
from textvariety.sources.experiments import record_experiment
from textvariety.sources.scratch import store


def prepare(
    df: DataFrame,
    key: str,
    fraction: float,
    balanced: bool = False,
    cap: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Optionally balance the classes, then add `split` (train or test)."""
    rows = balance(df, key, cap, seed=seed) if balanced else df
    return stratified_split(rows, fraction, key, seed=seed)


def training_rows(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows whose labelled line is long enough to train on.

    Null texts give null lines and drop out. Evaluation rows skip this filter.
    """
    return df.filter(long_enough_line(labelled_line(text, label)))


def predict_class(
    df: DataFrame,
    model: LogOddsModel,
    key: str,
    text: str = "text",
    broadcast: bool = True,
) -> DataFrame:
    """Add `score` and `pred`; text without known features gets the fallback."""
    clean = df.withColumn(text, newline_to_space(text))
    scored = score_positive(clean, model, key, text, broadcast=broadcast)
    said = F.when(F.col("score") >= 0.5, 0).otherwise(FALLBACK_CLASS)
    return scored.withColumn("pred", fallback(text, said, FALLBACK_CLASS))


def evaluate(
    sets: Mapping[str, DataFrame],
    model: LogOddsModel,
    key: str,
    text: str = "text",
    broadcast: bool = True,
) -> DataFrame:
    """F1 variants per named evaluation set, all sets in one job.

    Sets may share keys.
    """
    counts = evaluation_counts(sets, model, key, text, broadcast)
    return f1_variants(counts, ["dataset"])


def evaluation_report(
    sets: Mapping[str, DataFrame], model: LogOddsModel, key: str, text: str = "text"
) -> DataFrame:
    """The report by class per named evaluation set."""
    counts = evaluation_counts(sets, model, key, text)
    return classification_report(counts, ["dataset"])


def evaluation_counts(
    sets: Mapping[str, DataFrame],
    model: LogOddsModel,
    key: str,
    text: str = "text",
    broadcast: bool = True,
) -> DataFrame:
    """tp, fn, fp, tn per named evaluation set."""
    rows = None
    for name, df in sets.items():
        part = df.filter(known_label("label")).select(
            F.lit(name).alias("dataset"), key, text, "label"
        )
        rows = part if rows is None else rows.unionByName(part)
    predicted = predict_class(rows, model, key, text, broadcast)
    return confusion(predicted, ["dataset"])


def train_and_evaluate(
    df: DataFrame,
    key: str,
    name: str,
    root: str,
    benchmarks: Mapping[str, DataFrame] | None = None,
    config: FeatureConfig | None = None,
    fraction: float = 0.1,
    balanced: bool = False,
    cap: int | None = None,
    script: str = "train",
) -> tuple[str, DataFrame]:
    """Split, train, evaluate in domain and on benchmarks, save and log.

    Returns the model path and the table of scores. `benchmarks` share the key
    column of `df`.
    """
    # Stored, so that training and evaluation see the same cut.
    rows = store(prepare(df, key, fraction, balanced, cap))
    config = config or FeatureConfig()
    train = training_rows(rows.filter("split = 'train'"))
    model = train_log_odds(train, config).materialise()
    path = f"{root.rstrip('/')}/models/{stamped_name(name)}"
    model.save(path)
    sets = {"in-domain": rows.filter("split = 'test'"), **(benchmarks or {})}
    scores = evaluate(sets, model, key)
    quality = {
        f"{r['dataset']} F1": f"{r['f1_class0']:.1f}%"
        for r in scores.select("dataset", "f1_class0").collect()
    }
    record_experiment(
        df.sparkSession,
        f"{root.rstrip('/')}/experiments",
        name,
        {**quality, **asdict(config)},
        script,
    )
    return path, scores
