"""Append-only log of runs."""

from __future__ import annotations

import inspect
from collections.abc import Mapping
from datetime import datetime, timezone
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "name string, ts timestamp_ntz, script string, details map<string,string>,"
    " at timestamp_ntz"
)


def record_experiment(
    spark: SparkSession,
    path: str,
    name: str,
    details: Mapping[str, object],
    script: str | None = None,
    now: datetime | None = None,
) -> None:
    """Append one run: name, UTC minute, calling script, ordered details.

    The full time is kept as `at`: runs within a minute keep their order.
    """
    now = now or datetime.now(timezone.utc)
    script = script or PurePath(inspect.stack()[1].filename).name
    pairs = [F.lit(str(v)) for pair in details.items() for v in pair]
    full = now.replace(tzinfo=None)
    minute = full.replace(second=0, microsecond=0)
    # A map expression keeps its order; a Python dict would lose it on the way.
    row = spark.range(1).select(
        F.lit(name).alias("name"),
        F.lit(f"{minute:%Y-%m-%d %H:%M}").cast("timestamp_ntz").alias("ts"),
        F.lit(script).alias("script"),
        F.create_map(*pairs).cast("map<string,string>").alias("details"),
        F.lit(full.isoformat(sep=" ")).cast("timestamp_ntz").alias("at"),
    )
    row.coalesce(1).write.mode("append").parquet(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """All recorded runs."""
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def latest_runs(log: DataFrame) -> DataFrame:
    """Details of the last run of each name."""
    return log.groupBy("name").agg(
        F.max("ts").alias("ts"), F.max_by("details", _order(log)).alias("details")
    )


def _order(log: DataFrame) -> Column:
    """Minute and full time; logs of older runs have the minute only."""
    at = F.col("at") if "at" in log.columns else F.lit(None)
    return F.struct("ts", F.coalesce(at, F.col("ts")), "script")


def experiment_history(log: DataFrame, metric: str) -> DataFrame:
    """Runs in time order per name, with one metric as a number.

    `value` is the leading number of the metric text ('89.0%' is 89.0), null
    where the run has none. `is_latest` and `is_best` mark the last run and the
    highest value (the earlier on ties). Columns: name, run, ts, value,
    is_latest, is_best.
    """
    number = F.regexp_extract(F.col("details")[metric], r"^\s*([-+]?[0-9.]+)", 1)
    runs = log.withColumn("_n", number).select(
        "name",
        "ts",
        _order(log).alias("__textvariety_order"),
        F.when(F.col("_n") != "", F.col("_n").cast("double")).alias("value"),
    )
    name = Window.partitionBy("name")
    in_time = name.orderBy("__textvariety_order")
    best_first = name.orderBy(F.col("value").desc_nulls_last(), "__textvariety_order")
    return runs.select(
        "name",
        F.row_number().over(in_time).alias("run"),
        "ts",
        "value",
        (F.row_number().over(in_time) == F.count("*").over(name)).alias("is_latest"),
        (
            (F.row_number().over(best_first) == 1) & F.col("value").isNotNull()
        ).alias("is_best"),
    )
