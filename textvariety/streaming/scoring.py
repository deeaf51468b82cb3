"""Score texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textvariety.functions.text import KEEP_THRESHOLD, keep_above
from textvariety.operators.log_odds import (
    LogOddsModel,
    broadcast_scorer,
    score_positive,
)


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    files: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Stream of Parquet files appearing in folder `path`, by name pattern."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


_BATCH = "batch"


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    """What `score_stream` has written so far."""
    return spark.read.parquet(f"{out}/{_BATCH}=*")


def score_stream(
    stream: DataFrame,
    model: LogOddsModel,
    out: str,
    checkpoint: str,
    key: str,
    text: str = "text",
    score: str = "score",
    threshold: float = KEEP_THRESHOLD,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the rows scoring at or above the threshold to Parquet below `out`.

    Each micro-batch has its own folder and replaces it on a retry, so retries
    are exact; `read_scored` reads them all. The model is stored once. A small
    one travels to the texts, a larger one is joined batch by batch: rows, scores
    and layout are the same.
    """
    model = model.materialise()
    scorer = broadcast_scorer(model)

    def write(batch: DataFrame, batch_id: int) -> None:
        if scorer is not None:
            scored = scorer(batch, text, score)
        else:
            scored = score_positive(batch, model, key, text, score)
        kept = scored.filter(keep_above(score, threshold))
        kept.write.mode("overwrite").parquet(f"{out}/{_BATCH}={batch_id}")

    writer = stream.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
