"""Score a web table and keep the rows above a threshold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvariety.functions.hashing import SEED
from textvariety.functions.text import KEEP_THRESHOLD, keep_above
from textvariety.operators.log_odds import LogOddsModel, free_of, score_positive
from textvariety.operators.metrics import kept_ratio, score_summary
from textvariety.operators.sampling import sample_n
from textvariety.sources.sinks import Throughput, write_table

SAMPLE_SIZE = 25
_FLAG = "kept"


@dataclass(frozen=True)
class FilterRun:
    """A finished filter job. Every report reads the written table."""

    spark: SparkSession
    path: str
    key: str
    score: str
    threshold: float
    throughput: Throughput

    @cached_property
    def _scored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    @property
    def kept_path(self) -> str:
        """Folder with nothing but the kept rows."""
        return f"{self.path}/{_FLAG}=true"

    def kept(self) -> DataFrame:
        """Kept rows, all input columns and the score."""
        # Folder names come back as text; the comparison prunes the other folder.
        return self._scored.filter(F.col(_FLAG) == "true").drop(_FLAG)

    def summary(self) -> DataFrame:
        """One row: total, kept, kept_pct, mean and exact median score."""
        scores = self._scored.select(self.score)
        moments = score_summary(scores, self.score).drop("n")
        both = kept_ratio(scores, self.score, self.threshold)
        row = moments.select(F.struct("mean", "median").alias("m")).scalar()
        return both.withColumns({"mean": row["mean"], "median": row["median"]})

    def sample(self, column: str, n: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
        """One column of up to n kept rows."""
        kept = self.kept().select(*dict.fromkeys([self.key, column]))
        return sample_n(kept, self.key, n, seed).select(column)


def filter_corpus(
    df: DataFrame,
    model: LogOddsModel,
    path: str,
    key: str,
    text: str = "text",
    score: str = "score",
    threshold: float = KEEP_THRESHOLD,
) -> FilterRun:
    """Score every row once and write the result below `path`.

    Kept rows are written whole, other rows as key and score only, in one pass
    and in separate folders. Summary, ratio and sample then read the narrow
    columns they need, and nothing is scored again.
    """
    free_of(df, _FLAG)
    scored = score_positive(df, model, key, text, score)
    flagged = scored.withColumn(_FLAG, keep_above(score, threshold))
    narrow = [
        c if c in (key, score) else F.when(F.col(_FLAG), F.col(c)).alias(c)
        for c in [*df.columns, score]
    ]
    spark = df.sparkSession
    seen = write_table(flagged.select(*narrow, _FLAG), path, partition_by=[_FLAG])
    return FilterRun(spark, path, key, score, threshold, seen)
