"""Readers. Each is one lazy scan that Catalyst can prune."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from textvariety.functions.features import tokens
from textvariety.functions.text import LABEL_PREFIX


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One split of a data set, mirrored as Parquet."""
    return spark.read.parquet(path)


def read_class_files(spark: SparkSession, files: Mapping[int, str]) -> DataFrame:
    """One Parquet path per class, united with a constant `label`."""
    out = None
    for label, path in files.items():
        part = spark.read.parquet(path).withColumn("label", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def read_domains(
    spark: SparkSession,
    root: str,
    domains: Sequence[str],
    split: str = "train",
    column: str | None = "domain",
    folder: str = "{domain}",
    files: str = "{split}-*.parquet",
) -> DataFrame:
    """Files of one split of several domain folders, tagged with the domain.

    All folders are one scan; the tag comes from the file path, so adding
    domains adds no branch to the plan. `column=None` leaves the tag out.
    """
    names = {folder.format(domain=d): d for d in domains}
    pattern = files.format(split=split)
    paths = [f"{root.rstrip('/')}/{name}/{pattern}" for name in names]
    table = spark.read.parquet(*paths)
    if column is None:
        return table
    tags = F.create_map(
        *(F.lit(v) for name, d in names.items() for v in (quote(name, "=,-_."), d))
    )
    parent = F.get(F.reverse(F.split(_file_path(), "/")), F.lit(1))
    return table.withColumn(column, tags[parent])


def _file_path() -> Column:
    return F.col("_metadata.file_path")


def _shard_reader(spark: SparkSession, text: str, tolerate_bad: bool) -> DataFrameReader:
    flag = str(tolerate_bad).lower()
    return (
        spark.read.schema(f"`{text}` string")
        .option("ignoreCorruptFiles", flag)
        .option("ignoreMissingFiles", flag)
    )


def shard_rows(spark: SparkSession, paths: Sequence[str], text: str = "text") -> DataFrame:
    """(shard, promised, read): rows by the file's own count, and rows that could
    be read. A shard with a damaged page has fewer; one without a readable
    footer has no row here. The count reads footers only.
    """
    files = _shard_reader(spark, text, True).parquet(*paths)
    promised = files.groupBy(_file_path().alias("shard")).agg(F.count("*").alias("promised"))
    # Both counts need the column, so every page is read.
    seen = files.groupBy(_file_path().alias("shard")).agg(
        (F.count(text) + F.count_if(F.col(text).isNull())).alias("read")
    )
    return promised.join(seen, "shard", "left").select(
        "shard", "promised", F.coalesce("read", F.lit(0)).alias("read")
    )


def read_shards(
    spark: SparkSession,
    paths: Sequence[str],
    text: str = "text",
    tolerate_bad: bool = True,
    whole: bool = False,
) -> DataFrame:
    """(shard, row_no, text) of many Parquet shards, null texts dropped.

    The shard is the file path and row_no the row's place in that file, which
    identifies a row without a pass over the data. With `tolerate_bad`, shards
    that are missing or cannot be read to their end are passed over as a whole;
    finding them takes one pass, unless they are known to be `whole`, and brings
    one path for each damaged shard to the driver. `failed_shards` lists them.
    """
    files = _shard_reader(spark, text, tolerate_bad).parquet(*paths)
    rows = files.select(
        _file_path().alias("shard"), F.col("_metadata.row_index").alias("row_no"), text
    )
    if tolerate_bad and not whole:
        short = shard_rows(spark, paths, text).filter("read < promised").collect()
        if short:
            rows = rows.filter(~F.col("shard").isin([r["shard"] for r in short]))
    return rows.filter(F.col(text).isNotNull())


def failed_shards(
    spark: SparkSession, paths: Sequence[str], text: str = "text"
) -> list[str]:
    """Those of `paths`, which name single files, that `read_shards` passes over.

    A shard that can be read but holds no text is none of them.
    """
    rows = shard_rows(spark, paths, text).filter("read = promised").collect()
    whole = {unquote(PurePosixPath(r["shard"]).name) for r in rows}
    return [p for p in paths if PurePosixPath(p).name not in whole]


def count_skipped(
    spark: SparkSession, paths: Sequence[str], text: str = "text"
) -> DataFrame:
    """One row: listed shards, shards that were read, and the difference."""
    skipped = len(failed_shards(spark, paths, text))
    row = [(len(paths), len(paths) - skipped, skipped)]
    return spark.createDataFrame(row, "listed bigint, read bigint, skipped bigint")


def parse_labelled_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `words` and `labels`: tokens without and with the label prefix."""
    parts = tokens(line)
    is_label = lambda t: t.startswith(LABEL_PREFIX)
    return df.withColumns(
        {
            "words": F.filter(parts, lambda t: ~is_label(t)),
            "labels": F.filter(parts, is_label),
        }
    )


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, words, labels) of a labelled text file."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return parse_labelled_lines(lines)
