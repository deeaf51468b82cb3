"""Bring the features of documents together with a table of features, block by block.

Documents are dealt into blocks of about BLOCK_BYTES of text. A block is sent the
rows of the table that its own features ask for, each once, and its documents
then meet them where they lie. So documents are shuffled whole instead of feature
by feature, a common feature costs a block one row, and a task holds one block's
part of the table, whatever the sizes of the table and of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from textvariety.sources.scratch import store

# Bytes of text in a block; smaller corpora are spread over the cluster's tasks,
# in blocks of no less than LEAST_BYTES.
BLOCK_BYTES, LEAST_BYTES = 32 << 20, 2 << 20
# Numbers of a batch of sums.
SUMS_AT_ONCE = 1 << 20


def block_count(df: DataFrame, text: str) -> int:
    """How many blocks the texts make up."""
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // BLOCK_BYTES), min(tasks, -(-size // LEAST_BYTES)))


def in_blocks(
    docs: DataFrame, parts: int, features: Callable[[str], Column], table: DataFrame
) -> DataFrame:
    """Rows of each block, its part of the table (side 0) before its documents
    (side 1): (block, side, key, text, feature, …other columns of the table).

    `docs` is a stored (block, key, text), block by block in its files; the table
    has one row per feature. Each block has a partition of its own.
    """
    asked = docs.select("block", F.explode(F.array_distinct(features("text"))).alias("feature"))
    return meet(docs, parts, asked, table)


def meet(docs: DataFrame, parts: int, asked: DataFrame, table: DataFrame) -> DataFrame:
    """As in_blocks, for the features asked for by (block, feature)."""
    met = asked.distinct().join(table, "feature")
    values = [f for f in table.schema if f.name != "feature"]
    kinds = {"key": docs.schema["key"].dataType, "text": docs.schema["text"].dataType}
    lie = met.select(
        "block",
        F.lit(0).alias("side"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()),
        "feature",
        *(f.name for f in values),
    )
    look = docs.select(
        "block",
        F.lit(1).alias("side"),
        *kinds,
        F.lit(None).cast("string").alias("feature"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in values),
    )
    return lie.unionByName(look).repartitionById(parts, "block")


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of its text, word) of all words: as features.tokens, in order."""
    split = pc.ascii_split_whitespace(texts)  # the blanks of features.TOKEN_SEPARATOR
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return at[full.to_numpy(zero_copy_only=False)], words.filter(full)


def runs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(block, side, rows) of the runs of equal block and side in sorted batches."""
    for batch in batches:
        if not len(batch):
            continue
        places = batch.column("block").to_numpy() * 2 + batch.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:]):
            place = int(places[start])
            yield place // 2, place % 2, batch.slice(start, end - start)


def feature_sums(
    df: DataFrame,
    table: DataFrame,
    features: Callable[[str], Column],
    dims: int,
    key: str,
    text: str = "text",
) -> DataFrame:
    """(key, n, sums) of every row with a known feature: how many known
    occurrences its text has, and the sum of their values in `dims` dimensions.

    The table is (feature, at, value): `value` holds the numbers of the
    dimensions `at`, of all of them in order where `at` is null. A feature with
    several rows counts once for each. Rows travel with their numbers as bytes.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = block_count(rows, "text")
    block = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    docs = store(rows.withColumn("block", block).repartitionById(parts, "block"))
    wide = table.schema["value"].dataType.elementType == DoubleType()
    packed = table.select("feature", F.col("at").cast("array<int>"), "value").mapInArrow(
        _packed, "feature string, at binary, value binary"
    )
    met = in_blocks(docs, parts, features, packed)
    sorted_ = met.sortWithinPartitions("block", "side")
    listed = F.when(F.col("side") == 1, features("text")).alias("features")
    fed = sorted_.select("block", "side", "key", listed, "feature", "at", "value")
    schema = StructType(
        [
            StructField("key", docs.schema["key"].dataType),
            StructField("n", LongType()),
            StructField("sums", ArrayType(DoubleType())),
        ]
    )
    return fed.mapInArrow(partial(_sums, dims=dims, kind="<f8" if wide else "<f4"), schema).withColumnRenamed("key", key)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("feature"), _bytes(batch.column("at")), _bytes(batch.column("value"))],
            ["feature", "at", "value"],
        )


def _bytes(lists: pa.ListArray) -> pa.Array:
    """The numbers of each list as bytes; null lists stay null."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    raw, width = flat.tobytes(), flat.itemsize
    starts = [0, *(ends[:-1] * width).tolist()]
    cut = [raw[s:e] for s, e in zip(starts, (ends * width).tolist())]
    return pa.array(cut, pa.binary(), mask=lists.is_null().to_numpy(zero_copy_only=False))


class _Part:
    """A block's rows of the table."""

    def __init__(self, held: list[pa.RecordBatch], dims: int, kind: str):
        rows = pa.Table.from_batches(held).combine_chunks()
        self.dims = dims
        told = rows.column("feature").combine_chunks().dictionary_encode()
        self.names = told.dictionary
        # Rows of a feature that has several; most often none has.
        self.rows = None
        if len(self.names) < len(rows):
            codes = told.indices.to_numpy()
            self.rows, self.sizes = np.argsort(codes, kind="stable"), np.bincount(codes)
            self.firsts = np.cumsum(self.sizes) - self.sizes
        values, at = rows.column("value"), rows.column("at")
        self.values = np.frombuffer(b"".join(values.to_pylist()), kind)
        sizes = pc.binary_length(values).to_numpy() // self.values.itemsize
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.dense = at.null_count == len(at)
        self.at = None if self.dense else np.frombuffer(b"".join(at.to_pylist()), "<i4")
        if self.dense:
            self.values = self.values.reshape(len(rows), dims)

    def rows_of(self, names: np.ndarray) -> np.ndarray:
        """The rows of these features, all of those that have several."""
        if self.rows is None:
            return names
        sizes = self.sizes[names]
        at = np.repeat(self.firsts[names] - (np.cumsum(sizes) - sizes), sizes)
        return self.rows[at + np.arange(len(at))]

    def total(self, which: np.ndarray) -> np.ndarray:
        """Sum of the values of these rows, repeats counted."""
        rows, counts = np.unique(which, return_counts=True)
        if self.dense:
            return counts @ self.values[rows].astype(np.float64)
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1])
        weights = self.values[at] * np.repeat(counts, sizes)
        return np.bincount(self.at[at], weights=weights, minlength=self.dims)


def _sums(batches: Iterator[pa.RecordBatch], dims: int, kind: str) -> Iterator[pa.RecordBatch]:
    block, held, part = None, [], None
    for place, side, rows in runs_of_blocks(batches):
        if place != block:
            block, held, part = place, [], None
        if side == 0:
            held.append(rows.select(["feature", "at", "value"]))
            continue
        if part is None:
            if not held:  # no text of the block has a known feature
                continue
            part, held = _Part(held, dims, kind), []
        features = rows.column("features")
        sizes = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False)
        found = pc.fill_null(pc.index_in(features.flatten(), value_set=part.names), -1).to_numpy()
        ends = np.cumsum(sizes)
        keys, some, counts, sums = rows.column("key"), [], [], []
        for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
            which = found[end - size : end]
            which = part.rows_of(which[which >= 0])
            if len(which):
                some.append(i)
                counts.append(len(which))
                sums.append(part.total(which))
            if len(sums) * dims >= SUMS_AT_ONCE:
                yield _summed(keys, some, counts, sums)
                some, counts, sums = [], [], []
        yield _summed(keys, some, counts, sums)


def _summed(keys: pa.Array, some: list, counts: list, sums: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(some, pa.int64())),
            pa.array(counts, pa.int64()),
            pa.array(sums, pa.list_(pa.float64())),
        ],
        ["key", "n", "sums"],
    )
