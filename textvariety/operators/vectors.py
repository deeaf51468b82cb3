"""Word vectors, document vectors, nearest neighbours and analogies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StructField,
    StructType,
)

from textvariety.functions.features import tokens
from textvariety.operators import skip_gram
from textvariety.operators.feature_blocks import feature_sums

# Vectors of a block, and queries multiplied with it at a time.
BLOCK_VECTORS, QUERY_SLICE = 8_192, 256
# Word vectors of at most so many bytes are sent to every executor.
BROADCAST_BYTES = 128 << 20


def train_word_vectors(
    df: DataFrame,
    text: str = "text",
    dim: int = 100,
    min_count: int = 5,
    window: int = 5,
    epochs: int = 1,
    partitions: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Skip-gram vectors: (word, vector array<float>).

    `partitions` is the number of blocks the texts are trained in; by default it
    grows with their size, so that neither the driver nor a task holds more
    vectors when the vocabulary grows. See operators/skip_gram.py.
    """
    return skip_gram.train(df, text, dim, min_count, window, epochs, partitions, seed)


def doc_vectors(
    df: DataFrame, vectors: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """(key, n, vector): mean vector of a text's known words, repeats counted.

    `vectors` is read more than once: pass a stored table. Vectors of at most
    BROADCAST_BYTES travel to the texts, which are then averaged where they lie.
    More of them meet the texts block by block, each block being sent the
    vectors of its own words. Texts without a known word have no row.
    """
    given = vectors.select("word", "vector")
    size = F.octet_length("word") + 8 * F.size("vector") + 32
    if (given.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return _means_in_place(df, given, key, text)
    table = given.select(
        F.col("word").alias("feature"), F.lit(None).cast("array<int>").alias("at"),
        F.col("vector").alias("value"),
    )
    dims = given.select(F.size("vector")).first()[0]
    sums = feature_sums(df, table, tokens, dims, key, text)
    # Rows of one key are one document.
    whole = sums.groupBy(key).agg(
        F.sum("n").alias("n"),
        *(F.sum(F.get("sums", F.lit(i))).alias(f"_{i}") for i in range(dims)),
    )
    mean = F.array(*(F.col(f"_{i}") / F.col("n") for i in range(dims)))
    return whole.select(key, "n", mean.alias("vector"))


def _means_in_place(df: DataFrame, given: DataFrame, key: str, text: str) -> DataFrame:
    table = given.toArrow().combine_chunks()
    shared = df.sparkSession.sparkContext.broadcast(table)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.column("word").combine_chunks()
        flat = shared.value.column("vector").combine_chunks().flatten()
        flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = flat.reshape(len(names), -1) if len(names) else np.zeros((0, 1))
        place = {name: i for i, name in enumerate(names.to_pylist())}
        for batch in batches:
            rows, counts, vectors = [], [], []
            # The same ASCII blanks as features.TOKEN_SEPARATOR.
            words = pc.ascii_split_whitespace(batch.column("text"))
            for row, listed in enumerate(words.to_pylist()):
                found = [place[w] for w in listed or () if w in place]
                if found:
                    rows.append(row)
                    counts.append(len(found))
                    vectors.append(matrix[found].mean(axis=0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows, pa.int64())),
                    pa.array(counts, pa.int64()),
                    pa.array(vectors, pa.list_(pa.float64())),
                ],
                ["key", "n", "vector"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = StructType(
        [
            StructField("key", rows.schema["key"].dataType),
            StructField("n", LongType()),
            StructField("vector", ArrayType(DoubleType())),
        ]
    )
    return rows.mapInArrow(means, schema).withColumnRenamed("key", key)


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    key: str = "id",
    vector: str = "vector",
    block: int = BLOCK_VECTORS,
) -> DataFrame:
    """(query, rank, key, similarity): k vectors of highest cosine similarity.

    `queries` has `query`, `vector` and optionally `exclude`, an array of keys
    that may not be returned. Every vector is compared with every query, in one
    pass: vectors are dealt out in blocks of about `block`, each block meets all
    queries as they stream by, and keeps k rows per query. So a task holds one
    block and one batch of queries, whatever their number, and the queries are
    sent once for each block. Vectors of length zero are nobody's neighbour.
    Ranks go by full precision, ties to the lower key.
    """
    kinds = {"query": queries.schema["query"].dataType, "key": vectors.schema[key].dataType}
    parts = max(1, -(-vectors.count() // block))
    excluded = (F.col("exclude") if "exclude" in queries.columns else F.lit(None)).cast(
        ArrayType(kinds["key"])
    )
    lie = vectors.filter(F.col(vector).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"),
        F.lit(0).alias("side"),
        F.lit(None).cast(kinds["query"]).alias("query"),
        F.col(key).alias("key"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.lit(None).cast(ArrayType(kinds["key"])).alias("exclude"),
    )
    look = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(1).alias("side"),
        "query",
        F.lit(None).cast(kinds["key"]).alias("key"),
        F.col("vector").cast("array<double>").alias("vector"),
        excluded.alias("exclude"),
    )
    schema = StructType(
        [StructField(name, kind) for name, kind in kinds.items()]
        + [StructField("similarity", DoubleType())]
    )
    met = lie.unionByName(look).repartition("part").sortWithinPartitions("part", "side")
    found = met.mapInArrow(partial(_best_of_blocks, k=k), schema)
    best = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "key")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query", "rank", F.col("key").alias(key), "similarity")
    )


def _units(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows become NaN."""
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / length


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best_of_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by part, its vectors before the queries."""
    part, held, keys, units = None, [], None, None
    for batch in batches:
        if not len(batch):
            continue
        places = batch.column("part").to_numpy() * 2 + batch.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:]):
            rows = batch.slice(start, end - start)
            if places[start] // 2 != part:
                part, held, keys, units = places[start] // 2, [], None, None
            if places[start] % 2 == 0:
                held.append(rows)
                continue
            if keys is None:
                if not held:
                    continue
                keys = pa.concat_arrays([h.column("key") for h in held])
                units = _units(np.concatenate([_matrix(h.column("vector")) for h in held]))
                held = []
            yield _best_of_block(rows, keys, units, k)


def _best_of_block(queries: pa.RecordBatch, keys: pa.Array, units: np.ndarray, k: int) -> pa.RecordBatch:
    names, asked = queries.column("query"), _units(_matrix(queries.column("vector")))
    listed = keys.to_pylist()
    who, which, scores = [], [], []
    for start in range(0, len(queries), QUERY_SLICE):
        rough = asked[start : start + QUERY_SLICE] @ units.T
        for i, row in enumerate(rough, start):
            banned = set(queries.column("exclude")[i].as_py() or ())
            usable = ~np.isnan(row)
            if usable.sum() > k + len(banned):
                least = np.partition(row[usable], -(k + len(banned)))[-(k + len(banned))]
                # Rounding may differ by place in the product.
                usable &= row >= least - 1e-9
            at = np.flatnonzero(usable)
            exact = (units[at] * asked[i]).sum(axis=1)
            rows = sorted((-s, listed[j], j) for s, j in zip(exact.tolist(), at.tolist()) if listed[j] not in banned)
            for s, _, j in rows[:k]:
                who.append(i)
                which.append(j)
                scores.append(-s)
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(who, pa.int64())),
            keys.take(pa.array(which, pa.int64())),
            pa.array(scores, pa.float64()),
        ],
        ["query", "key", "similarity"],
    )


def analogy_queries(
    triples: DataFrame, vectors: DataFrame, key: str = "id", vector: str = "vector"
) -> DataFrame:
    """Queries a - b + c for (query, a, b, c), excluding a, b and c.

    Each unit vector is used, so long vectors do not dominate the sum.
    """
    out = triples
    for side in ("a", "b", "c"):
        length = F.sqrt(
            F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        )
        unit = F.transform(vector, lambda x: F.try_divide(x.cast("double"), length))
        named = vectors.select(F.col(key).alias(side), unit.alias(f"_{side}"))
        out = out.join(named, side)
    ab = F.zip_with("_a", "_b", lambda x, y: x - y)
    return out.select(
        "query",
        F.zip_with(ab, "_c", lambda x, y: x + y).alias("vector"),
        F.array("a", "b", "c").alias("exclude"),
    )


def analogies(
    triples: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    key: str = "id",
    vector: str = "vector",
) -> DataFrame:
    """Neighbours of a - b + c for each (query, a, b, c)."""
    return nearest(analogy_queries(triples, vectors, key, vector), vectors, k, key, vector)
