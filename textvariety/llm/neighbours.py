"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected at random to a few dimensions, shifted, and put in order
along a Hilbert curve, several times. A query's candidates are the vectors that
stand near its own place on any of the curves; they are ranked by their exact
inner products. How far "near" reaches is measured: on sample queries, whose
true neighbours are found by a full scan, it is the distance that takes in the
wanted share of them.

Equal vectors are one node that keeps its TOP + 1 smallest ids. As ties go to the
smaller id, no other copy can be among a query's nearest, so this is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textvariety.llm.common import pick
from textvariety.sources.scratch import store

# Every how many-th id asks, and for how many neighbours.
EVERY, TOP = 20, 20
CURVES, DIMENSIONS, BITS = 8, 8, 7
# Share of the true neighbours that windows take in, and queries it is measured on.
WANTED, SAMPLE_QUERIES = 0.97, 64
# Vectors compared at a time with the queries whose windows reach them.
BLOCK = 8192
_SLICE = 256
_SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer points along the Hilbert curve of their dimensions.

    By Skilling's transform ("Programming the Hilbert curve", 2004), on all
    points at once.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> bit & 1)
    return key


def curve_keys(points: np.ndarray, curve: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Keys of unit vectors on one of the curves: its own projection and shift."""
    rng = np.random.default_rng([_SEED, curve])
    width = points.shape[1]
    axes, _ = np.linalg.qr(rng.normal(size=(width, min(dimensions, width))))
    flat = 1 / (1 + np.exp(-1.7 * width**0.5 * np.clip(points @ axes, -1, 1)))
    shifted = (flat + rng.random(axes.shape[1])) / 2
    return hilbert_keys((shifted * (1 << BITS)).astype(np.int64))


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lifted(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose order by nearness is that by inner product: vectors get
    a further coordinate for what they lack in length, queries a zero."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    if query:
        return np.hstack([vectors / size, np.zeros_like(size)])
    scaled = vectors / longest
    return np.hstack([scaled, np.sqrt(np.maximum(1 - (size / longest) ** 2, 0))])


def _keyed(batches: Iterator[pa.RecordBatch], longest: float) -> Iterator[pa.RecordBatch]:
    """(curve, key, asks, node): where nodes lie, and where queries look."""
    for batch in batches:
        vectors, nodes = _stack(batch.column("vector")), batch.column("node")
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        for query, rows in ((False, np.arange(len(batch))), (True, np.flatnonzero(asks))):
            if not len(rows):
                continue
            points = _lifted(vectors[rows], longest, query)
            taken = nodes.take(pa.array(rows))
            for curve in range(CURVES):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([curve] * len(rows), pa.int32()),
                        pa.array(curve_keys(points, curve)),
                        pa.array([query] * len(rows)),
                        taken,
                    ],
                    ["curve", "key", "asks", "node"],
                )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their part and how many nodes of it come before."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        node = ~batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        at = before + np.cumsum(node) - node
        before += int(node.sum())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(at.astype(np.int64))],
            [*batch.schema.names, "part", "at"],
        )


def _places(nodes: DataFrame, longest: float) -> DataFrame:
    """(curve, asks, node, place): places among the nodes of a curve, from 0."""
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), CURVES)
    keyed = nodes.select("node", "vector", "asks").mapInArrow(
        partial(_keyed, longest=longest), "curve int, key long, asks boolean, node long"
    )
    order = ["curve", "key", "asks", "node"]
    sorted_ = store(keyed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    counted = store(
        sorted_.mapInArrow(_counted, "curve int, key long, asks boolean, node long, part int, at long")
    )
    # One row for each part and curve.
    sums = counted.groupBy("curve", "part").agg(
        F.count(F.when(~F.col("asks"), 1)).alias("n"), F.min("at").alias("first")
    )
    before = W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        "curve", "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"),
    )
    return counted.join(starts, ["curve", "part"]).select(
        "curve", "asks", "node", (F.col("at") + F.col("start")).alias("place")
    )


def _best(
    vectors: np.ndarray, nodes: np.ndarray, ids: np.ndarray, queries: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, score): the `top` nodes of each, ties to the smaller id.

    A product of matrices finds who comes near; those are scored again one by
    one, so that equal vectors have equal scores.
    """
    asked, found, scores = [], [], []
    for start in range(0, len(queries), _SLICE):
        part = queries[start : start + _SLICE]
        rough = part @ vectors.T
        least = np.full(len(part), -np.inf)
        if rough.shape[1] > top:
            least = np.partition(rough, -top, axis=1)[:, -top]
        slack = 1e-9 * (1 + np.abs(least, where=np.isfinite(least), out=np.zeros_like(least)))
        q, v = np.nonzero(rough >= (least - slack)[:, None])
        exact = (part[q] * vectors[v]).sum(1)
        order = np.lexsort((ids[v], -exact, q))
        q, v, exact = q[order], v[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < top
        asked.append(start + q[kept])
        found.append(nodes[v[kept]])
        scores.append(exact[kept])
    return np.concatenate(asked), np.concatenate(found), np.concatenate(scores)


_FOUND = "query long, node long, score double"


def _found(asked: np.ndarray, nodes: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(asked, pa.int64()), pa.array(nodes, pa.int64()), pa.array(scores, pa.float64())],
        ["query", "node", "score"],
    )


def _scan(
    batches: Iterator[pa.RecordBatch], asked: np.ndarray, queries: np.ndarray, top: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            nodes, ids = (batch.column(c).to_numpy() for c in ("node", "first_id"))
            q, v, s = _best(_stack(batch.column("vector")), nodes, ids, queries, top)
            yield _found(asked[q], v, s)


def _blocks(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Best of a block for every query that reaches it. Rows come by block, its
    vectors first: one block and one batch of queries are in memory."""
    key, held, block = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        curve, number, side = (batch.column(c).to_numpy() for c in ("curve", "block", "side"))
        change = (np.diff(curve) != 0) | (np.diff(number) != 0) | (np.diff(side) != 0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            here = (curve[start], number[start])
            if here != key:
                key, held, block = here, [], None
            if side[start] == 0:
                held.append(part)
                continue
            if block is None:
                if not held:
                    continue
                block = [np.concatenate([_stack(h.column("vector")) for h in held])]
                block += [np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("node", "first_id")]
                held = []
            q, v, s = _best(*block, _stack(part.column("vector")), top)
            yield _found(part.column("node").to_numpy()[q], v, s)


def _keep_best(found: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    ids = nodes.select("node", "first_id")
    best = W.partitionBy("query").orderBy(F.desc("score"), "first_id")
    ranked = found.distinct().join(ids, "node").select("*", F.row_number().over(best).alias("n"))
    return ranked.filter(F.col("n") <= top).select("query", "node", "score")


def _window(nodes: DataFrame, places: DataFrame, top: int, wanted: float, sample: int) -> int:
    """How far from a query's place its neighbours are sought."""
    asked = nodes.filter("asks").orderBy(F.xxhash64("node"), "node").limit(sample)
    got = asked.select("node", "vector").collect()
    if not got:
        return 0
    numbers, vectors = np.array([r["node"] for r in got]), np.array([r["vector"] for r in got])
    scanned = nodes.select("node", "first_id", "vector").mapInArrow(
        partial(_scan, asked=numbers, queries=vectors, top=top), _FOUND
    )
    true = store(_keep_best(scanned, nodes, top)).select("query", "node")
    looks = places.filter("asks").select("curve", F.col("node").alias("query"), F.col("place").alias("__from"))
    lies = places.filter("not asks").select("curve", "node", "place")
    far = (
        true.join(looks, "query")
        .join(lies, ["curve", "node"])
        .groupBy("query", "node")
        .agg(F.min(F.abs(F.col("place") - F.col("__from"))).alias("far"))
    )
    # At most `sample` times `top` rows.
    reach = np.sort([r["far"] for r in far.collect()])
    return int(reach[min(int(np.ceil(wanted * len(reach))), len(reach)) - 1]) + 1


def nearest_neighbours(
    rows: DataFrame, top: int = TOP, every: int = EVERY, wanted: float = WANTED, sample: int = SAMPLE_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` rows of largest inner product
    for every row whose vec_id is divisible by `every`, itself left out.

    Fewer if there are fewer candidates. Rows with a null id take no part, nor do
    null, zero or empty vectors, those with null or non-finite components, and
    those of another length than most. Repeated rows are rows of their own; ties
    go to the smaller vec_id. Recall is about `wanted` whatever the vectors are
    like; for vectors without any structure the windows become wide.
    """
    read = pick(rows, "vec_id", "embedding", vec_id="bigint", embedding="array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    valid = store(
        read.filter(F.col("vec_id").isNotNull() & fine & some).select(
            F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").alias("vector")
        )
    )
    lengths = valid.groupBy(F.size("vector").alias("n")).count()
    usual = lengths.orderBy(F.desc("count"), "n").first()
    width = usual["n"] if usual else 0
    valid = valid.filter(F.size("vector") == width)
    asks = F.col("vec_id") % every == 0
    first = W.partitionBy("vector").orderBy("vec_id", "row")
    copies = valid.select("*", F.row_number().over(first).alias("n")).filter(F.col("n") <= top + 1)
    nodes = copies.groupBy("vector").agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("ids")
    )
    asking = valid.filter(asks).select("vector").distinct().select(F.col("vector").alias("__v"))
    nodes = store(
        nodes.join(asking, F.col("vector") == F.col("__v"), "left").select(
            F.monotonically_increasing_id().alias("node"), "vector", "ids",
            F.col("ids")[0]["vec_id"].alias("first_id"), F.col("__v").isNotNull().alias("asks"),
        )
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    longest = nodes.agg(F.max(norm)).first()[0] or 1.0
    places = store(_places(nodes, longest))
    reach = _window(nodes, places, top + 1, wanted, sample)
    blocks = F.floor(F.lit((nodes.count() - 1) / BLOCK)).cast("int")
    near = F.sequence(
        F.greatest(F.floor((F.col("place") - reach) / BLOCK), F.lit(0)).cast("int"),
        F.least(F.floor((F.col("place") + reach) / BLOCK), blocks).cast("int"),
    )
    lie = places.filter("not asks").select(
        "curve", F.floor(F.col("place") / BLOCK).cast("int").alias("block"), F.lit(0).alias("side"), "node"
    )
    look = places.filter("asks").select("curve", F.explode(near).alias("block"), F.lit(1).alias("side"), "node")
    full = lie.unionByName(look).join(nodes.select("node", "first_id", "vector"), "node")
    parts = full.repartition("curve", "block").sortWithinPartitions("curve", "block", "side")
    found = _keep_best(parts.mapInArrow(partial(_blocks, top=top + 1), _FOUND), nodes, top + 1)
    answers = found.join(nodes.select("node", "ids"), "node").select(
        "query", "score", F.explode("ids").alias("id")
    )
    asked = valid.filter(asks).join(
        nodes.select(F.col("vector").alias("__v"), F.col("node").alias("query")), F.col("vector") == F.col("__v")
    ).select("query", F.col("row").alias("__row"), F.col("vec_id").alias("query_id"))
    joined = asked.join(answers, "query").filter("__row <> id.row")
    best = W.partitionBy("__row").orderBy(F.desc("score"), "id.vec_id", "id.row")
    return joined.select(
        "query_id", F.row_number().over(best).alias("rank"), F.col("id.vec_id").alias("vec_id"), "score"
    ).filter(F.col("rank") <= top)
