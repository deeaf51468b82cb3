"""Skip-gram word vectors, trained block by block.

Texts are dealt into blocks of about BLOCK_BYTES. A block is sent the vectors of
its own known words, runs through its texts, and gives the changed vectors back;
a word's vector is then the mean of what its blocks made of it, each weighed by
how often the word stands there. So the vectors lie in a table that Spark joins
and shuffles: a task holds those of one block, the driver none. What is shuffled
is, nearly all of it, a vector for each block and word of it: the larger the
blocks, the fewer of these there are. Blocks are trained in rounds, if there are
enough for all tasks: the vectors of one are added up, and its files deleted,
before the next. Texts travel and are stored in packs.

A stretch of words is trained at once: all its pairs inside of a window against
negatives drawn for the stretch by n ** 0.75 among the words of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.operators.feature_blocks import meet, runs_of_blocks, words_of
from textvariety.operators.vocabulary import vocabulary
from textvariety.sources.scratch import Tables, freeing_shuffles, store

# Bytes of text in a block; smaller corpora are spread over the cluster's tasks.
BLOCK_BYTES, LEAST_BYTES = 96 << 20, 1 << 20
# Blocks are trained in so many rounds at most.
ROUNDS = 2
# Bytes of text in a pack, and of those that are unpacked at once.
PACK_BYTES, UNPACKED_BYTES = 512 << 10, 8 << 20
# Vectors made or given at once.
VECTORS_AT_ONCE = 10_000
# The largest number of 24 bits with a sign.
FULL = (1 << 23) - 1
# Words trained at once, negatives drawn for them, and how much these weigh:
# as much as NEGATIVES for each pair.
STRETCH, DRAWN, NEGATIVES = 512, 64, 5
RATE, LEAST_RATE = 0.025, 0.0001


def train(
    df: DataFrame,
    text: str,
    dim: int,
    min_count: int,
    window: int,
    epochs: int,
    partitions: int | None,
    seed: int,
) -> DataFrame:
    """(word, vector array<float>) of every word seen at least min_count times."""
    with freeing_shuffles(df.sparkSession):
        table = _table(df, text, dim, min_count, window, epochs, partitions, seed)
    return table.select(F.col("feature").alias("word"), "inner").mapInArrow(
        partial(_listed, dim=dim), "word string, vector array<float>"
    )


def _table(
    df: DataFrame,
    text: str,
    dim: int,
    min_count: int,
    window: int,
    epochs: int,
    partitions: int | None,
    seed: int,
) -> DataFrame:
    """(feature, n, weight, inner, outer), stored."""
    rows = df.select(F.col(text).cast("string").alias("text"))
    parts, made = partitions or _block_count(rows), Tables()
    dealt = rows.mapInArrow(partial(_dealt, parts=parts), "block int, key int, text binary")
    docs = made.add(store(dealt.repartitionById(parts, "block"), "none"))
    known = vocabulary(docs.mapInArrow(_read, "text string"), "text", min_count).select(
        F.col("word").alias("feature"), "n"
    )
    no_vector = F.lit(None).cast("binary")
    table = store(known.select("*", no_vector.alias("inner"), no_vector.alias("outer")))
    rounds = _rounds(parts, rows.sparkSession.sparkContext.defaultParallelism)
    for epoch in range(epochs):
        made.add(table)
        settings = {"dim": dim, "window": window, "seed": seed, "epoch": epoch, "epochs": epochs}
        sums, before = None, Tables()
        for low, high in rounds:
            here = docs.filter(F.col("block").between(low, high - 1)) if len(rounds) > 1 else docs
            trained = _fed(here, parts, table.drop("weight"), seed).mapInArrow(
                partial(_trained, **settings), _VECTORS
            )
            alike = trained if sums is None else trained.unionByName(sums)
            alike = alike.repartition("feature").sortWithinPartitions("feature")
            means = partial(_means, dim=dim, whole=high == parts)
            sums = store(alike.mapInArrow(means, _VECTORS))
            before.discard()
            if high < parts:
                before.add(sums)
        table = sums
    made.discard()
    return table


_VECTORS = "feature string, n long, weight long, inner binary, outer binary"


def _fed(docs: DataFrame, parts: int, table: DataFrame, seed: int) -> DataFrame:
    """Blocks, the vectors of each before its packs of texts."""
    asked = docs.mapInArrow(_asked, "block int, feature string")
    met = meet(docs, parts, asked, table).sortWithinPartitions("block", "side")
    lot = F.when(F.col("side") == 0, F.xxhash64("feature", F.lit(seed))).alias("lot")
    return met.select("block", "side", "text", "feature", "n", lot, "inner", "outer")


def _rounds(parts: int, tasks: int) -> list[tuple[int, int]]:
    """The first block of each round, and of the next."""
    count = max(1, min(ROUNDS, parts // tasks))
    cuts = [parts * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def _block_count(rows: DataFrame) -> int:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // BLOCK_BYTES), min(tasks, -(-size // LEAST_BYTES)))


def _dealt(
    batches: Iterator[pa.RecordBatch], parts: int, size: int = PACK_BYTES
) -> Iterator[pa.RecordBatch]:
    """(block, key, text): packs of texts that follow each other, dealt in turn."""
    turn = TaskContext.get().partitionId()
    for batch in batches:
        texts, packs, start = batch.column("text"), [], 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while start < len(texts):
            full = (ends[start - 1] if start else 0) + size
            end = max(start + 1, int(np.searchsorted(ends, full, "right")))
            packs.append(_pack(texts.slice(start, end - start)))
            start = end
        blocks = (turn + np.arange(len(packs))) % parts
        turn += len(packs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.nulls(len(packs), pa.int32()), pa.array(packs, pa.binary())],
            ["block", "key", "text"],
        )


def _pack(texts: pa.Array) -> bytes:
    rows, out = pa.record_batch([texts], ["text"]), pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(out, rows.schema, options=options) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def _texts(packs: pa.Array) -> Iterator[tuple[pa.Array, float, float]]:
    """The texts of some packs at a time, and the shares of all packs that lie
    before and up to their end."""
    held, size = [], 0
    for i, pack in enumerate(packs):
        texts = pa.ipc.open_stream(pack.as_buffer()).read_all().column("text").combine_chunks()
        if held and size + texts.nbytes > UNPACKED_BYTES:
            yield pa.concat_arrays(held), (i - len(held)) / len(packs), i / len(packs)
            held, size = [], 0
        held.append(texts)
        size += texts.nbytes
    if held:
        yield pa.concat_arrays(held), 1 - len(held) / len(packs), 1.0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts, *_ in _texts(batch.column("text")):
            yield pa.RecordBatch.from_arrays([texts], ["text"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, feature) of the words of each block, few of them twice."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for block in np.unique(blocks).tolist():
            for texts, *_ in _texts(batch.column("text").filter(pa.array(blocks == block))):
                words = words_of(texts)[1].unique()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), block, np.int32)), words], ["block", "feature"]
                )


def first_vectors(lots: np.ndarray, dim: int) -> np.ndarray:
    """Vectors even in -0.5 / dim to 0.5 / dim, fixed by each word's lot."""
    with np.errstate(over="ignore"):
        x = lots.astype(np.int64).view(np.uint64)[:, None]
        x = x + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x >> np.uint64(40)) / np.float32(1 << 24) - 0.5) / dim).astype(np.float32)


def _matrix(column: pa.Array, dim: int, kind: str = "<f4") -> np.ndarray:
    """The vectors of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _binary(matrix: np.ndarray, kind: str = "<f4") -> pa.Array:
    rows = np.ascontiguousarray(matrix, kind)
    raw, width = rows.tobytes(), rows.itemsize * rows.shape[1]
    ends = np.arange(0, len(raw) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(matrix), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)]
    )


def _packed(matrix: np.ndarray) -> pa.Array:
    """Vectors as bytes: the size of the largest number, and each number as a share
    of it in 24 bits, which is as fine as the largest number itself is."""
    largest = np.abs(matrix).max(axis=1, initial=0).astype("<f4")
    shares = matrix / np.where(largest > 0, largest, 1).astype(np.float64)[:, None]
    whole = np.rint(shares * FULL).astype("<i4")
    rows, dim = matrix.shape
    low = whole.view(np.uint8).reshape(rows, dim, 4)[:, :, :3].reshape(rows, 3 * dim)
    return _binary(np.hstack([largest.view(np.uint8).reshape(rows, 4), low]), "u1")


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column made by _packed, without nulls."""
    raw = _matrix(column, 4 + 3 * dim, "u1")
    high = np.zeros((len(raw), dim, 4), np.uint8)
    high[:, :, 1:] = raw[:, 4:].reshape(-1, dim, 3)
    whole = high.view("<i4")[:, :, 0] >> 8
    return whole * (raw[:, :4].copy().view("<f4").astype(np.float64) / FULL)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def _add(table: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    """Add changes to rows; those of a row met c times weigh 1 / sqrt(c)."""
    order = np.argsort(at, kind="stable")
    rows, starts, counts = np.unique(at[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(change[order], starts, axis=0)
    table[rows] += sums / np.sqrt(counts, dtype=np.float32)[:, None]


class _Block:
    """A block's words and their vectors."""

    def __init__(self, held: list[pa.RecordBatch], dim: int, window: int, rng: np.random.Generator):
        self.rows = pa.Table.from_batches(held).combine_chunks()
        self.window, self.rng = window, rng
        self.words = self.rows.column("feature").combine_chunks()
        inner, outer = (self.rows.column(c).combine_chunks() for c in ("inner", "outer"))
        self.inner = np.empty((len(self.rows), dim), np.float32)
        self.outer = np.zeros_like(self.inner)
        lots = self.rows.column("lot").to_numpy()
        for start in range(0, len(lots), VECTORS_AT_ONCE):
            here = slice(start, start + VECTORS_AT_ONCE)
            if inner.null_count:
                self.inner[here] = first_vectors(lots[here], dim)
            else:
                self.inner[here], self.outer[here] = _matrix(inner[here], dim), _matrix(outer[here], dim)
        self.rows = self.rows.select(["feature", "n"])
        self.seen = np.zeros(len(self.words), np.int64)
        share = np.cumsum(self.rows.column("n").to_numpy() ** 0.75)
        self.share = share / share[-1]

    def run(self, texts: pa.Array, rates: tuple[float, float]) -> None:
        """Train on texts, the rate going from the first to the second."""
        text, words = words_of(texts)
        ids = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        text, ids = text[ids >= 0], ids[ids >= 0]
        self.seen += np.bincount(ids, minlength=len(self.seen))
        reach = self.rng.integers(1, self.window + 1, len(ids))
        for start in range(0, len(ids), STRETCH):
            here = slice(start, start + STRETCH + self.window)
            rate = np.float32(rates[0] + (rates[1] - rates[0]) * start / len(ids))
            self._step(ids[here], text[here], reach[here], rate)

    def _step(self, ids: np.ndarray, text: np.ndarray, reach: np.ndarray, rate: np.float32) -> None:
        """Every pair that starts in the stretch; the words after it only end pairs."""
        x, y = self.inner[ids], self.outer[ids]
        dx, dy = np.zeros_like(x), np.zeros_like(y)
        pairs = np.zeros(len(ids), np.float32)
        for gap in range(1, self.window + 1):
            count = min(STRETCH, len(ids) - gap)
            if count <= 0:
                break
            first, second = slice(0, count), slice(gap, gap + count)
            same = text[first] == text[second]
            for a, b in ((first, second), (second, first)):
                near = (same & (reach[a] >= gap)).astype(np.float32)
                wrong = near * (1 - _sigmoid(np.einsum("ij,ij->i", x[a], y[b])))
                dx[a] += wrong[:, None] * y[b]
                dy[b] += wrong[:, None] * x[a]
                pairs[a] += near
        drawn = np.searchsorted(self.share, self.rng.random(DRAWN))
        drawn = np.minimum(drawn, len(self.share) - 1)
        z = self.outer[drawn]
        wrong = -_sigmoid(x @ z.T) * (pairs * np.float32(NEGATIVES / DRAWN))[:, None]
        dx += wrong @ z
        dz = wrong.T @ x
        _add(self.inner, ids, rate * dx)
        _add(self.outer, np.concatenate((ids, drawn)), rate * np.concatenate((dy, dz)))

    def result(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Rows of the changed vectors; after the last epoch, no outer ones."""
        for start in range(0, len(self.words), VECTORS_AT_ONCE):
            here = slice(start, start + VECTORS_AT_ONCE)
            rows = self.rows.slice(start, VECTORS_AT_ONCE).combine_chunks()
            outer = pa.nulls(len(rows), pa.binary()) if last else _packed(self.outer[here])
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.combine_chunks() for c in rows.columns),
                    pa.array(self.seen[here]),
                    _packed(self.inner[here]),
                    outer,
                ],
                ["feature", "n", "weight", "inner", "outer"],
            )


def _trained(
    batches: Iterator[pa.RecordBatch], dim: int, window: int, seed: int, epoch: int, epochs: int
) -> Iterator[pa.RecordBatch]:
    block, held, made = None, [], None
    last = epoch == epochs - 1
    high = RATE - (RATE - LEAST_RATE) * epoch / epochs
    low = RATE - (RATE - LEAST_RATE) * (epoch + 1) / epochs
    for place, side, rows in runs_of_blocks(batches):
        if place != block:
            if made is not None:
                yield from made.result(last)
            block, held, made = place, [], None
        if side == 0:
            held.append(rows.select(["feature", "n", "lot", "inner", "outer"]))
            continue
        if made is None:
            if not held:  # no text of the block has a known word
                continue
            rng = np.random.default_rng([seed, epoch, block])
            made, held = _Block(held, dim, window, rng), []
        for texts, before, upto in _texts(rows.column("text")):
            made.run(texts, (high - (high - low) * before, high - (high - low) * upto))
    if made is not None:
        yield from made.result(last)


def _means(
    batches: Iterator[pa.RecordBatch], dim: int, whole: bool
) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal words: the mean of its vectors by weight, as
    floats if it is `whole`, else packed for the next round."""
    last = None  # (feature, n), weight and sums of the run that may go on
    for batch in batches:
        if not len(batch):
            continue
        words = batch.column("feature")
        differs = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1))
        starts = np.flatnonzero(np.r_[True, differs.to_numpy(zero_copy_only=False)])
        weight = batch.column("weight").to_numpy().astype(np.float64)
        some = [c for c in ("inner", "outer") if not batch.column(c).null_count]
        both = np.hstack([_unpacked(batch.column(c), dim) for c in some])
        sums = np.add.reduceat(both * weight[:, None], starts, axis=0)
        weights = np.add.reduceat(weight, starts)
        heads = batch.select(["feature", "n"]).take(pa.array(starts))
        if last is not None:
            if last[0].column(0)[0] == heads.column(0)[0]:
                weights[0] += last[1][0]
                sums[0] += last[2][0]
            else:
                yield _mean(*last, dim, whole)
        if len(starts) > 1:
            yield _mean(heads.slice(0, len(starts) - 1), weights[:-1], sums[:-1], dim, whole)
        last = heads.slice(len(starts) - 1), weights[-1:], sums[-1:]
    if last is not None:
        yield _mean(*last, dim, whole)


def _mean(
    heads: pa.RecordBatch, weights: np.ndarray, sums: np.ndarray, dim: int, whole: bool
) -> pa.RecordBatch:
    mean, given = sums / weights[:, None], _binary if whole else _packed
    outer = given(mean[:, dim:]) if mean.shape[1] > dim else pa.nulls(len(mean), pa.binary())
    return pa.RecordBatch.from_arrays(
        [*heads.columns, pa.array(weights.astype(np.int64)), given(mean[:, :dim]), outer],
        ["feature", "n", "weight", "inner", "outer"],
    )


def _listed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = _matrix(batch.column("inner"), dim).reshape(-1)
        ends = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), pa.ListArray.from_arrays(ends, pa.array(flat))],
            ["word", "vector"],
        )
