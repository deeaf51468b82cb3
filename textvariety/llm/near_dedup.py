"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one node. Nodes that agree on a band of
their signature are candidates. A candidate's signatures are compared batch by
batch, and it is dropped as soon as the posterior probability of its similarity
reaching the threshold falls below the chosen bound; what survives is verified
on the full sets.

Groups of copies are never paired out. First every member of a bucket is
compared with the bucket's hub, the node with most bucket mates; the links make
components. Only members outside of their hub's component are then compared
with the other members, in blocks of bounded size that give links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textvariety.llm.chunks import give_back
from textvariety.llm.common import pick
from textvariety.sources.scratch import Tables, broadcast_if_small, discard, store

# Three words to a shingle; linked at a similarity of 85 percent.
# Others are passed as arguments.
SHINGLE, PERCENT = 3, 85
# Signature of BANDS * ROWS values of 16 bits. At a similarity of 0.85 a pair
# shares no band with probability (1 - 0.85^6)^32 = 2.6e-7; at 0.8 it is 6e-5.
BANDS, ROWS = 32, 6
# Values compared at a time, and the posterior bound below which a pair goes.
BATCH, MISS = 32, 1e-7
# Members of a bucket compared in one block, on either side.
BLOCK = 256
_SEED = 20260712
_TASK_SHINGLES = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text.

    Only A to Z are lower-cased and only ASCII blanks part words. Fewer words
    than a shingle has count as one; no words give an empty set.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(size, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - width + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], values: int = BANDS * ROWS) -> np.ndarray:
    """16-bit MinHash values, a row for each non-empty set."""
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 1 << 31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, values, dtype=np.uint32)
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), values), np.uint32)
    y = np.empty_like(x)
    for i in range(values):
        np.multiply(x, a[i], out=y)
        np.add(y, b[i], out=y)
        out[:, i] = np.minimum.reduceat(y, starts)
    return (out ^ (out >> np.uint32(16))).astype(np.uint16)


def fewest_matches(
    batches: int, percent: int = PERCENT, miss: float = MISS, batch: int = BATCH
) -> list[int]:
    """Matches a pair needs after 1, 2, … batches to stay.

    With a uniform prior, the probability that the similarity is at least t,
    given m of n matches, is that of at most m successes in n + 1 trials of t.
    """
    t, out = percent / 100, []
    for k in range(1, batches + 1):
        n, total, m = k * batch, 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches a few rows at a time, for what Python makes of them."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
    give_back()


def _signed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text_hash, n, set_a, set_b, signature) from texts."""
    import xxhash

    for batch in _sliced(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        done = 0
        while done < len(texts):
            sets: list[np.ndarray] = []
            size, first = 0, done
            while done < len(texts) and (not sets or size < _TASK_SHINGLES):
                sets.append(shingle_set(texts[done], shingle))
                size += len(sets[-1])
                done += 1
            kept = [s for s in sets if len(s)]
            signed = iter(signatures(kept)) if kept else iter(())
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            part = batch.slice(first, done - first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()),
                    pa.array([int.from_bytes(k[8:], "little", signed=True) for k in keys], pa.int64()),
                    pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "text_hash", "n", "set_a", "set_b", "signature"],
            )


def _with_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([shingle_set(t, shingle).tobytes() for t in texts], pa.binary())],
            ["node", "shingles"],
        )


def _agree(a: np.ndarray, b: np.ndarray, needed: list[int]) -> np.ndarray:
    """Which rows of two signature tables survive every batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, least in enumerate(needed):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def _similar_sizes(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _is_link(both, n, m, percent: int):
    return 100 * both >= percent * (n + m - both)


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _verify(
    batches: Iterator[pa.RecordBatch], needed: list[int], percent: int
) -> Iterator[pa.RecordBatch]:
    """(a, b) of the linked among pairs that carry signatures and sets."""
    for batch in batches:
        if not len(batch):
            continue
        n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        (near,) = np.nonzero(_similar_sizes(n, m, percent))
        rows = batch.take(pa.array(near))
        left = []
        if len(rows):
            alive = _agree(_table(rows.column("signature_a")), _table(rows.column("signature_b")), needed)
            rows = rows.take(pa.array(alive))
            for i in range(len(rows)):
                x, y = (np.frombuffer(rows.column(c)[i].as_buffer(), np.uint64) for c in ("shingles_a", "shingles_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if _is_link(both, len(x), len(y), percent):
                    left.append(i)
        rows = rows.take(pa.array(left, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], ["a", "b"])


class _Side:
    """Rows of one side of a block as arrays."""

    def __init__(self, rows: list[dict]):
        self.node = np.array([r["node"] for r in rows], np.int64)
        self.component = np.array([r["component"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.signature = np.stack([np.frombuffer(r["signature"], np.uint16) for r in rows])
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]


def _block_links(left: _Side, right: _Side, needed: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between unlinked components; each row of `left` against all of
    `right` at once."""
    links = []
    for i in range(len(left.node)):
        (c,) = np.nonzero(
            (right.component != left.component[i]) & _similar_sizes(right.n, left.n[i], percent)
        )
        if not len(c):
            continue
        mine = np.broadcast_to(left.signature[i], (len(c), left.signature.shape[1]))
        c = c[_agree(right.signature[c], mine, needed)]
        if not len(c):
            continue
        own, others = left.sets[i], np.concatenate([right.sets[j] for j in c])
        at = np.minimum(np.searchsorted(own, others), len(own) - 1)
        starts = np.cumsum([0] + [len(right.sets[j]) for j in c[:-1]])
        both = np.add.reduceat((own[at] == others).astype(np.int64), starts)
        for j in c[_is_link(both, right.n[c], left.n[i], percent)]:
            pair = sorted((int(left.node[i]), int(right.node[j])))
            links.append((pair[0], pair[1]))
    return links


def _compare_blocks(
    batches: Iterator[pa.RecordBatch], needed: list[int], percent: int
) -> Iterator[pa.RecordBatch]:
    """Links of rows that come sorted by block: one block in memory at a time."""

    def linked(rows: list[dict]) -> list[tuple[int, int]]:
        sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
        if not all(sides):
            return []
        return _block_links(_Side(sides[0]), _Side(sides[1]), needed, percent)

    key, rows, links = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            here = (r["bucket"], r["l"], r["r"])
            if here != key:
                links += linked(rows)
                key, rows = here, []
            rows.append(r)
        yield _links_batch(links)
        links = []
    yield _links_batch(linked(rows))


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    links = sorted(set(links))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"]
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes: the smallest node reachable.

    Alternates large and small stars; every round is a stored table, of which
    the last stays.
    """
    edges = store(
        links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .filter("high <> low")
        .distinct()
    )
    before = None
    while True:
        mark = edges.agg(
            F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        ).first()
        if mark == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
                edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        before = mark
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least(F.min("low"), "high").alias("least"))
        large = (
            both.join(least, "high")
            .filter("low > high")
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .distinct()
        )
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        pairs = large.join(least, "high")
        small = pairs.select(
            F.explode(
                F.array(
                    F.struct("high", F.col("least").alias("low")),
                    F.struct(F.col("low").alias("high"), F.col("least").alias("low")),
                )
            ).alias("e")
        ).select("e.*")
        last, edges = edges, store(small.filter("high <> low").distinct())
        discard(last)


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, miss: float = MISS, shingle: int = SHINGLE
) -> DataFrame:
    """(row, doc_id, text_hash, n_shingles, component_id, kept_row).

    Every row of `docs` is one row; `component_id` is the smallest doc_id of its
    group and `kept_row` the row that stays of it: the first of smallest doc_id.
    Rows without words (null, empty or blank texts) are groups of their own.
    Repeated rows are copies of each other. Null ids count as larger than all
    others, and a group of null ids only has a null id. Other columns are left
    out. A link is missed with a probability of about the band miss (2.6e-7 at
    85 percent, 6e-5 at 80) plus `miss`. `shingle` is the number of words to a
    shingle.
    """
    text = F.coalesce("text", F.lit(""))
    read = pick(docs, "doc_id", "text", doc_id="bigint", text="string").select(
        "doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")
    )
    signed = read.mapInArrow(
        partial(_signed, shingle=shingle),
        "doc_id long, text_hash long, n long, set_a long, set_b long, signature binary",
    )
    tables = Tables()
    rows = tables.store(signed.select(F.monotonically_increasing_id().alias("row"), "*"))
    filled = rows.filter("n > 0")
    nodes = tables.store(
        filled.groupBy("set_a", "set_b")
        .agg(F.min(F.struct("row", "doc_id", "text_hash", "n", "signature")).alias("x"))
        .select(
            "set_a", "set_b", F.col("x.row").alias("node"), "x.doc_id", "x.text_hash",
            "x.n", "x.signature",
        )
    )
    found = _linked_nodes(read, nodes, percent, miss, shingle, tables)
    members = filled.select("row", "set_a", "set_b").join(
        nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"]
    )
    placed = members.join(found, "node", "left").select(
        "row", F.coalesce("component", "node").alias("component")
    )
    labelled = store(
        rows.select("row", "doc_id", "text_hash", "n")
        .join(placed, "row", "left")
        .select("row", "doc_id", "text_hash", "n", F.coalesce("component", "row").alias("component"))
    )
    tables.discard()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = labelled.groupBy("component").agg(F.min(order).alias("first")).select(
        "component", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept_row")
    )
    return labelled.join(first, "component").select(
        "row", "doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "kept_row"
    )


def _linked_nodes(
    read: DataFrame, nodes: DataFrame, percent: int, miss: float, shingle: int, tables: Tables
) -> DataFrame:
    """(node, component) of the nodes with links.

    What is stored for it goes to `tables`.
    """
    width = 2 * ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring("signature", b * width + 1, F.lit(width))),
    )
    banded = nodes.select("node", F.explode(bands).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = tables.store(banded.join(sizes, "bucket").distinct())
    mates = shared.groupBy("node").agg(F.sum("size").alias("mates"))
    hubs = (
        shared.join(mates, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("mates", (-F.col("node")).alias("node"))).alias("x"))
        .select("bucket", (-F.col("x.node")).alias("hub"))
    )
    hubs = tables.store(hubs)
    wanted = tables.store(
        nodes.join(mates.select("node"), "node").select(
            "node", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n", "signature"
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    narrow = broadcast_if_small(wanted.select("node", "__id", "__hash"))
    texts = read.join(narrow, same).select("node", "text")
    # Repeated rows give the same set several times.
    sets = texts.mapInArrow(
        partial(_with_sets, shingle=shingle), "node long, shingles binary"
    ).dropDuplicates(["node"])
    whole = tables.store(wanted.select("node", "n", "signature").join(sets, "node"))

    needed = fewest_matches(BANDS * ROWS // BATCH, percent, miss)
    pairs = (
        shared.join(hubs, "bucket")
        .filter("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )

    def carrying(side: str) -> DataFrame:
        return whole.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "signature", "shingles")))

    full = pairs.join(carrying("a"), "a").join(carrying("b"), "b")
    links = tables.store(full.mapInArrow(partial(_verify, needed=needed, percent=percent), "a long, b long"))
    label = tables.add(components(links))

    named = shared.join(label, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    hub_of = hubs.join(label, hubs["hub"] == label["node"], "left").select(
        "bucket", "hub", F.coalesce("component", "hub").alias("hub_component")
    )
    counted = named.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("component").alias("__low"), F.max("component").alias("__high")
    )
    split = hub_of.join(counted.filter("__low <> __high and size > 2"), "bucket").select(
        "bucket", "hub", "hub_component", "size"
    )
    # Where few buckets are left, their members need not meet in one task.
    marked = tables.store(named.join(broadcast_if_small(tables.store(split)), "bucket"))
    outside = marked.filter("component <> hub_component")
    outsiders = outside.groupBy("bucket").agg(F.count("*").alias("outside"))

    def chunk(count: str):
        return F.pmod(F.xxhash64("node"), F.ceil(F.col(count) / BLOCK)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), (F.ceil(F.col(count) / BLOCK) - 1).cast("int")))

    sized = broadcast_if_small(tables.store(outsiders))
    left = outside.join(sized, "bucket").select(
        "bucket", "node", "component", F.lit(0).alias("side"), chunk("outside").alias("l"), every("size").alias("r")
    )
    right = marked.join(sized, "bucket").select(
        "bucket", "node", "component", F.lit(1).alias("side"), every("outside").alias("l"), chunk("size").alias("r")
    )
    rows = left.unionByName(right).join(whole, "node")
    blocks = rows.repartition("bucket", "l", "r").sortWithinPartitions("bucket", "l", "r", "side")
    more = blocks.mapInArrow(
        partial(_compare_blocks, needed=needed, percent=percent), "a long, b long"
    )
    return tables.add(components(tables.store(links.unionByName(more))))


def dedup_report(found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return found.select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE
) -> DataFrame:
    """The rows of `docs` that stay, one of each group; columns as they are.

    Rows that are equal in id and text are told apart by counting them. Whether
    the texts are shuffled is left to Spark, which knows the bytes to broadcast.
    """
    found = near_duplicates(docs, percent, shingle=shingle)
    kept = (
        found.filter("row = kept_row")
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.count("*").alias("__stay"))
    )
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    text = F.coalesce("text", F.lit(""))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (
        F.xxhash64(text) == F.col("__hash")
    )
    joined = docs.join(store(kept), same)
    repeated = bool(rows.filter("rows > 1").head(1))
    discard(found)
    if repeated:
        twins = W.partitionBy("__id", "__hash").orderBy(*docs.columns)
        joined = joined.withColumn("__twin", F.row_number().over(twins)).filter(
            "__twin <= __stay"
        )
    return joined.select(*docs.columns)
