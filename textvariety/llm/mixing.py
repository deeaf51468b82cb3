"""Mixing sources to target weights, shard by shard.

Texts are cut into blocks of words. Every source owes the mix an exact number
of blocks; a tree of multivariate hypergeometric draws splits those quotas among
the output shards, as if all owed blocks were dealt out by lot. A shard then
takes its stretch of each source's permuted blocks, no block twice, and shuffles
them by itself. A source that is to be seen more than once starts over in a new
permutation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textvariety.llm.common import WORDS, pick
from textvariety.sources.scratch import store

# The weights of the sources in order, repeating; how much of all
# words the mix holds; how often a word may be seen.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS = 2048
SHARD_BLOCKS = 4096
# Permuted blocks are ranked inside of so many hash buckets for each source.
BUCKETS = 4096
# numpy draws exactly from populations below this; larger nodes, at the top of
# the tree only, use the normal approximation rounded into the possible range.
EXACT_BELOW = 10**9


def targets(sizes: list[int], weights: tuple[float, ...], share: float, most: float) -> list[float]:
    """Words each source gives: by weight, at most `most` times its size.

    What the capped sources leave over goes to the others by weight again.
    """
    goal = share * sum(sizes)
    caps = [most * s for s in sizes]
    owed = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = goal - sum(caps[i] for i in full)
        unit = rest / sum(owed[i] for i in free) if free else 0.0
        over = {i for i in free if unit * owed[i] > caps[i]}
        if not over:
            return [caps[i] if i in full else unit * owed[i] for i in range(len(sizes))]
        full |= over


def draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n draws without putting back."""
    if colours.sum() < EXACT_BELOW:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out, rest = np.zeros_like(colours), int(colours.sum())
    for i, here in enumerate(map(int, colours)):
        others = rest - here
        share = here / max(rest, 1)
        spread = n * share * (1 - share) * (rest - n) / max(rest - 1, 1)
        want = round(rng.normal(n * share, max(spread, 0.0) ** 0.5))
        out[i] = min(max(want, n - others, 0), here, n)
        n, rest = n - int(out[i]), others
    return out


@dataclass(frozen=True)
class SplittingTree:
    """Quotas of every source dealt out among `shards` shards of equal size."""

    quotas: tuple[int, ...]
    shards: int
    seed: int

    def _edge(self, shard: int) -> int:
        return shard * sum(self.quotas) // self.shards

    def leaves(self, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, first, count) by source, for the wanted shards in order.

        A node's draw depends on its seed and bounds only, so any task finds the
        same leaf by walking from the root: log2(shards) draws.
        """
        zero = np.zeros(len(self.quotas), np.int64)
        stack = [(0, self.shards, zero, np.array(self.quotas, np.int64))]
        while stack:
            low, high, first, counts = stack.pop()
            here = np.searchsorted(wanted, [low, high])
            if here[0] == here[1]:
                continue
            if high - low == 1:
                yield low, first, counts
                continue
            middle = (low + high) // 2
            rng = np.random.Generator(np.random.PCG64([self.seed, low, high]))
            left = draw(rng, counts, self._edge(middle) - self._edge(low))
            stack.append((middle, high, first + left, counts - left))
            stack.append((low, middle, first, left))


@dataclass(frozen=True)
class Mix:
    """rows: (row, doc_id, source, size); sources: (source, source_size, target);
    draws: (shard, slot, row, pass, block, words)."""

    rows: DataFrame
    sources: DataFrame
    draws: DataFrame


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 0,
    keep: tuple[str, ...] = (),
) -> Mix:
    """Draw a mix of all documents; `keep` names columns kept in `rows`.

    A block is up to `block_words` words of one document. The last block a
    source gives is cut short, so that its words are its target, rounded. Rows
    are numbered once, in a stored table, so repeated rows and null ids are
    documents of their own; null texts have no words and are never drawn; a null
    source is a source, the last. Equal seeds and tables draw equal words.

    One row for each source comes to the driver: as much as the table of their
    weights would hold.
    """
    spark = docs.sparkSession
    wanted = dict.fromkeys(("doc_id", "text", "source", *keep))
    read = pick(docs, *wanted, text="string", source="string")
    text = F.coalesce("text", F.lit(""))
    rows = store(
        read.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "source",
            F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", text).alias("lot"),
            # A prefix keeps them apart from the columns of the mix.
            *(F.col(c).alias(f"kept_{c}") for c in keep),
        )
    )
    blocks = F.ceil(F.col("size") / block_words)
    told = rows.groupBy("source").agg(
        F.sum("size").alias("size"), F.sum(blocks).alias("blocks")
    )
    told = sorted(
        told.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode())
    )
    goals = targets([r["size"] for r in told], weights, share, most)
    plan = [
        (i, r["source"], r["size"], float(goal), *divmod(round(goal), max(r["size"], 1)), r["blocks"])
        for i, (r, goal) in enumerate(zip(told, goals))
    ]
    schema = (
        "source_no int, source string, source_size long, target double,"
        " passes long, rest long, source_blocks long"
    )
    sources = spark.createDataFrame(plan, schema)
    drawn = store(_drawn(rows, sources, block_words))
    quotas = {
        r["source_no"]: r["n"]
        for r in drawn.groupBy("source_no").agg(F.count("*").alias("n")).collect()
    }
    owed = tuple(quotas.get(i, 0) for i in range(len(plan)))
    draws = _dealt(drawn, owed, shard_blocks, seed)
    return Mix(rows, sources.select("source", "source_size", "target"), draws)


def _drawn(rows: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """(source_no, at, row, pass, block, words): every block a source owes, `at`
    being its place in the source's permutations, one after another."""
    joined = rows.filter("size > 0").join(
        F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])
    )
    turns = F.col("passes") + (F.col("rest") > 0).cast("int")
    every = joined.filter(turns > 0).select(
        "row", "lot", "size", "source_no", "passes", "rest", "source_blocks",
        F.explode(F.sequence(F.lit(0).cast("bigint"), turns - 1)).alias("pass"),
    ).select(
        "*",
        F.explode(
            F.sequence(
                F.lit(0).cast("bigint"), F.ceil(F.col("size") / block_words) - 1
            )
        ).alias("block"),
    )
    order = F.xxhash64("lot", "pass", "block")
    cut = every.select(
        "row", "source_no", "pass", "block", "passes", "rest", "source_blocks",
        order.alias("order"),
        F.pmod(F.shiftrightunsigned(order, 20), F.lit(BUCKETS)).alias("bucket"),
        F.least(F.col("size") - F.col("block") * block_words, F.lit(block_words)).alias("words"),
    )
    key = ["source_no", "pass", "bucket"]
    inside = W.partitionBy(*key).orderBy("order", "row", "block")
    ranked = cut.select(
        "*",
        (F.row_number().over(inside) - 1).alias("__n"),
        (F.sum("words").over(inside) - F.col("words")).alias("__w"),
    )
    before = W.partitionBy("source_no", "pass").orderBy("bucket").rowsBetween(
        W.unboundedPreceding, -1
    )
    sums = cut.groupBy(*key).agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    starts = sums.select(
        *key,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    placed = ranked.join(starts, key)
    left = F.col("rest") - F.col("w_before") - F.col("__w")
    words = F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(
        F.least(F.col("words"), left)
    )
    at = F.col("pass") * F.col("source_blocks") + F.col("n_before") + F.col("__n")
    return placed.select(
        "source_no", at.alias("at"), "row", "pass", "block", words.alias("words")
    ).filter("words > 0")


def _dealt(drawn: DataFrame, owed: tuple[int, ...], shard_blocks: int, seed: int) -> DataFrame:
    """Give every drawn block its shard and its slot there."""
    spark = drawn.sparkSession
    shards = max(1, -(-sum(owed) // shard_blocks))
    tree = SplittingTree(owed, shards, seed)
    # Stretches are looked up by steps about as long as a source's mean stretch.
    step = tuple(max(1, -(-q // shards)) for q in owed)

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, first, count in tree.leaves(np.sort(batch["id"].to_numpy())):
                (has,) = np.nonzero(count)
                out.append(
                    pd.DataFrame(
                        {
                            "shard": shard,
                            "source_no": has.astype("int32"),
                            "first": first[has],
                            "last": first[has] + count[has] - 1,
                        }
                    )
                )
            if out:
                yield pd.concat(out)

    found = spark.range(0, shards, 1, max(1, min(shards // 64, 10_000))).mapInPandas(
        stretches, "shard long, source_no int, first long, last long"
    )
    steps = F.array(*(F.lit(s).cast("bigint") for s in step or (1,)))

    def cell(column: str):
        return F.floor(F.col(column) / F.get(steps, F.col("source_no")))

    ranges = found.select(
        "shard", "first", "last", F.col("source_no").alias("__s"),
        F.explode(F.sequence(cell("first"), cell("last"))).alias("__cell"),
    )
    blocks = drawn.select("*", cell("at").alias("cell"))
    joined = blocks.join(
        ranges,
        (F.col("source_no") == F.col("__s"))
        & (F.col("cell") == F.col("__cell"))
        & F.col("at").between(F.col("first"), F.col("last")),
    )
    lot = F.xxhash64(F.lit(seed), "shard", "source_no", "at")
    slot = F.row_number().over(W.partitionBy("shard").orderBy(lot, "source_no", "at")) - 1
    return joined.select(
        "shard", slot.alias("slot"), "row", "pass", "block", "words"
    )


def words_taken(made: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    taken = made.draws.groupBy("row").agg(F.sum("words").alias("taken"))
    rows = made.rows.join(taken, "row", "left")
    joined = rows.join(
        F.broadcast(made.sources), rows["source"].eqNullSafe(made.sources["source"])
    )
    return joined.select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def cut_words(text: str, first: int, words: int) -> str:
    """From word `first` on, `words` words with the blanks between them."""
    import re

    at = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)][first : first + words]
    return text[at[0][0] : at[-1][1]] if at else ""


def mixed_texts(made: Mix, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The draws with the text they stand for, and the other columns of `rows`.

    `rows` must have been made with keep=(text, …). A block that is a whole
    document keeps its text as it is; a part is cut from its first to its last
    word.
    """

    @F.pandas_udf("string")
    def part(texts: pd.Series, blocks: pd.Series, words: pd.Series) -> pd.Series:
        cut = [
            cut_words(t, b * block_words, w) for t, b, w in zip(texts, blocks, words)
        ]
        return pd.Series(cut, dtype=object)

    joined = made.draws.join(made.rows, "row")
    whole = (F.col("block") == 0) & (F.col("words") == F.col("size"))
    kept = F.col(f"kept_{text}")
    # Only parts go through Python: whole texts are sent as nulls.
    asked = F.when(~whole, kept)
    cut = part(F.coalesce(asked, F.lit("")), "block", "words")
    return joined.select(
        "*", F.when(whole, kept).otherwise(cut).alias("__piece")
    ).drop(f"kept_{text}").withColumnRenamed("__piece", text)
