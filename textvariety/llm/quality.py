"""Quality of texts by a generalised additive model with pairwise interactions.

A score is the sum of one looked-up number for each feature and for a few pairs
of features. The lookup tables are learned by cyclic boosting: shallow trees over
one feature's bins at a time, in turn and with a small step, then the same over
the cells of the pairs that explain most of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvariety.llm.common import BLANKS, WORDS, let, pick

# Labelled documents learned from at most, those of smallest hash.
SAMPLE_LABELS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 6
ROUNDS, PAIR_ROUNDS, STEP = 150, 60, 0.15
MIN_LEAF = 20
# Who is held out, and the score from which a text passes.
HELD_OUT, PARTS, PASS = 2, 4, 0.7

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "distinct_lines",
    "letters", "digits", "capitals", "stops", "symbols", "blanks", "line_words",
    "short_words",
)


def features(text: Column) -> Column:
    """A struct of FEATURES, doubles, of a text that is not null.

    Shares are of characters or words; those of an empty text are 0.
    """

    def measured(x: Column) -> Column:
        n, words = F.length(x["text"]), F.size(x["words"])

        def share(part: Column, whole: Column) -> Column:
            return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

        def without(pattern: str) -> Column:
            return n - F.length(F.regexp_replace(x["text"], pattern, ""))

        lines = F.split(x["text"], "\n")
        short = F.regexp_count(
            x["text"], F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])")
        )
        blanks = without(BLANKS)
        made = {
            "log_chars": F.log1p(n.cast("double")),
            "log_words": F.log1p(words.cast("double")),
            "word_length": share(n - blanks, words),
            "distinct_words": share(F.size(F.array_distinct(x["words"])), words),
            "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
            "letters": share(without(r"\p{L}+"), n),
            "digits": share(without("[0-9]+"), n),
            "capitals": share(without(r"\p{Lu}+"), n),
            "stops": share(without("[.,;:!?]+"), n),
            "symbols": share(without(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"), n),
            "blanks": share(blanks, n),
            "line_words": share(words, F.size(lines)),
            "short_words": share(short, words),
        }
        return F.struct(*(made[f].alias(f) for f in FEATURES))

    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return let(F.struct(text.alias("text"), words.alias("words")), measured)


@dataclass
class AdditiveModel:
    """edges[j]: bin edges of feature j; tables[j]: its number for each bin.

    pairs: (i, j, edges of i, edges of j, table).
    """

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, left, right, table in self.pairs:
            a, b = np.searchsorted(left, x[:, i], "right"), np.searchsorted(right, x[:, j], "right")
            total += table[a, b]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> int:
    """Bins left of the best cut; 0 for none."""
    if len(g) < 2:
        return 0
    gl, hl, nl = (np.cumsum(a)[:-1] for a in (g, h, n))
    gain = gl * _leaf(gl, hl) + (g.sum() - gl) * _leaf(g.sum() - gl, h.sum() - hl)
    gain[(nl < MIN_LEAF) | (n.sum() - nl < MIN_LEAF)] = -1
    best = int(np.argmax(gain))
    return best + 1 if gain[best] > g.sum() * _leaf(g.sum(), h.sum()) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over the bins of a feature."""
    at = _cut(g, h, n) if depth else 0
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    sides = ((g[:at], h[:at], n[:at]), (g[at:], h[at:], n[at:]))
    return np.concatenate([_tree(*side, depth - 1) for side in sides])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best pair of cuts through a table of cells."""
    best, cuts = -1.0, None
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(g.shape[0] - 1):
        top, bottom = (cg[i], ch[i]), (cg[-1] - cg[i], ch[-1] - ch[i])
        gain = np.zeros(g.shape[1] - 1)
        for a, b in (top, bottom):
            gain += a[:-1] * _leaf(a[:-1], b[:-1]) + (a[-1] - a[:-1]) * _leaf(a[-1] - a[:-1], b[-1] - b[:-1])
        if len(gain) and gain.max() > best:
            best, cuts = float(gain.max()), (i + 1, int(gain.argmax()) + 1)
    out = np.zeros_like(g)
    if cuts:
        i, j = cuts
        for rows in (slice(0, i), slice(i, None)):
            for columns in (slice(0, j), slice(j, None)):
                out[rows, columns] = _leaf(g[rows, columns].sum(), h[rows, columns].sum())
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on rows x with labels y of 0 and 1; none give 0.5."""
    ones = float(y.sum())
    intercept = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(intercept, edges, tables)
    if not 0 < ones < len(y):
        return model
    total = np.full(len(y), intercept)
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, t, n in zip(bins, tables, counts):
            g, h = slopes()
            sums = (np.bincount(b, a, len(t)) for a in (g, h))
            step = STEP * _tree(*sums, n)
            t += step
            total += step[b]

    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def table_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat = cells[i] * shape[1] + cells[j]
        g, h = (np.bincount(flat, a, shape[0] * shape[1]).reshape(shape) for a in slopes())
        return g, h

    ranked = sorted(
        combinations(range(x.shape[1]), 2), key=lambda p: -_quadrants(*table_sums(*p))[0]
    )[:PAIRS]
    found = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in found.items():
            step = STEP * _quadrants(*table_sums(i, j))[1]
            t += step
            total += step[cells[i], cells[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in found.items()]
    return model


def _held_out() -> Column:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % PARTS
    return F.coalesce(part == HELD_OUT, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> AdditiveModel:
    """Fit on at most `sample` labelled documents that are not held out.

    Null or contradictory labels of an id, and ids without a document, are left
    out; of several documents of one id the one of smallest features is taken.
    Only their features come to the driver: `sample` rows of 13 numbers.
    """
    known = (
        pick(labels, "doc_id", "quality", doc_id="bigint", quality="int")
        .filter(F.col("quality").isin(0, 1) & ~_held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("__other"))
        .filter("quality = __other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .select(F.col("doc_id").alias("__id"), "quality")
    )
    rows = pick(docs, "doc_id", "text", doc_id="bigint", text="string")
    joined = rows.join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    measured = joined.groupBy("doc_id", "quality").agg(
        F.min(features(F.coalesce("text", F.lit("")))).alias("f")
    )
    got = measured.select("doc_id", "quality", "f.*").toPandas().sort_values("doc_id")
    x = got[list(FEATURES)].to_numpy(float)
    return fit_additive(x, got["quality"].to_numpy(float))


def scored(docs: DataFrame, model: AdditiveModel, *keep: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the columns `keep` of each row.

    A null text is scored as an empty one; repeated rows and null ids are scored
    like any other; null ids are not held out.
    """
    rows = pick(docs, *dict.fromkeys(("doc_id", "text", *keep)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(x.to_numpy(float)))

    return rows.select(
        *dict.fromkeys(("doc_id", *keep)), _held_out().alias("held_out"), score(features(text)).alias("score")
    ).withColumn("predicted", (F.col("score") >= PASS).cast("int"))
