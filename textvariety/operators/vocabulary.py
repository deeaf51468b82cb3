"""Word, n-gram and per-document feature counts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textvariety.functions.features import (
    LONG_WORD,
    once,
    tokens,
)
from textvariety.operators.document_features import count_features
from textvariety.operators.feature_blocks import block_count, in_blocks
from textvariety.operators.ordering import running_totals, with_position
from textvariety.sources.scratch import broadcast_if_small, store


def vocabulary(df: DataFrame, text: str = "text", min_count: int = 1) -> DataFrame:
    """(word, n) for words seen at least min_count times."""
    return (
        df.select(F.explode(tokens(text)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def word_ids(vocab: DataFrame) -> DataFrame:
    """(word, n, id) of a vocabulary: ids from 0, frequent words first.

    Words of equal count follow in hash order. Ids are the place within a count
    plus the words of higher counts, so rare words, the bulk of any vocabulary,
    are never numbered by one task.
    """
    placed = with_position(vocab.select("word", "n"), ["word"], by=["n"])
    sizes = store(vocab.groupBy("n").agg(F.count("*").alias("_size")))
    above = running_totals(sizes, "n", ["_size"]).select(
        "n", (F.col("cum__size") - F.col("_size")).alias("_above")
    )
    return placed.join(broadcast_if_small(store(above)), "n").select(
        "word", "n", (F.col("_above") + F.col("position") - 1).alias("id")
    )


def explode_word_ngrams(df: DataFrame, words: str, n: int, name: str) -> DataFrame:
    """One row per n-gram of the array `words`, which is replaced by `name`.

    The same n-grams as features.word_ngrams, made by a generator over shifted
    slices: no function is called for each element.
    """
    others = [c for c in df.columns if c != words]
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    shifted = (F.slice(words, F.lit(i + 1), count).alias(f"__{i}") for i in range(n))
    long_enough = df.filter(F.size(words) >= n)
    return long_enough.select(*others, F.inline(F.arrays_zip(*shifted))).select(
        *others, F.concat_ws(" ", *(F.col(f"__{i}") for i in range(n))).alias(name)
    )


def word_ngram_counts(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(ngram, n) over all texts."""
    words = df.select(tokens(text).alias("__words"))
    return (
        explode_word_ngrams(words, "__words", n, "ngram")
        .groupBy("ngram")
        .agg(F.count("*").alias("n"))
    )


def char_ngram_counts(
    df: DataFrame, minn: int, maxn: int, text: str = "text"
) -> DataFrame:
    """(ngram, n) of the characters within words; distinct words are cut once."""
    grams = explode_char_ngrams(vocabulary(df, text), minn, maxn, name="ngram")
    return grams.groupBy("ngram").agg(F.sum("n").alias("n"))


def explode_char_ngrams(
    df: DataFrame, minn: int, maxn: int, word: str = "word", name: str = "gram"
) -> DataFrame:
    """One row per character n-gram of `word`, which is replaced by `name`.

    The same n-grams as features.char_ngrams, made by generators and substring
    so that they run in generated code. Long words are first cut into pieces
    that overlap by maxn - 1: a row never drags a long word along.
    """
    others = [c for c in df.columns if c != word]
    marked = F.concat(F.lit("<"), F.col(word), F.lit(">"))

    def piece(text: Column, first: Column, last: Column) -> Column:
        return F.struct(text.alias("_w"), first.alias("_first"), last.alias("_last"))

    def cut(chars: Column) -> Column:
        last = F.floor((F.size(chars) - 1) / F.lit(LONG_WORD)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda p: piece(
                F.array_join(
                    F.slice(chars, p * LONG_WORD + 1, F.lit(LONG_WORD + maxn - 1)), ""
                ),
                p == 0,
                p == last,
            ),
        )

    pieces = F.when(
        F.length(word) <= LONG_WORD - 2,
        F.array(piece(marked, F.lit(True), F.lit(True))),
    ).otherwise(once(F.split(marked, ""), cut))
    size, start = F.length("_w"), F.col("_i")
    starts = F.sequence(F.lit(1), F.least(size, F.lit(LONG_WORD)))

    def gram(n: int) -> Column:
        fits = start + (n - 1) <= size
        if n == 1:
            fits &= ~(F.col("_first") & (start == 1))
            fits &= ~(F.col("_last") & (start == size))
        return F.when(fits, F.substring("_w", start, F.lit(n)))

    return (
        df.select(*others, F.inline(pieces))
        .select(*others, "_w", "_first", "_last", F.explode(starts).alias("_i"))
        .select(
            *others,
            F.explode(F.array(*(gram(n) for n in range(max(minn, 1), maxn + 1)))).alias(name),
        )
        .filter(F.col(name).isNotNull())
    )


def feature_counts(
    df: DataFrame,
    key: str,
    text: str = "text",
    vocab: DataFrame | None = None,
    word_n: int = 1,
    minn: int = 0,
    maxn: int = 0,
    bucket: int = 1_000_000,
) -> DataFrame:
    """(key, feature, n): words by name, word and character n-grams by bucket.

    With `vocab` (column `word`; see scratch.broadcast_if_small) other words
    lose their own feature but keep their character n-grams, as in training.
    Texts are shuffled whole, rows of one key to one block; a block is sent the
    words of `vocab` that stand in it, each once, and its counts are taken there,
    key by key. See operators/document_features.py.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = block_count(rows, "text")
    block = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    docs = store(rows.withColumn("block", block).repartitionById(parts, "block"), "zstd")
    if vocab is None:
        met = docs.select("block", F.lit(1).alias("side"), "key", "text", F.lit("").alias("feature"))
        met = met.repartitionById(parts, "block")
    else:
        met = in_blocks(docs, parts, tokens, vocab.select(F.col("word").alias("feature")))
    fed = met.sortWithinPartitions("block", "side", "key").select(
        "block", "side", "key", "text", "feature"
    )
    schema = StructType(
        [
            StructField("key", docs.schema["key"].dataType),
            StructField("feature", StringType()),
            StructField("n", LongType()),
        ]
    )
    count = partial(
        count_features, named=vocab is not None, word_n=word_n, minn=minn, maxn=maxn, bucket=bucket
    )
    return fed.mapInArrow(count, schema).withColumnRenamed("key", key)
