"""Token and n-gram expressions. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textvariety.functions.text import _col

# Fixed value: ASCII blanks separating tokens.
TOKEN_SEPARATOR = r"[ \t\n\x0B\f\r]+"
LONG_WORD = 128


def tokens(text: Column | str) -> Column:
    """Words of a text: split at ASCII blanks, line feeds among them, case and
    punctuation kept."""
    return F.array_remove(F.split(_col(text), TOKEN_SEPARATOR), "")


def word_ngrams(words: Column | str, n: int) -> Column:
    """Contiguous n-grams of a word array; empty when there are fewer than n words."""
    words = _col(words)
    if n == 1:
        return words

    def pairs(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(
            F.slice(w, F.lit(1), rest),
            F.slice(w, F.lit(2), rest),
            lambda a, b: F.concat_ws(" ", a, b),
        )

    def runs(w: Column) -> Column:
        return _runs(F.size(w), n, lambda i, n: F.array_join(F.slice(w, i, n), " "))

    return once(words, pairs if n == 2 else runs)


def char_ngrams(word: Column | str, minn: int, maxn: int) -> Column:
    """Character n-grams of '<word>', without lone boundary marks.

    Substring has to walk to its start, so words longer than LONG_WORD are cut
    into code points first: the cost stays linear for megabyte-long tokens.
    """
    if maxn < 1:
        return F.array().cast("array<string>")
    word = _col(word)
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    sizes = range(max(minn, 2), maxn + 1)

    def short(w: Column) -> Column:
        return F.concat(*(_runs(F.length(w), n, lambda i, n: F.substring(w, i, n)) for n in sizes))

    def long(chars: Column) -> Column:
        def run(i: Column, n: Column) -> Column:
            return F.array_join(F.slice(chars, i, n), "")

        return F.concat(*(_runs(F.size(chars), n, run) for n in sizes))

    whole = F.array(marked)
    is_short = lambda w: F.length(w) <= LONG_WORD
    quick = F.transform(F.filter(whole, is_short), short)
    careful = F.transform(
        F.filter(whole, lambda w: ~is_short(w)), lambda w: once(F.split(w, ""), long)
    )
    grams = F.flatten(F.concat(quick, careful))
    return F.concat(F.split(word, ""), grams) if minn <= 1 else grams


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(size: Column, n: int, run: Callable[[Column, Column], Column]) -> Column:
    """run(i, n) for each start i of a run of n among `size` elements."""
    count = size - (n - 1)
    # sequence(1, 0) would count down.
    upto = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    starts = F.slice(upto, F.lit(1), F.greatest(count, F.lit(0)))
    return F.transform(starts, lambda i: run(i, F.lit(n)))


def feature_bucket(feature: Column | str, bucket: int) -> Column:
    """Stable bucket of a feature: leading 32 bits of its md5, modulo bucket."""
    head = F.substring(F.md5(_col(feature).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(bucket)


def subwords(word: Column | str, minn: int, maxn: int, bucket: int) -> Column:
    """array<struct<gram, id>>: character n-grams of a word and their buckets."""
    return F.transform(
        char_ngrams(word, minn, maxn),
        lambda g: F.struct(g.alias("gram"), feature_bucket(g, bucket).alias("id")),
    )


def bucket_feature(bucket: Column | str) -> Column:
    """Name of a bucket, distinct from every word (words hold no space)."""
    return F.concat(F.lit("# "), _col(bucket).cast("string"))


def bucket_name(feature: Column | str, bucket: int) -> Column:
    """Name of the bucket of a feature."""
    return bucket_feature(feature_bucket(feature, bucket))
