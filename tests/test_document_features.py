"""Counts of features, taken chunk by chunk and block by block."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textvariety.functions import features
from textvariety.operators import document_features as dfe
from textvariety.operators import feature_blocks as fb
from textvariety.operators.vocabulary import feature_counts

ODD = "a \tb\n\nc\x0bd\x0ce\rf \x1cg\x85h\xa0i j  k \x00 l\x00 "


def brute_force(rows, word_n, minn, maxn, bucket, known):
    want = Counter()
    for key, text in rows:
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
        for w in words:
            if known is None or w in known:
                want[key, w] += 1
            marked = f"<{w}>"
            grams = list(w) if minn <= 1 <= maxn else []
            for n in range(max(minn, 2), maxn + 1):
                grams += [marked[j : j + n] for j in range(len(marked) - n + 1)]
            want.update((key, f"# {bucket_of(g, bucket)}") for g in grams)
        for n in range(2, word_n + 1):
            runs = (" ".join(words[j : j + n]) for j in range(len(words) - n + 1))
            want.update((key, f"# {bucket_of(r, bucket)}") for r in runs)
    return want


def bucket_of(feature, bucket):
    return int(hashlib.md5(feature.encode()).hexdigest()[:8], 16) % bucket


def counted(rows, word_n, minn, maxn, bucket, known):
    """Rows of equal keys follow each other."""
    side0 = pa.record_batch(
        {"block": pa.array([0] * len(known or ()), pa.int32()), "side": pa.array([0] * len(known or ()), pa.int32()),
         "key": pa.nulls(len(known or ()), pa.int64()), "text": pa.nulls(len(known or ()), pa.string()),
         "feature": pa.array(sorted(known or ()), pa.string())}
    )
    keys, texts = zip(*rows)
    side1 = pa.record_batch(
        {"block": pa.array([0] * len(rows), pa.int32()), "side": pa.array([1] * len(rows), pa.int32()),
         "key": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.string()), "feature": pa.nulls(len(rows), pa.string())}
    )
    given = [side0, side1.slice(0, 5), side1.slice(5)]
    got = [
        r for b in dfe.count_features(iter(given), known is not None, word_n, minn, maxn, bucket) for r in b.to_pylist()
    ]
    found = {(r["key"], r["feature"]): r["n"] for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
@pytest.mark.parametrize("shape", [(1, 0, 0), (2, 3, 4), (3, 1, 3), (1, 1, 1), (2, 6, 4), (2, 2, 2)])
def test_counts_equal_brute_force_wherever_chunks_end(monkeypatch, chunk, shape):
    monkeypatch.setattr(dfe, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(dfe, "SORTED_AT_ONCE", chunk)
    monkeypatch.setattr(dfe, "COUNTS_AT_ONCE", 1 + chunk // 4)
    rng = np.random.default_rng(chunk)
    words = ["a", "aa", "aaaa", "ü", "x𝔘y", "x" * 70, "<", ">", "12", "#"]
    rows = [(None, ODD), (None, None), (None, "a b"), (1, ""), (1, "a"), (1, " "), (2, "\n"), (3, None)]
    rows += [(5, " ".join(rng.choice(words, 12))) for _ in range(9)]
    rows += [(k, " ".join(rng.choice(words, rng.integers(0, 9)))) for k in range(6, 40)]
    for known in (None, {"a", "x𝔘y", "never"}, set()):
        for bucket in (1, 7, 1_000_000):
            assert counted(rows, *shape, bucket, known) == brute_force(rows, *shape, bucket, known)


def test_buckets_of_all_lengths_are_those_of_md5(monkeypatch):
    monkeypatch.setattr(dfe, "HASHED_AT_ONCE", 7)
    said = ["", *("aü𝔘"[i % 3] * i for i in range(1, 70)), "b" * 1000]
    got = dfe._buckets_of(pa.array(["left out", *said])[1:], 1 << 32)
    assert got.tolist() == [bucket_of(x, 1 << 32) for x in said]
    assert dfe._buckets_of(pa.array([""]), 1 << 32).tolist() == [bucket_of("", 1 << 32)]
    assert dfe._buckets_of(pa.array([], pa.string()), 5).tolist() == []


def test_blocks_are_counted_in_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(fb, "BLOCK_BYTES", 400)
    rows = [(i, f"a b w{i % 7} " * 3) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, text string").repartition(3)
    parts = fb.block_count(df, "text")
    vocab = spark.createDataFrame([("a",)], "word string")
    for listed in (vocab, None):
        made = feature_counts(df, "i", vocab=listed, word_n=2, minn=3, maxn=4)
        assert made.select(F.spark_partition_id()).distinct().count() == parts > 10


def test_tokens_end_at_ascii_blanks_only(spark):
    df = spark.createDataFrame([(ODD,), (None,), ("\n",)], "text string")
    got = [r["t"] for r in df.select(features.tokens("text").alias("t")).collect()]
    assert got == [["a", "b", "c", "d", "e", "f", "\x1cg\x85h\xa0i", "j", " k", "\x00", "l\x00"], None, []]
