"""Sums over the features of texts, block by block."""

import pytest
from pyspark.sql import functions as F

from textvariety.functions.features import tokens
from textvariety.operators import classes
from textvariety.operators import feature_blocks as fb
from textvariety.operators.log_odds import FeatureConfig, LogOddsModel, broadcast_scorer


@pytest.mark.parametrize("sparse", [False, True])
def test_sums_of_many_blocks_equal_brute_force(spark, monkeypatch, sparse):
    monkeypatch.setattr(fb, "BLOCK_BYTES", 200)
    monkeypatch.setattr(fb, "SUMS_AT_ONCE", 6)
    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 30))) for i in range(60)]
    texts += [(60, None), (60, "w1 w1 nothing"), (None, "w2")]
    known = {f"w{i}": (float(i), i / 7) for i in range(1, 15)}
    at = F.array(F.lit(0), F.lit(1)) if sparse else F.lit(None).cast("array<int>")
    table = spark.createDataFrame(
        [(w, list(v)) for w, v in known.items()], "feature string, value array<double>"
    ).withColumn("at", at)
    docs = spark.createDataFrame(texts, "id long, text string")
    assert fb.block_count(docs, "text") > 10
    got = [(r["id"], r["n"], *r["sums"]) for r in fb.feature_sums(docs, table, tokens, 2, "id").collect()]
    want = []
    for i, text in texts:
        found = [known[w] for w in (text or "").split() if w in known]
        if found:
            want.append((i, len(found), sum(a for a, _ in found), sum(b for _, b in found)))
    key = lambda r: (r[0] is None, r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a == pytest.approx(b)


def test_a_block_is_sent_each_feature_once(spark):
    docs = spark.createDataFrame(
        [(i % 2, i, "a a a b") for i in range(100)], "block int, key long, text string"
    )
    table = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "feature string, value double")
    met = fb.in_blocks(docs, 2, tokens, table)
    assert met.filter("side = 0").count() == 2 and met.filter("side = 1").count() == 100


def test_classes_are_scored_without_a_row_per_document_and_feature(spark, monkeypatch):
    rows = [(i, f"a b c{i % 3}", "xyz"[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = classes.train_log_odds_classes(docs)

    def refuse(df):
        raise AssertionError(df.columns)

    monkeypatch.setattr(classes, "store", refuse)
    top = classes.predict_top_k_classes(docs, model, "doc_id", k=1)
    assert {r["doc_id"]: r["label"] for r in top.collect()} == {i: x for i, _, x in rows}


def test_models_of_many_megabytes_are_not_broadcast(spark):
    name = F.concat(F.lit("a feature of some length "), F.col("id").cast("string"))
    weights = spark.range(1_000_000).select(name.alias("feature"), F.lit(1.0).alias("weight"))
    assert broadcast_scorer(LogOddsModel(weights, F.lit(0.0), FeatureConfig())) is None
