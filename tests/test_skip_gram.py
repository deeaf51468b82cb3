"""What word vectors cost while they are trained block by block."""

import os
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textvariety.functions.features import tokens
from textvariety.operators import feature_blocks as fb
from textvariety.operators import skip_gram
from textvariety.sources.scratch import scratch_root


@pytest.mark.parametrize("dim", [1, 7, 100])
def test_vectors_travel_in_three_bytes_a_number(dim):
    rng = np.random.default_rng(dim)
    size = 10.0 ** rng.integers(-20, 6, (500, 1))
    given = (rng.normal(size=(500, dim)) * size).astype(np.float32)
    given[3] = 0
    sent = skip_gram._packed(given)
    assert {len(x) for x in sent.to_pylist()} == {4 + 3 * dim}
    most = np.abs(given).max(axis=1, keepdims=True)
    got = skip_gram._unpacked(sent, dim)
    assert (np.abs(got - given) <= most.astype(np.float64) / (1 << 23)).all()
    assert len(skip_gram._unpacked(skip_gram._packed(given[:0]), dim)) == 0


def test_each_block_has_a_task_of_its_own(spark):
    rows = [(b, i, f"a w{i}") for b in range(13) for i in range(3)]
    docs = spark.createDataFrame(rows, "block int, key int, text string")
    table = spark.createDataFrame([("a", 1.0), ("w2", 2.0)], "feature string, value double")
    met = fb.in_blocks(docs, 13, tokens, table).select("block", F.spark_partition_id().alias("task"))
    assert sorted(map(tuple, met.distinct().collect())) == [(b, b) for b in range(13)]


@pytest.mark.parametrize("epochs", [1, 2])
def test_only_the_vectors_stay_on_disk(spark, epochs):
    folder = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([("a b c " * 9,), ("b c d " * 9,), (None,)], "text string")
    made = skip_gram.train(df, "text", 6, 5, 3, epochs, 2, 42)
    assert {r["word"] for r in made.collect()} == set("abcd")
    kept = [f for f in os.listdir(folder) if f not in before and f.startswith("table-")]
    assert len(kept) == 1


def test_texts_travel_in_packs_and_come_back_whole(spark):
    rows = [(f"{i} " + "some words " * (i % 40),) for i in range(600)] + [(None,), ("",), ("x" * 5_000,)]
    df = spark.createDataFrame(rows, "text string").repartition(4)
    dealt = df.mapInArrow(partial(skip_gram._dealt, parts=5, size=2_000), "block int, key int, text binary")
    packs = dealt.collect()
    sizes = Counter()
    for p in packs:
        (texts, *shares), *more = skip_gram._texts(pa.array([p["text"]]))
        said = [len(x or "") for x in texts.to_pylist()]
        assert shares == [0, 1] and not more and (sum(said) <= 2_000 or len(said) == 1)
        sizes[p["block"]] += sum(said)
    assert sorted(sizes) == [0, 1, 2, 3, 4] and max(sizes.values()) - min(sizes.values()) < 20_000
    assert sum(len(p["text"]) for p in packs) < sum(sizes.values())
    back = dealt.mapInArrow(skip_gram._read, "text string").collect()
    assert Counter(r["text"] for r in back) == Counter(x for x, in rows)


def test_packs_are_unpacked_some_at_a_time(monkeypatch):
    monkeypatch.setattr(skip_gram, "UNPACKED_BYTES", 60)
    packs = pa.array([skip_gram._pack(pa.array([f"text {i}", None])) for i in range(9)])
    got = list(skip_gram._texts(packs))
    assert len(got) > 2 and all(t.nbytes < 90 for t, *_ in got)
    assert [x for t, *_ in got for x in t.to_pylist()] == [x for i in range(9) for x in (f"text {i}", None)]
    assert [a for _, a, _ in got[1:]] == [b for *_, b in got[:-1]] and got[0][1] == 0 and got[-1][2] == 1


def test_words_are_those_of_the_expression(spark):
    said = ["a \tb\n\nc\x0bd\x0ce\rf \x1cg\x85h\xa0i j", None, "", " \n", "ü𝔘 ü𝔘 "]
    at, words = fb.words_of(pa.array(said, pa.string()))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, text string")
    want = [(r["i"], r["w"]) for r in df.select("i", F.explode(tokens("text")).alias("w")).collect()]
    assert sorted(zip(at.tolist(), words.to_pylist())) == sorted(want)


@pytest.mark.parametrize("epochs", [1, 2])
def test_rounds_train_every_block(spark, monkeypatch, epochs):
    rng = np.random.default_rng(1)
    rows = [(f"only{i} " * 3 + " ".join(f"w{j}" for j in rng.integers(0, 50, 30)),) for i in range(200)]
    df = spark.createDataFrame(rows, "text string").repartition(9)
    folder = scratch_root(spark).removeprefix("file:")
    known = {f"w{j}" for j in range(50)} | {f"only{i}" for i in range(200)}
    for rounds in ([(0, 7)], [(0, 2), (2, 3), (3, 7)]):
        monkeypatch.setattr(skip_gram, "_rounds", lambda *_: rounds)
        before = set(os.listdir(folder))
        made = skip_gram.train(df, "text", 6, 3, 3, epochs, 7, 42)
        kept = [f for f in os.listdir(folder) if f not in before and f.startswith("table-")]
        found = [(r["word"], np.array(r["vector"])) for r in made.collect()]
        assert sorted(w for w, _ in found) == sorted(known) and len(kept) == 1
        assert all(v.shape == (6,) and np.isfinite(v).all() and v.any() for _, v in found)


@pytest.mark.parametrize("outer", [False, True])
def test_means_of_rounds_are_those_of_all_at_once(outer):
    rng, dim = np.random.default_rng(2), 5
    words = rng.choice([f"w{i}" for i in range(30)], 90)

    def rows(at):
        return pa.record_batch(
            {"feature": pa.array(words[at]), "n": pa.array([9] * len(at), pa.int64()), "weight": pa.array(at + 1),
             "inner": skip_gram._packed(vectors[at]), "outer": skip_gram._packed(-vectors[at]) if outer else pa.nulls(len(at), pa.binary())}
        )

    def means(batches, whole):
        table = pa.Table.from_batches(batches).sort_by("feature")
        return list(skip_gram._means(iter(table.to_batches(max_chunksize=7)), dim, whole))

    vectors = rng.normal(size=(90, dim)).astype(np.float32)
    at = np.arange(90)
    once = pa.Table.from_batches(means([rows(at)], True)).to_pydict()
    first = means([rows(at[:25])], False)
    again = pa.Table.from_batches(means([*means([*first, rows(at[25:60])], False), rows(at[60:])], True)).to_pydict()
    assert once["feature"] == again["feature"] and once["weight"] == again["weight"]
    for word, weight, got, same in zip(once["feature"], once["weight"], once["inner"], again["inner"]):
        which = np.flatnonzero(words == word)
        want = np.average(vectors[which], axis=0, weights=which + 1)
        assert weight == (which + 1).sum()
        assert np.abs(np.frombuffer(got, "<f4") - want).max() < 1e-6
        assert np.abs(np.frombuffer(same, "<f4") - want).max() < 1e-6
    assert outer == (once["outer"][0] is not None)


def test_rounds_cover_all_blocks_and_keep_tasks_busy():
    for parts in (1, 2, 7, 8, 9, 31, 32, 110, 1000):
        rounds = skip_gram._rounds(parts, 8)
        assert [b for low, high in rounds for b in range(low, high)] == list(range(parts))
        assert len(rounds) == 1 or min(high - low for low, high in rounds) >= 8
    assert len(skip_gram._rounds(110, 8)) == skip_gram.ROUNDS


def test_shuffle_files_go_and_the_setting_comes_back(spark):
    name, folder = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.sparkContext._jvm
    before = spark.conf.get(name)
    df = spark.createDataFrame([(f"a b c{i % 9} " * 9,) for i in range(50)], "text string").repartition(3)
    tracker = folder.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = set(map(int, str(tracker.shuffleStatuses().keys().mkString(" ")).split()))
    skip_gram.train(df, "text", 4, 2, 2, 1, 3, 42)
    assert spark.conf.get(name) == before
    left = set(map(int, str(tracker.shuffleStatuses().keys().mkString(" ")).split()))
    assert len(left - held) <= 1  # that of a size taken before
