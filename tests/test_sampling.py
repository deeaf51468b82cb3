"""Shuffles, samples, splits and caps."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textvariety.operators import sampling
from textvariety.operators.ordering import running_totals


def order(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key


def labelled(spark, sizes, parts=3):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id int, label int").repartition(parts)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11])
def test_split_truncates_and_is_exact(spark, n):
    df = labelled(spark, {0: n, 1: 20, 2: 5, None: 3})
    got = sampling.stratified_split(df, 0.1, "id").collect()
    assert len(got) == n + 20
    test0 = sorted(r["id"] for r in got if r["label"] == 0 and r["split"] == "test")
    assert test0 == sorted(sorted(range(n), key=order)[: int(n * 0.1)])


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_samples_do_not_depend_on_partitions(spark, parts):
    df = labelled(spark, {0: 100, 1: 40}, parts)
    want = sorted(sorted(range(100), key=order)[:7] + sorted(range(100, 140), key=order)[:7])
    assert ids(sampling.sample_per_class(df, 7, "id")) == want
    position = sampling.shuffle(df, "id", position=True).orderBy("position").collect()
    assert [r["id"] for r in position] == sorted(range(140), key=order)
    assert [r["position"] for r in position] == list(range(1, 141))


@pytest.mark.parametrize(
    ("sizes", "cap", "size"),
    [({0: 9, 1: 4}, None, 4), ({0: 9, 1: 4}, 3, 3), ({0: 9}, None, 0), ({0: 9, 1: 4, 2: 1, None: 2}, 99, 4)],
)
def test_balance(spark, sizes, cap, size):
    got = sampling.balance(labelled(spark, sizes), "id", cap)
    counts = dict(map(tuple, got.groupBy("label").count().collect()))
    assert counts == ({0: size, 1: size} if size else {})


def test_sample_larger_than_the_table(spark):
    df = labelled(spark, {0: 5})
    assert ids(sampling.sample_n(df, "id", 25)) == list(range(5))
    assert ids(sampling.sample_per_class(df, 25, "id")) == list(range(5))


def test_large_samples_take_the_cut_path(spark, monkeypatch):
    df = labelled(spark, {0: 60})
    want = ids(sampling.sample_n(df, "id", 17))
    monkeypatch.setattr(sampling, "TOP_N_LIMIT", 5)
    assert ids(sampling.sample_n(df, "id", 17)) == want == sorted(sorted(range(60), key=order)[:17])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 30), min_size=1),
    st.integers(1, 60),
)
def test_cap_rows_fills_shards_in_order(spark, sizes, target):
    rows = [("pt", s, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, shard string, id string").repartition(4)
    want = []
    for shard in sorted(sizes, key=order):
        inside = sorted((f"{shard}{i}" for i in range(sizes[shard])), key=order)
        want += inside[: target - len(want)]
    assert ids(sampling.cap_rows(df, target, "id")) == sorted(want)


def test_one_shard_may_hold_most_rows(spark):
    rows = [("pt", "big" if i % 10 else f"s{i}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "lang string, shard string, id int")
    assert sampling.cap_rows(df, 700, "id").count() == 700


def test_running_totals_with_clustered_values(spark):
    # Most distinct values lie within a millionth of each other.
    values = [0.5 + i * 1e-9 for i in range(900)] + [i / 100 for i in range(50)]
    df = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "s double, n int")
    merged = df.groupBy("s").agg(F.sum("n").alias("n"))
    got = {r["s"]: r["cum_n"] for r in running_totals(merged, "s", ["n"]).collect()}
    total, want = 0, {}
    for s, n in sorted(((r["s"], r["n"]) for r in merged.collect()), reverse=True):
        total += n
        want[s] = total
    assert got == want


def test_union_all_matches_by_name_and_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("x", 1)], "s string, i int")
    assert sampling.union_all(a, b, a).count() == 3


def test_wide_rows_are_not_shuffled_by_a_split(spark):
    df = spark.range(100).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("label"), F.lit("t").alias("text")
    )
    df.write.mode("overwrite").parquet(path := sampling_path(spark))
    split = sampling.stratified_split(spark.read.parquet(path), 0.1, "id")
    plan = split._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("text" in line.split("ReadSchema")[1] for line in scans) == 1


def sampling_path(spark):
    from textvariety.sources.scratch import scratch_path

    return scratch_path(spark, "rows")


def test_columns_named_like_intermediates(spark):
    rows = [(i, i % 2, "x", "y") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label int, cut string, selected string")
    out = sampling.stratified_split(df, 0.2, "id")
    assert out.filter("split = 'test'").count() == 8
    assert {"cut", "selected"} <= set(out.columns)
