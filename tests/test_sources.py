"""Readers, writers, the run log and the corpus build."""

import hashlib
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textvariety.plans.corpus import build_corpus, plan_shards
from textvariety.sources import experiments, scratch, sinks, tables


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))


def single_file(spark, target: Path, texts):
    """A Parquet file of a given name."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    target.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"text": pa.array(texts, pa.string())}), target)


def test_class_files(spark, tmp_path):
    write(spark, tmp_path / "pt", [("a",)], "text string")
    write(spark, tmp_path / "br", [("b",), ("a",)], "text string")
    got = tables.read_class_files(spark, {0: f"{tmp_path}/pt", 1: f"{tmp_path}/br"})
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("a", 1), ("b", 1)]


def test_domains_read_one_split_each(spark, tmp_path):
    for domain in ("web", "social media"):
        for split in ("train-0", "train-1", "valid-0"):
            single_file(spark, tmp_path / domain / f"{split}.parquet", [f"{domain} {split}"])
    names = ["web", "social media"]
    got = tables.read_domains(spark, str(tmp_path), names)
    assert {(r["domain"], r["text"]) for r in got.collect()} == {
        (d, f"{d} train-{i}") for d in names for i in range(2)
    }
    valid = tables.read_domains(spark, str(tmp_path), names, "valid", column=None)
    assert valid.columns == ["text"] and valid.count() == 2


def test_bad_shards_are_counted(spark, tmp_path):
    single_file(spark, tmp_path / "pt_1.parquet", ["one", None])
    single_file(spark, tmp_path / "pt_2.parquet", ["two"])
    good = (tmp_path / "pt_2.parquet").read_bytes()
    (tmp_path / "pt_3.parquet").write_bytes(good[: len(good) // 2])
    paths = [f"{tmp_path}/pt_{i}.parquet" for i in (1, 2, 3)]
    shards = tables.read_shards(spark, paths)
    assert sorted(r["text"] for r in shards.collect()) == ["one", "two"]
    assert tuple(tables.count_skipped(spark, paths).first()) == (3, 2, 1)
    assert tables.failed_shards(spark, paths) == paths[2:]
    with pytest.raises(Exception):  # noqa: B017
        tables.read_shards(spark, paths, tolerate_bad=False).collect()


def test_half_readable_shards_are_left_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = pa.table({"text": [f"text number {i} with words" for i in range(20_000)]})
    paths = [f"{tmp_path}/pt_{i}.parquet" for i in (1, 2, 3)]
    for path in paths[:2]:
        pq.write_table(texts, path, row_group_size=4_000, use_dictionary=False)
    pq.write_table(pa.table({"text": pa.array([None, None], pa.string())}), paths[2])
    group = pq.ParquetFile(paths[0]).metadata.row_group(3).column(0)
    raw = bytearray(Path(paths[0]).read_bytes())
    start = group.data_page_offset
    raw[start : start + group.total_compressed_size] = b"\xff" * group.total_compressed_size
    Path(paths[0]).write_bytes(bytes(raw))
    shards = tables.read_shards(spark, paths)
    assert shards.count() == 20_000
    assert shards.select("shard").distinct().count() == 1
    assert tables.failed_shards(spark, paths) == paths[:1]
    # A readable shard of nulls is no failure.
    assert tuple(tables.count_skipped(spark, paths).first()) == (3, 2, 1)


def test_labelled_lines_round_trip(spark, tmp_path):
    rows = [("__label__PT_PT a longer line é",), ("__label__PT_BR xxxxx",), (None,)]
    df = spark.createDataFrame(rows, "line string")
    assert sinks.write_labelled_lines(df, f"{tmp_path}/lines") == 1
    got = tables.read_labelled_lines(spark, f"{tmp_path}/lines").first()
    assert got["words"] == ["a", "longer", "line", "é"]
    assert got["labels"] == ["__label__PT_PT"]


def test_write_table_replaces_and_counts(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.write_table(spark.range(5), path).rows == 5
    assert sinks.write_table(spark.range(3), path).rows == 3
    assert spark.read.parquet(path).count() == 3


def test_experiments_append(spark, tmp_path):
    path = f"{tmp_path}/log"
    days = [datetime(2026, 3, d, 16, 41, 30) for d in (4, 5, 6)]
    for day, value in zip(days, ["88.4%", "89.0%", "89.0%"]):
        details = {"F1": value, "epoch": 5}
        experiments.record_experiment(spark, path, "best", details, now=day)
    log = experiments.read_experiments(spark, path)
    first = log.orderBy("ts").first()
    assert first["script"] == "test_sources.py"
    assert first["ts"] == datetime(2026, 3, 4, 16, 41)
    keys = log.select(F.map_keys("details")).first()[0]
    assert keys == ["F1", "epoch"] and first["details"]["epoch"] == "5"
    got = experiments.experiment_history(log, "F1").orderBy("run").collect()
    assert [(r["value"], r["is_latest"], r["is_best"]) for r in got] == [
        (88.4, False, False), (89.0, False, True), (89.0, True, False)
    ]
    missing = experiments.experiment_history(log, "other").collect()
    assert not any(r["is_best"] for r in missing)


def test_runs_within_a_minute_keep_their_order(spark, tmp_path):
    path = f"{tmp_path}/log"
    for second, value in ((50, "3"), (10, "1"), (30, "2")):
        now = datetime(2026, 3, 4, 16, 41, second)
        experiments.record_experiment(spark, path, "run", {"F1": value}, "s", now=now)
    log = experiments.read_experiments(spark, path)
    assert experiments.latest_runs(log).first()["details"]["F1"] == "3"
    history = experiments.experiment_history(log, "F1").orderBy("run").collect()
    assert [r["value"] for r in history] == [1.0, 2.0, 3.0]


def order(name):
    return hashlib.md5(f"42:{name}".encode()).hexdigest()


def test_corpus_is_exact_and_stops_early(spark, tmp_path):
    text = "This is sentence number one. And two! And three? Four. Five is here too now."
    paths = []
    for i in range(30):
        paths.append(f"{tmp_path}/pt/pt_{i}.parquet")
        single_file(spark, Path(paths[-1]), [f"{i}.{j} {text}" for j in range(5)] + [None, ""])
    Path(paths[0]).write_bytes(b"not parquet")
    # "i.j This is … Four." is one chunk, "Five is here too now." another.
    per_shard = 10
    files, plan, _ = plan_shards(spark, "pt", paths, 3 * per_shard + 2)
    good = sorted((Path(p).name for p in paths[1:]), key=order)
    assert [name for _, name, *_ in plan] == good[:4]
    assert sorted(Path(p).name for p in files) == sorted(good[:4])
    done = build_corpus(spark, {"pt": paths}, f"{tmp_path}/out", 3 * per_shard + 2)
    assert done["pt"].rows == 3 * per_shard + 2
    got = spark.read.parquet(f"{tmp_path}/out/pt_split")
    assert got.columns == ["text"] and got.count() == 3 * per_shard + 2
    assert got.filter(F.length("text") <= 20).count() == 0
    everything = build_corpus(spark, {"pt": paths}, f"{tmp_path}/all", 10**6)
    assert everything["pt"].rows == 29 * per_shard
    assert everything["pt"].failed == (paths[0],)


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:1"

        def getCheckpointDir(self):
            return None

    class Conf:
        value = None

        def get(self, name, default):
            return self.value

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())
    Conf.value = "hdfs://shared/tmp"
    assert scratch.scratch_path(Session(), "x").startswith("hdfs://shared/tmp/x-")


def test_corpus_in_one_scan_equals_the_plan_and_resumes(spark, tmp_path):
    from textvariety.plans.corpus import build_corpus_once

    text = "This is sentence number one. And two! And three? Four. Five is here too now."
    paths = []
    for i in range(30):
        paths.append(f"{tmp_path}/pt/pt_{i}.parquet")
        single_file(spark, Path(paths[-1]), [f"{i}.{j} {text}" for j in range(5)] + [None, ""])
    Path(paths[0]).write_bytes(b"not parquet")
    target = 3 * 10 + 2
    before = build_corpus(spark, {"pt": paths}, f"{tmp_path}/old", target)
    with pytest.raises(InterruptedError):
        build_corpus_once(spark, {"pt": paths}, f"{tmp_path}/new", 10**6, stop_after=2)
    first = Path(f"{tmp_path}/new/_waves/pt/manifest-0/_SUCCESS").stat().st_mtime_ns
    again = build_corpus_once(spark, {"pt": paths}, f"{tmp_path}/new", 10**6)
    # Waves committed before the stop are not read again.
    assert Path(f"{tmp_path}/new/_waves/pt/manifest-0/_SUCCESS").stat().st_mtime_ns == first
    clean = build_corpus_once(spark, {"pt": paths}, f"{tmp_path}/clean", 10**6)
    rows = lambda p: sorted(r["text"] for r in spark.read.parquet(p).collect())
    assert rows(f"{tmp_path}/new/pt_split") == rows(f"{tmp_path}/clean/pt_split")
    assert again["pt"].rows == clean["pt"].rows == 29 * 10
    assert again["pt"].failed == clean["pt"].failed == (paths[0],)
    cut = build_corpus_once(spark, {"pt": paths}, f"{tmp_path}/cut", target)
    assert cut["pt"].rows == before["pt"].rows == target
    assert rows(f"{tmp_path}/cut/pt_split") == rows(f"{tmp_path}/old/pt_split")
