"""Build a corpus of sentence chunks from raw shards."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvariety.functions.hashing import SEED
from textvariety.operators.generate import chunk_array, sentence_chunks
from textvariety.operators.sampling import cap_by_plan
from textvariety.sources.scratch import broadcast_if_small
from textvariety.sources.sinks import Throughput, write_table
from textvariety.sources.tables import failed_shards, read_shards

# Fixed value: chunks of a finished corpus.
TARGET_ROWS = 6_000_000
FIRST_WAVE = 8


@dataclass(frozen=True)
class Built(Throughput):
    """What was written, and the files that could not be read to their end."""

    failed: tuple[str, ...] = ()


def chunk_shards(spark: SparkSession, lang: str, paths: Sequence[str]) -> DataFrame:
    """(lang, shard, row_no, chunk_no, text): chunks of the listed whole files."""
    name = F.element_at(F.split("shard", "/"), -1)
    raw = read_shards(spark, paths, whole=True).select(
        F.lit(lang).alias("lang"), name.alias("shard"), "row_no", "text"
    )
    return sentence_chunks(raw)


def visit_order(paths: Sequence[str], seed: int = SEED) -> list[str]:
    """Shard files in seeded hash order of their names."""
    names = [PurePosixPath(p).name for p in paths]
    if len(set(names)) != len(names):
        raise ValueError("shard file names of a language must differ")

    def order(path: str) -> tuple[str, str]:
        name = PurePosixPath(path).name
        return hashlib.md5(f"{seed}:{name}".encode()).hexdigest(), name

    return sorted(paths, key=order)


def plan_shards(
    spark: SparkSession,
    lang: str,
    paths: Sequence[str],
    target: int,
    seed: int = SEED,
) -> tuple[list[str], list[tuple[str, str, int, int]], list[str]]:
    """Files to read, their (lang, shard, rows, room), and the files that failed.

    Shards are counted in waves of doubling size, so a corpus far larger than
    the target is never read beyond about twice what is needed. Per wave, the
    driver sees one count per file. Files without a usable chunk take no part.
    """
    ordered = visit_order(paths, seed)
    visited: list[str] = []
    failed: list[str] = []
    plan: list[tuple[str, str, int, int]] = []
    room, wave = target, FIRST_WAVE
    while room > 0 and len(visited) < len(ordered):
        files = ordered[len(visited) : len(visited) + wave]
        bad = failed_shards(spark, files)
        failed += bad
        good = [p for p in files if p not in set(bad)]
        rows = {}
        if good:
            counts = chunk_shards(spark, lang, good).groupBy("shard").count().collect()
            rows = {r["shard"]: r["count"] for r in counts}
        for path in files:
            name = PurePosixPath(path).name
            if name in rows and room > 0:
                plan.append((lang, name, rows[name], room))
                room -= rows[name]
        visited += files
        wave *= 2
    names = {name for _, name, *_ in plan}
    return [p for p in visited if PurePosixPath(p).name in names], plan, failed


def build_corpus(
    spark: SparkSession,
    shards: Mapping[str, Sequence[str]],
    out: str,
    target: int = TARGET_ROWS,
    seed: int = SEED,
) -> dict[str, Built]:
    """Write `<out>/<lang>_split` with exactly `target` chunks per language.

    Fewer chunks than the target are all kept. A file that cannot be read to its
    end gives nothing and is listed as failed, if it was visited at all.
    """
    done = {}
    for lang, paths in shards.items():
        files, rows, failed = plan_shards(spark, lang, paths, target, seed)
        if not files:
            raise ValueError(f"no usable shard for {lang}")
        schema = "lang string, shard string, rows bigint, room bigint"
        plan = broadcast_if_small(spark.createDataFrame(rows, schema))
        chunks = chunk_shards(spark, lang, files)
        kept = cap_by_plan(chunks, plan, ["row_no", "chunk_no"], seed=seed)
        seen = write_table(kept.select("text"), f"{out.rstrip('/')}/{lang}_split")
        done[lang] = Built(seen.rows, seen.seconds, tuple(failed))
    return done


# --- One scan of each shard, committed by a manifest ---

WAVES = "_waves"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _wave(spark: SparkSession, files: Sequence[str], data: str, manifest: str) -> list:
    """Write the chunks of `files` in one scan, then their manifest; the rows of
    the manifest: (shard, promised, read, chunks)."""
    reader = (
        spark.read.schema("text string")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    raw = reader.parquet(*files).select(
        name.alias("shard"), F.col("_metadata.row_index").alias("row_no"), "text"
    )
    # A row without chunks leaves one marker row, so rows read are counted later
    # from the written table instead of from the texts.
    chunks = raw.select(
        "shard", "row_no", F.explode_outer(chunk_array("text")).alias("c")
    ).select("shard", "row_no", "c.chunk_no", "c.text")
    chunks.write.mode("overwrite").parquet(data)
    written = spark.read.parquet(data)
    read = written.groupBy("shard").agg(
        F.count_distinct("row_no").alias("read"), F.count("chunk_no").alias("chunks")
    )
    # Row counts of the files' footers; a file without a readable footer has none.
    promised = reader.parquet(*files).groupBy(name.alias("shard")).agg(
        F.count("*").alias("promised")
    )
    listed = spark.createDataFrame([(PurePosixPath(f).name,) for f in files], "shard string")
    rows = listed.join(promised, "shard", "left").join(read, "shard", "left").select(
        "shard",
        F.coalesce("promised", F.lit(0)).alias("promised"),
        F.coalesce("read", F.lit(0)).alias("read"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
    )
    rows.coalesce(1).write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest).collect()


def build_corpus_once(
    spark: SparkSession,
    shards: Mapping[str, Sequence[str]],
    out: str,
    target: int = TARGET_ROWS,
    seed: int = SEED,
    stop_after: int | None = None,
) -> dict[str, Built]:
    """Write `<out>/<lang>_split` with exactly `target` chunks per language,
    reading every visited shard once.

    Shards are visited in seeded hash order, in waves of doubling size. A wave
    writes the chunks of its shards below `<out>/_waves/<lang>` in one scan and
    then its manifest: rows promised by each file's footer, rows read and
    chunks. Only shards read to their end count; the others are listed as
    failed. A wave whose manifest is there is not read again, so a build that
    stopped goes on where it was (`stop_after` waves stops one on purpose, for
    tests). Whole shards are kept in visiting order until the target is met;
    of the one that crosses it, the chunks first in hash order of (row_no,
    chunk_no), read from the stored wave, not from the shard. The same rows as
    `build_corpus`.
    """
    done = {}
    for lang, paths in shards.items():
        ordered = visit_order(paths, seed)
        root = f"{out.rstrip('/')}/{WAVES}/{lang}"
        plan: list[tuple[str, str, int, int]] = []
        failed: list[str] = []
        waves: list[str] = []
        room, start, size, k = target, 0, FIRST_WAVE, 0
        while room > 0 and start < len(ordered):
            files = ordered[start : start + size]
            data, manifest = f"{root}/wave-{k}", f"{root}/manifest-{k}"
            if _exists(spark, f"{manifest}/_SUCCESS"):
                rows = spark.read.parquet(manifest).collect()
            else:
                if stop_after is not None and k >= stop_after:
                    raise InterruptedError(f"stopped before wave {k}")
                rows = _wave(spark, files, data, manifest)
            counts = {r["shard"]: r for r in rows}
            for path in files:
                r = counts[PurePosixPath(path).name]
                if r["promised"] == 0 or r["read"] < r["promised"]:
                    failed.append(path)
                elif r["chunks"] > 0 and room > 0:
                    plan.append((lang, r["shard"], r["chunks"], room))
                    room -= r["chunks"]
            waves.append(data)
            start, size, k = start + size, size * 2, k + 1
        if not plan:
            raise ValueError(f"no usable shard for {lang}")
        schema = "lang string, shard string, rows bigint, room bigint"
        rooms = broadcast_if_small(spark.createDataFrame(plan, schema))
        stored = spark.read.parquet(*waves).filter(F.col("chunk_no").isNotNull())
        chunks = stored.select(F.lit(lang).alias("lang"), "shard", "row_no", "chunk_no", "text")
        kept = cap_by_plan(chunks, rooms, ["row_no", "chunk_no"], seed=seed)
        seen = write_table(kept.select("text"), f"{out.rstrip('/')}/{lang}_split")
        done[lang] = Built(seen.rows, seen.seconds, tuple(failed))
    return done
