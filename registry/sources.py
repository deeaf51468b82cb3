"""Readers, writers and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import (
    SQL_CHUNKS,
    SQL_CLASSED,
    SQL_SCORE,
    WS_UNICODE,
    classed,
    query,
    scored_documents,
    sql_scores,
    sql_strip,
    sql_tokens,
    table,
)
from textvariety.functions.text import labelled_line
from textvariety.operators.generate import sentence_chunks
from textvariety.operators.log_odds import LogOddsModel, score_positive, train_log_odds
from textvariety.operators.logistic import save_model
from textvariety.operators.metrics import class_counts
from textvariety.sources import experiments, sinks, tables
from textvariety.sources.scratch import scratch_path

SQL_LINE = (
    "CASE WHEN label = 0 THEN '__label__PT_PT' ELSE '__label__PT_BR' END || ' ' || "
    + sql_strip("replace(text, chr(10), ' ')", WS_UNICODE)
)


@query("read_table", "SELECT * FROM documents")
def _read_table(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/documents.parquet")


@query(
    "read_class_files",
    f"WITH {SQL_CLASSED} SELECT doc_id, text, label FROM classed WHERE label IN (0, 1)",
)
def _read_class_files(spark, sf_dir):
    root = scratch_path(spark, "classes")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs.write.partitionBy("lang").parquet(root)
    return tables.read_class_files(spark, {0: f"{root}/lang=es", 1: f"{root}/lang=fr"})


@query(
    "read_domains",
    "SELECT doc_id, lang, source AS domain, length(text) AS n FROM documents",
)
def _read_domains(spark, sf_dir):
    root = scratch_path(spark, "domains")
    docs = table(spark, sf_dir, "documents")
    docs.select("doc_id", "lang", "text", "source").write.partitionBy("source").parquet(root)
    names = sorted(r[0] for r in docs.select("source").distinct().collect())
    read = tables.read_domains(
        spark, root, names, folder="source={domain}", files="*.parquet"
    )
    return read.select("doc_id", "lang", "domain", F.length("text").cast("bigint").alias("n"))


@query(
    "read_shards",
    "SELECT lang, source, count(*) AS n_texts, sum(length(text))::BIGINT AS n_chars"
    " FROM documents GROUP BY ALL",
)
def _read_shards(spark, sf_dir):
    root = scratch_path(spark, "shards")
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source")
    docs.write.partitionBy("lang", "source").parquet(root)
    read = tables.read_shards(spark, [f"{root}/*/*/*.parquet"])
    part = lambda name: F.regexp_extract("shard", f"/{name}=([^/]+)/", 1)
    return read.groupBy(part("lang").alias("lang"), part("source").alias("source")).agg(
        F.count("*").alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    "parse_labelled_lines",
    f"""WITH {SQL_CLASSED}, parsed AS (
      SELECT doc_id, {sql_tokens(SQL_LINE)} AS t FROM classed)
    SELECT doc_id,
      array_to_string(list_filter(t, lambda x: starts_with(x, '__label__')), ' ') AS labels,
      array_to_string(list_filter(t, lambda x: NOT starts_with(x, '__label__')), ' ') AS words,
      len(t) - 1 AS n_words
    FROM parsed""",
)
def _parse_labelled_lines(spark, sf_dir):
    lines = classed(spark, sf_dir).select(
        "doc_id", labelled_line("text", "label").alias("line")
    )
    return tables.parse_labelled_lines(lines).select(
        "doc_id",
        F.array_join("labels", " ").alias("labels"),
        F.array_join("words", " ").alias("words"),
        F.size("words").cast("bigint").alias("n_words"),
    )


@query("write_table", f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_no, text FROM chunks")
def _write_table(spark, sf_dir):
    path = scratch_path(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sinks.write_table(sentence_chunks(docs), path)
    return tables.read_table(spark, path)


@query(
    "write_labelled_lines",
    f"""WITH {SQL_CLASSED}, lines AS (SELECT {SQL_LINE} AS line FROM classed)
    SELECT line, len({sql_tokens('line')}) - 1 AS n_words
    FROM lines WHERE length({sql_strip('line')}) > 20""",
)
def _write_labelled_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    lines = classed(spark, sf_dir).select(labelled_line("text", "label").alias("line"))
    sinks.write_labelled_lines(lines, path)
    return tables.read_labelled_lines(spark, path).select(
        "line", F.size("words").cast("bigint").alias("n_words")
    )


@query("model_round_trip", f"WITH {sql_scores()} SELECT * FROM scores")
def _model_round_trip(spark, sf_dir):
    docs = classed(spark, sf_dir)
    path = save_model(train_log_odds(docs), scratch_path(spark, "models"), "words")
    model = LogOddsModel.load(spark, path)
    return score_positive(docs, model, "doc_id").select("doc_id", "score")


@query(
    "record_experiment",
    f"""WITH {SQL_CLASSED}, n AS (SELECT label, count(*) AS n FROM classed GROUP BY label)
    SELECT 'class sizes' AS name, 'registry' AS script, 'class ' || label AS key,
      n::VARCHAR AS value FROM n""",
)
def _record_experiment(spark, sf_dir):
    path = scratch_path(spark, "experiments")
    sizes = class_counts(classed(spark, sf_dir)).collect()
    details = {f"class {r['label']}": r["n"] for r in sizes}
    experiments.record_experiment(spark, path, "class sizes", details, "registry")
    latest = experiments.read_experiments(spark, path)
    return latest.select("name", "script", F.explode("details").alias("key", "value"))


@query(
    "experiment_history",
    f"""WITH runs AS (
      SELECT lang AS name, TIMESTAMP '2026-01-01' + INTERVAL (min(doc_id)) MINUTE AS ts,
        floor(avg({SQL_SCORE}) * 1000 + 0.5) / 10 AS value
      FROM documents GROUP BY lang, source),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts) AS run,
        row_number() OVER (PARTITION BY name ORDER BY ts DESC) AS back,
        row_number() OVER (PARTITION BY name ORDER BY value DESC, ts) AS place
      FROM runs)
    SELECT name, run::INTEGER AS run, strftime(ts, '%Y-%m-%d %H:%M') AS ts, value,
      back = 1 AS is_latest, place = 1 AS is_best
    FROM ranked""",
)
def _experiment_history(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    scores = scored_documents(spark, sf_dir).join(docs, "doc_id")
    percent = (F.floor(F.avg("score") * 1000 + 0.5) / 10).cast("string")
    minutes = F.make_dt_interval(mins=F.min("doc_id").cast("int"))
    log = scores.groupBy("lang", "source").agg(
        (F.lit("2026-01-01").cast("timestamp_ntz") + minutes).alias("ts"),
        F.create_map(F.lit("mean"), F.concat(percent, F.lit("%"))).alias("details"),
    )
    runs = log.select(F.col("lang").alias("name"), "ts", F.col("source").alias("script"), "details")
    history = experiments.experiment_history(runs, "mean")
    return history.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm"))


# Shards per language the documents are written to, and the damaged one.
SHARDS_PER_LANG = 8


def _list_files(spark, folder: str) -> list[str]:
    """Parquet files directly in `folder` (one path per shard, not their rows)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(
        str(s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")
    )


def _damage(spark, path: str) -> None:
    """A file that looks like Parquet and cannot be read: a short, broken one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(b"PAR1 no footer follows PAR1"))
    out.close()


@query(
    "build_corpus",
    f"""WITH {SQL_CHUNKS}
    SELECT lang, count(*) AS chunks, sum(length(text))::BIGINT AS chars,
      (lang = (SELECT min(lang) FROM documents))::INTEGER AS failed
    FROM chunks WHERE lang IS NOT NULL GROUP BY lang""",
)
def _build_corpus(spark, sf_dir):
    """All documents as shards of their language, one damaged file beside the
    first language's; the corpus built in one scan with its manifest."""
    from textvariety.plans.corpus import build_corpus_once

    root = scratch_path(spark, "shards")
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isNotNull())
    # A task writes one file per language, so names differ within a language.
    docs.select("lang", "source", "text").repartition(
        SHARDS_PER_LANG * 4, "lang", "source"
    ).write.partitionBy("lang").parquet(root)
    langs = [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    shards = {lang: _list_files(spark, f"{root}/lang={lang}") for lang in langs}
    _damage(spark, f"{root}/lang={langs[0]}/damaged.parquet")
    shards[langs[0]].append(f"{root}/lang={langs[0]}/damaged.parquet")
    out = scratch_path(spark, "corpus")
    built = build_corpus_once(spark, shards, out)
    parts = [
        spark.read.parquet(f"{out}/{lang}_split").select(
            F.lit(lang).alias("lang"), F.length("text").alias("n")
        )
        for lang in langs
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    failed = spark.createDataFrame(
        [(lang, len(b.failed)) for lang, b in built.items()], "lang string, failed int"
    )
    sums = every.groupBy("lang").agg(
        F.count("*").alias("chunks"), F.sum("n").cast("long").alias("chars")
    )
    return sums.join(failed, "lang").select("lang", "chunks", "chars", "failed")
