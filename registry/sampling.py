"""Shuffles, samples, splits, caps and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import SQL_CHUNKS, SQL_CLASSED, classed, query, table
from textvariety.operators import sampling
from textvariety.operators.generate import sentence_chunks

ORDER = "md5('42:' || doc_id), doc_id"
SQL_RANKED = f"""{SQL_CLASSED}, ranked AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {ORDER}) AS r,
    count(*) OVER (PARTITION BY label) AS size
  FROM classed WHERE label IN (0, 1))"""
PER_CLASS = 25
BALANCE_CAP = 60
CHUNK_TARGET = 400


@query(
    "shuffle",
    f"""SELECT doc_id, source, row_number() OVER (ORDER BY {ORDER}) AS position
    FROM documents""",
)
def _shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.shuffle(docs, "doc_id", position=True)


@query(
    "sample_per_class",
    f"WITH {SQL_RANKED} SELECT doc_id, label FROM ranked WHERE r <= {PER_CLASS}",
)
def _sample_per_class(spark, sf_dir):
    rows = sampling.sample_per_class(classed(spark, sf_dir), PER_CLASS, "doc_id")
    return rows.select("doc_id", "label")


@query(
    "balance",
    f"""WITH {SQL_RANKED} SELECT doc_id, text, label FROM ranked JOIN classed USING (doc_id, label)
    WHERE r <= (SELECT min(size) FROM ranked)""",
)
def _balance(spark, sf_dir):
    rows = classed(spark, sf_dir).select("doc_id", "text", "label")
    return sampling.balance(rows, "doc_id")


@query(
    "balance_capped",
    f"""WITH {SQL_RANKED} SELECT doc_id, label FROM ranked
    WHERE r <= least({BALANCE_CAP}, (SELECT min(size) FROM ranked))""",
)
def _balance_capped(spark, sf_dir):
    rows = classed(spark, sf_dir).select("doc_id", "label")
    return sampling.balance(rows, "doc_id", cap=BALANCE_CAP)


def sql_split(fraction: float) -> str:
    return f"""WITH {SQL_RANKED} SELECT doc_id, label,
      CASE WHEN r <= floor(size * {fraction}::DOUBLE) THEN 'test' ELSE 'train' END AS split
    FROM ranked"""


@query("stratified_split_tenth", sql_split(0.1))
def _stratified_split_tenth(spark, sf_dir):
    rows = sampling.stratified_split(classed(spark, sf_dir), 0.1, "doc_id")
    return rows.select("doc_id", "label", "split")


@query("stratified_split_fifth", sql_split(0.2))
def _stratified_split_fifth(spark, sf_dir):
    rows = sampling.stratified_split(classed(spark, sf_dir), 0.2, "doc_id")
    return rows.select("doc_id", "label", "split")


@query(
    "sample_n",
    f"SELECT page_id, url FROM pages ORDER BY {ORDER.replace('doc_id', 'page_id')} LIMIT 25",
)
def _sample_n(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return sampling.sample_n(pages, "page_id")


@query(
    "cap_rows",
    f"""WITH {SQL_CHUNKS}, sizes AS (
      SELECT lang, shard, count(*) AS n FROM chunks GROUP BY lang, shard),
    visits AS (
      SELECT lang, shard, n, sum(n) OVER (
        PARTITION BY lang ORDER BY md5('42:' || shard), shard) - n AS start FROM sizes),
    ranked AS (
      SELECT doc_id, chunk_no, c.lang, c.shard, text, start + row_number() OVER (
        PARTITION BY c.lang, c.shard
        ORDER BY md5('42:' || doc_id || ':' || chunk_no), doc_id, chunk_no) AS place
      FROM chunks c JOIN visits v ON c.lang = v.lang AND c.shard = v.shard)
    SELECT doc_id, chunk_no, lang, shard, text FROM ranked WHERE place <= {CHUNK_TARGET}""",
)
def _cap_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = sentence_chunks(
        docs.select("doc_id", "lang", F.col("source").alias("shard"), "text")
    )
    return sampling.cap_rows(chunks, CHUNK_TARGET, ["doc_id", "chunk_no"])


@query(
    "union_all",
    """SELECT doc_id AS id, text FROM documents
    UNION ALL SELECT item_id, text FROM benchmark
    UNION ALL SELECT conv_id, text FROM conversations""",
)
def _union_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("id"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text")
    return sampling.union_all(docs, items, turns)
