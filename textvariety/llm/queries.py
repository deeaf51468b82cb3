"""The operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvariety.llm import (
    bpe,
    chat,
    collocations,
    fingerprints,
    mixing,
    near_dedup,
    neighbours,
    pieces,
    pii,
    quality,
    secrets,
    token_files,
    variants,
)
from textvariety.llm.common import table
from textvariety.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(mixing.mix(table(spark, sf_dir, "documents")))


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.train_random_strings(
        secrets.random_strings(spark), secrets.ordinary_strings(docs)
    )
    return secrets.secrets_report(secrets.find_secrets(docs, model))


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pii_report(pii.find_pii(docs, pii.train_skip_chain(docs)))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model)


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length('<s>[INST][/INST]</s>') + length(r) + length(t)
    + len(regexp_extract_all(r, '(\[/?|</?)(\\*)(INST\]|s>)'))
    + len(regexp_extract_all(t, '(\[/?|</?)(\\*)(INST\]|s>)')) AS size FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), ''))
    AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op6_chat_examples", CHAT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    every = rows.select("conv_id", "turn", "role", "text").unionByName(control)
    return chat.read_back(chat.format_examples(every))


@query("op10_syncmer_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


NEAR_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3
    THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1),
      lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
found AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN sizes USING (doc_id)
"""


@query("op8_near_dedup", NEAR_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_dedup.dedup_report(near_dedup.near_duplicates(docs))


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, "doc_id"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer, path)
    return token_files.token_report(token_files.read_tokens(spark, path))


@query("op5_hilbert_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


COLLOCATION_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
cut AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
pieces AS (
  SELECT lang, ws FROM (SELECT lang,
    list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM cut)
  WHERE len(ws) > 0),
lengths AS (SELECT unnest(range(1, 6)) AS len_),
grams AS (
  SELECT lang, len_, unnest(list_transform(range(1, len(ws) - len_ + 2),
    lambda i: array_to_string(ws[i:i + len_ - 1], ' '))) AS phrase
  FROM pieces, lengths),
counts AS (SELECT lang, len_, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
cand AS (SELECT lang, len_, phrase, f AS a FROM counts WHERE len_ >= 2 AND f >= 100),
ks AS (SELECT unnest(range(1, 5)) AS k),
cuts AS (
  SELECT c.*, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp
  FROM cand c, ks WHERE k < len_),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.len_, a, k, l.f AS l, r.f AS r, n,
    (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN counts l ON l.lang = cuts.lang AND l.phrase = lp
  JOIN counts r ON r.lang = cuts.lang AND r.phrase = rp JOIN totals t ON t.lang = cuts.lang),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM cand q WHERE q.lang = b.lang AND q.len_ > b.len_ AND q.a >= b.a
      AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT
    AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB has no crc32; tests/llm/test_variants.py holds a brute force."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_sentencepiece")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tests/llm/test_pieces.py compares with the library on every text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), model, "doc_id"))
