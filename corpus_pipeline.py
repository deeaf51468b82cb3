"""From raw documents to token ids: five operators, one after another.

Each stage works on all that its predecessor kept. All but the last return the
columns of `documents`; columns beside those are left out at the start.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from textvariety.llm import bpe, mixing, near_dedup, pii, quality  # noqa: E402
from textvariety.llm.common import DOCUMENT, pick, table  # noqa: E402
from textvariety.sources.scratch import Tables  # noqa: E402

# A learned classifier and a lottery have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by `labels`, lets pass."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model, *DOCUMENT)
    return scored.filter("predicted = 1").select(*DOCUMENT)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest id."""
    return near_dedup.drop_near_duplicates(pick(docs, *DOCUMENT))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind."""
    masked = pii.mask_pii(docs, pii.train_skip_chain(docs), *DOCUMENT)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of documents that the mix draws, a row each, as often as drawn."""
    made = mixing.mix(docs, keep=("text", "lang"))
    texts = mixing.mixed_texts(made).withColumnRenamed("kept_lang", "lang")
    return texts.withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENT)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of every row."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, "doc_id", "lang", "source")
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        "decoded_sha256",
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup_stage),
    ("personal_data", mask_personal_data),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every one but the last is stored, and what it
    was made from deleted then."""
    docs, before = table(spark, sf_dir, "documents"), Tables()
    for _, stage in STAGES[:-1]:
        made = Tables()
        docs = made.store(stage(spark, docs, sf_dir))
        before.discard()
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
