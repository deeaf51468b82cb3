"""Registration, the stand-in inputs and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without `sql` only its rows are checked."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Stand-ins: Spark ---


def class_of_lang() -> Column:
    """es is class 0, fr is class 1, other languages a third label."""
    lang = F.col("lang")
    return F.when(lang == "es", 0).when(lang == "fr", 1).otherwise(2)


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, source, label) of all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "source", class_of_lang().alias("label"))


def two_digits(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def vowel_score(text: Column | str = "text") -> Column:
    """A score before any model exists: twice the share of vowels, at most 1."""
    text = F.col(text) if isinstance(text, str) else text
    vowels = F.length(text) - F.length(F.translate(text, "aeiou", ""))
    share = F.try_divide(vowels * 2.0, F.length(text))
    return two_digits(F.least(F.lit(1.0), share))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, score) of all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", vowel_score().alias("score"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dataset, label, score): labelled documents, a data set per language."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("dataset"), vowel_score().alias("score")
    )
    truth = labels.select("doc_id", (1 - F.col("quality")).alias("label"))
    return docs.join(truth, "doc_id").select("doc_id", "dataset", "label", "score")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models: the score cut at 0.5, 0.6 and 0.7."""
    models = F.array(
        *(
            F.struct(F.lit(f"cut_{t}").alias("model"), F.lit(t).alias("cutoff"))
            for t in (0.5, 0.6, 0.7)
        )
    )
    said = F.when(F.col("score") >= F.col("cutoff"), 0).otherwise(1)
    return (
        judged(spark, sf_dir)
        .select("*", F.inline(models))
        .select("model", "dataset", "doc_id", "label", said.alias("pred"))
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- Stand-ins: SQL ---

WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
WS_UNICODE = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
BLANK = r"[ \t\n\x0B\f\r]+"


def sql_strip(x: str, ws: str = WS) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{ws}+', ''), '{ws}+$', '')"


def sql_tokens(x: str) -> str:
    parts = f"string_split_regex(replace({x}, chr(10), ' '), '{BLANK}')"
    return f"list_filter({parts}, lambda t: t <> '')"


def sql_md5_bucket(x: str, bucket: int) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT % {bucket})"


SQL_VOWELS = (
    "least(1.0::DOUBLE, 2.0::DOUBLE * length(regexp_replace(text, '[^aeiou]', '', 'g'))"
    " / length(text))"
)
SQL_SCORE = f"(floor({SQL_VOWELS} * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE)"
SQL_CLASSED = (
    "classed AS (SELECT doc_id, text, source,"
    " CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS label FROM documents)"
)
SQL_JUDGED = (
    "judged AS (SELECT d.doc_id, d.lang AS dataset, 1 - l.quality AS label,"
    f" {SQL_SCORE} AS score FROM documents d JOIN labels l USING (doc_id))"
)
SQL_PREDICTIONS = (
    SQL_JUDGED + ", predictions AS (SELECT 'cut_' || t AS model, dataset, doc_id, label,"
    " CASE WHEN score >= t::DOUBLE THEN 0 ELSE 1 END AS pred"
    " FROM judged, (VALUES ('0.5'), ('0.6'), ('0.7')) m(t))"
)
SQL_CHUNKS = f"""
sentences AS (
  SELECT doc_id, lang, source AS shard,
    string_split(regexp_replace({sql_strip('text')}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS s
  FROM documents),
groups AS (
  SELECT doc_id, lang, shard, s, unnest(range(0, (len(s) + 3) // 4)) AS g FROM sentences),
every_chunk AS (
  SELECT doc_id, lang, shard, g::INTEGER AS chunk_no,
    {sql_strip("array_to_string(s[g * 4 + 1 : g * 4 + 4], ' ')")} AS text
  FROM groups),
chunks AS (SELECT * FROM every_chunk WHERE length(text) > 20)
"""
SQL_WEIGHTS = (
    SQL_CLASSED
    + f""",
train_tokens AS (
  SELECT label, unnest({sql_tokens('text')}) AS feature FROM classed WHERE label IN (0, 1)),
counts AS (
  SELECT feature, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
  FROM train_tokens GROUP BY feature HAVING count(*) >= 2),
totals AS (SELECT sum(n0)::DOUBLE AS s0, sum(n1)::DOUBLE AS s1, count(*) AS v FROM counts),
weights AS (
  SELECT feature, n0, n1, ln((n0 + 1) / (s0 + v)) - ln((n1 + 1) / (s1 + v)) AS weight
  FROM counts, totals)
"""
)


def sql_scores(weights: str = "weights") -> str:
    return (
        SQL_WEIGHTS
        + f""",
used AS (SELECT feature, weight FROM {weights}),
prior AS (
  SELECT ln(count(*) FILTER (label = 0) / count(*) FILTER (label = 1)) AS p FROM classed),
doc_tokens AS (SELECT doc_id, unnest({sql_tokens('text')}) AS feature FROM documents),
means AS (
  SELECT doc_id, sum(weight) / count(*) AS m FROM doc_tokens JOIN used USING (feature)
  GROUP BY doc_id),
scores AS (
  SELECT d.doc_id, coalesce(round(1 / (1 + exp(-(m + p))), 6), 0.0) AS score
  FROM documents d LEFT JOIN means USING (doc_id), prior)
"""
    )
