"""Models, scoring and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.columns import SQL_WORDS
from registry.sampling import sql_split
from registry.core import (
    BLANK,
    SQL_WEIGHTS,
    classed,
    query,
    rounded,
    sql_md5_bucket,
    sql_scores,
    sql_tokens,
    table,
)
from textvariety.functions.features import feature_bucket
from textvariety.functions.text import keep_above
from textvariety.operators import classes, external, logistic, vectors
from textvariety.operators.log_odds import (
    predict_top_k,
    prune_features,
    score_by_join,
    score_positive,
    train_log_odds,
)
from textvariety.operators.sampling import stratified_split
from textvariety.operators.vocabulary import vocabulary
from textvariety.plans.filtering import filter_corpus
from textvariety.plans.training import evaluation_counts
from textvariety.sources.scratch import store, scratch_path
from textvariety.streaming.scoring import read_scored, read_stream, score_stream


def scored(spark, sf_dir):
    docs = classed(spark, sf_dir)
    return score_positive(docs, train_log_odds(docs), "doc_id")


@query(
    "train_log_odds",
    f"WITH {SQL_WEIGHTS} SELECT feature, n0, n1, round(weight, 6) AS weight FROM weights",
)
def _train_log_odds(spark, sf_dir):
    return rounded(train_log_odds(classed(spark, sf_dir)).weights, "weight")


@query("score_positive", f"WITH {sql_scores()} SELECT * FROM scores")
def _score_positive(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "score")


@query("score_by_join", f"WITH {sql_scores()} SELECT * FROM scores")
def _score_by_join(spark, sf_dir):
    docs = classed(spark, sf_dir)
    return score_by_join(docs, train_log_odds(docs).materialise(), "doc_id")


@query(
    "predict_top_k",
    f"""WITH {sql_scores()}, both_labels AS (
      SELECT doc_id, score AS prob, '__label__PT_PT' AS label FROM scores
      UNION ALL SELECT doc_id, 1 - score, '__label__PT_BR' FROM scores)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label DESC) - 1)::INTEGER
      AS place, label, round(prob, 6) AS prob FROM both_labels WHERE prob >= 0.25::DOUBLE""",
)
def _predict_top_k(spark, sf_dir):
    top = predict_top_k(scored(spark, sf_dir), k=2, threshold=0.25)
    rows = top.select("doc_id", F.posexplode("predictions").alias("place", "p"))
    return rows.select("doc_id", "place", "p.label", F.round("p.prob", 6).alias("prob"))


SQL_KEPT = f"""WITH {sql_scores()}
SELECT doc_id, source, text, score FROM scores JOIN documents USING (doc_id)
WHERE score >= 0.7::DOUBLE"""


def _filtered(spark, sf_dir):
    docs = classed(spark, sf_dir)
    out = scratch_path(spark, "filtered")
    return filter_corpus(docs, train_log_odds(docs), out, "doc_id")


@query("filter_corpus", SQL_KEPT)
def _filter_corpus(spark, sf_dir):
    return _filtered(spark, sf_dir).kept().select("doc_id", "source", "text", "score")


@query(
    "filter_corpus_summary",
    f"""WITH {sql_scores()} SELECT count(*) AS total,
      count(*) FILTER (score >= 0.7::DOUBLE) AS kept,
      round(count(*) FILTER (score >= 0.7::DOUBLE) * 100.0::DOUBLE / count(*), 6) AS kept_pct,
      round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM scores""",
)
def _filter_corpus_summary(spark, sf_dir):
    return rounded(_filtered(spark, sf_dir).summary(), "kept_pct", "mean", "median")


@query(
    "filter_corpus_sample",
    f"""WITH {sql_scores()}, kept AS (
      SELECT doc_id, source FROM scores JOIN documents USING (doc_id) WHERE score >= 0.7::DOUBLE)
    SELECT source FROM kept ORDER BY md5('42:' || doc_id), doc_id LIMIT 25""",
)
def _filter_corpus_sample(spark, sf_dir):
    return _filtered(spark, sf_dir).sample("source")


@query(
    "score_stream",
    f"WITH {sql_scores()} SELECT doc_id, lang, score FROM scores JOIN documents USING (doc_id)"
    " WHERE score >= 0.7::DOUBLE",
)
def _score_stream(spark, sf_dir):
    model = train_log_odds(classed(spark, sf_dir))
    docs = table(spark, sf_dir, "documents")
    out = scratch_path(spark, "stream")
    # A pattern, as a stream's path may not be a file but a table may be one.
    arriving = read_stream(spark, f"{sf_dir}/documents.parque[t]", docs.schema)
    run = score_stream(arriving, model, f"{out}/rows", f"{out}/checkpoint", "doc_id")
    run.awaitTermination()
    return read_scored(spark, f"{out}/rows").select("doc_id", "lang", "score")


SQL_TWO_SETS = f"""WITH {sql_scores()}, judged AS (
  SELECT 'all' AS dataset, label, CASE WHEN score >= 0.5::DOUBLE THEN 0 ELSE 1 END AS pred
  FROM classed JOIN scores USING (doc_id) WHERE label < 2
  UNION ALL
  SELECT 'even', label, CASE WHEN score >= 0.5::DOUBLE THEN 0 ELSE 1 END
  FROM classed JOIN scores USING (doc_id) WHERE label < 2 AND doc_id % 2 = 0)
SELECT dataset, count(*) FILTER (label = 0 AND pred = 0) AS tp,
  count(*) FILTER (label = 0 AND pred <> 0) AS fn,
  count(*) FILTER (label = 1 AND pred <> 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 1) AS tn FROM judged GROUP BY dataset"""


def _two_sets(spark, sf_dir, broadcast: bool):
    """Two data sets that share their ids."""
    docs = classed(spark, sf_dir)
    sets = {"all": docs, "even": docs.filter("doc_id % 2 = 0")}
    model = train_log_odds(docs)
    return evaluation_counts(sets, model, "doc_id", broadcast=broadcast)


@query("evaluate", SQL_TWO_SETS)
def _evaluate(spark, sf_dir):
    return _two_sets(spark, sf_dir, True)


@query("evaluate_large_model", SQL_TWO_SETS)
def _evaluate_large_model(spark, sf_dir):
    return _two_sets(spark, sf_dir, False)


CUTOFF = 300


@query(
    "prune_features",
    f"""WITH {SQL_WEIGHTS} SELECT feature, round(weight, 6) AS weight FROM weights
    ORDER BY round(abs(weight), 9) DESC, feature LIMIT {CUTOFF}""",
)
def _prune_features(spark, sf_dir):
    # Equal counts give equal weights up to the last bits, which differ by engine.
    weights = train_log_odds(classed(spark, sf_dir)).weights
    nine = weights.withColumn("weight", F.round("weight", 9))
    kept = prune_features(nine.select("feature", "weight"), CUTOFF)
    return rounded(kept, "weight")


@query(
    "score_pruned",
    f"""WITH {sql_scores(f'''(SELECT feature, weight FROM weights
      ORDER BY round(abs(weight), 9) DESC, feature LIMIT {CUTOFF})''')} SELECT * FROM scores""",
)
def _score_pruned(spark, sf_dir):
    docs = classed(spark, sf_dir)
    model = train_log_odds(docs)
    return score_positive(docs, model.pruned(CUTOFF), "doc_id").select("doc_id", "score")


# Recall a fitted model must reach on rows it has not seen.
FLOOR = 0.9
# Standard deviations by which chance may keep a class below the floor.
DEVIATIONS = 3


def _judged(tested):
    """(label, support, reached): who was tested, and whether the floor is met."""
    right = (F.col("score") >= 0.5).cast("int") == 1 - F.col("label")
    counts = tested.filter("label < 2").groupBy("label").agg(
        F.count("*").alias("support"), F.avg(right.cast("double")).alias("recall")
    )
    return counts.select("label", "support", (F.col("recall") >= FLOOR).alias("reached"))


@query(
    "train_logistic",
    f"""SELECT label, count(*) AS support, TRUE AS reached FROM ({sql_split(0.2)})
    WHERE split = 'test' AND label < 2 GROUP BY label""",
)
def _train_logistic(spark, sf_dir):
    """Supports of the held-out fifth, and that both classes are recalled."""
    rows = store(stratified_split(classed(spark, sf_dir), 0.2, "doc_id"))
    config = logistic.LogisticConfig(word_n=2, min_count=2)
    model = logistic.train_logistic(rows.filter("split = 'train'"), config)
    return _judged(logistic.score_logistic(rows.filter("split = 'test'"), model, config))


@query(
    "autotune",
    f"""SELECT label, count(*) AS support, TRUE AS reached, 4::BIGINT AS trials,
      1::BIGINT AS best, TRUE AS best_is_top FROM ({sql_split(0.2)})
    WHERE split = 'test' AND label < 2 GROUP BY label""",
)
def _autotune(spark, sf_dir):
    """Trials on a training and a validation part; the best configuration,
    trained on both, is judged on an untouched third part.

    A class counts as reached unless its misses are more than a model with
    recall FLOOR would make by chance: a few held-out rows may hold one more.
    """
    rows, best, trials = tuned(spark, sf_dir)
    known = rows.filter("split = 'train'").drop("split")
    model = logistic.train_logistic(known, best)
    tested = logistic.score_logistic(rows.filter("split = 'test'"), model, best)
    right = F.count_if((F.col("score") >= 0.5).cast("int") == 1 - F.col("label"))
    support = F.count("score")
    spread = F.sqrt(support * (FLOOR * (1 - FLOOR)))
    judged = tested.filter("label < 2").groupBy("label").agg(
        support.alias("support"),
        (right >= support * FLOOR - DEVIATIONS * spread).alias("reached"),
    )
    told = trials.agg(
        F.count("*").alias("trials"),
        F.count_if("best").alias("best"),
        (F.max(F.when(F.col("best"), F.col("f1_class0"))) == F.max("f1_class0")).alias(
            "best_is_top"
        ),
    )
    return judged.crossJoin(F.broadcast(told))


def tuned(spark, sf_dir):
    """(rows with their split, best configuration, trials) of the autotune query."""
    rows = store(stratified_split(classed(spark, sf_dir), 0.2, "doc_id"))
    known = rows.filter("split = 'train'").drop("split")
    inner = store(stratified_split(known, 0.2, "doc_id", seed=43))
    train, valid = (inner.filter(F.col("split") == s) for s in ("train", "test"))
    space = logistic.grid(word_n=[1, 2], penalty=[1e-4, 1e-2])
    best, trials = logistic.autotune(train, valid, space)
    return rows, best, trials


@query(
    "score_external",
    f"""SELECT doc_id, CASE
      WHEN regexp_matches(text, '^{BLANK[:-1]}*$') THEN 1
      WHEN length(regexp_replace(text, '[^aeiou]', '', 'g'))::DOUBLE / length(text) > 0.35::DOUBLE THEN 0
      ELSE 1 END AS pred FROM documents""",
)
def _score_external(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    swapped = {0: 1, 1: 0}
    rows = external.score_external(docs, external.vowel_share_model, swapped)
    return rows.select("doc_id", "pred")


@query(
    "train_word_vectors",
    f"WITH {SQL_WORDS} SELECT word, 100 AS dim FROM words WHERE n >= 5",
)
def _train_word_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = vectors.train_word_vectors(docs)
    return words.select("word", F.size("vector").alias("dim"))


# Each frequent word borrows the embedding its hash points at.
SQL_VECTORS = f"""{SQL_WORDS}, word_vectors AS (
  SELECT word, embedding FROM (SELECT word, {sql_md5_bucket('word', 1)} AS x,
    ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id
    FROM words) JOIN embeddings USING (vec_id))"""


@query(
    "doc_vectors",
    f"""WITH {SQL_VECTORS}, c AS (
      SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, unnest({sql_tokens('text')}) AS word FROM documents) GROUP BY ALL),
    parts AS (
      SELECT doc_id, n, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x
      FROM c JOIN word_vectors USING (word))
    SELECT doc_id, (dim - 1)::INTEGER AS dim, sum(n)::BIGINT AS n,
      round(sum(n * x) / sum(n), 5) AS x FROM parts GROUP BY doc_id, dim""",
)
def _doc_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    embeddings = table(spark, sf_dir, "embeddings")
    size = embeddings.agg(F.count("*")).scalar()
    words = vocabulary(docs, min_count=1).withColumn(
        "vec_id", feature_bucket("word", 1 << 32) % size
    )
    given = store(
        words.join(embeddings, "vec_id").select("word", F.col("embedding").alias("vector"))
    )
    means = vectors.doc_vectors(docs, given, "doc_id")
    flat = means.select("doc_id", "n", F.posexplode("vector").alias("dim", "x"))
    return rounded(flat, "x", digits=5)


def _exemplars(spark, sf_dir):
    """The first vector of each class."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy("label").agg(
        F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("vector")
    )


SQL_EXEMPLARS = """exemplars AS (
  SELECT label, min(vec_id) AS vec_id, min_by(embedding, vec_id)::DOUBLE[] AS v
  FROM embeddings GROUP BY label)"""


@query(
    "nearest",
    f"""WITH {SQL_EXEMPLARS}, ranked AS (
      SELECT q.label AS query, e.vec_id,
        list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS similarity
      FROM embeddings e JOIN exemplars q ON e.vec_id <> q.vec_id),
    placed AS (SELECT *, row_number() OVER (
      PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM ranked)
    SELECT query, rank::INTEGER AS rank, vec_id, round(similarity, 6) AS similarity
    FROM placed WHERE rank <= 10""",
)
def _nearest(spark, sf_dir):
    queries = _exemplars(spark, sf_dir).select(
        F.col("label").alias("query"), "vector", F.array("vec_id").alias("exclude")
    )
    embeddings = table(spark, sf_dir, "embeddings")
    return rounded(vectors.nearest(queries, embeddings, 10, "vec_id", "embedding"), "similarity")


@query(
    "nearest_all",
    """WITH ranked AS (
      SELECT q.vec_id AS query, e.vec_id,
        list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity
      FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id),
    placed AS (SELECT *, row_number() OVER (
      PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM ranked)
    SELECT query, rank::INTEGER AS rank, vec_id, round(similarity, 6) AS similarity
    FROM placed WHERE rank <= 5""",
)
def _nearest_all(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    queries = embeddings.select(
        F.col("vec_id").alias("query"), F.col("embedding").alias("vector"),
        F.array("vec_id").alias("exclude"),
    )
    return rounded(vectors.nearest(queries, embeddings, 5, "vec_id", "embedding"), "similarity")


@query(
    "analogies",
    f"""WITH {SQL_EXEMPLARS}, units AS (
      SELECT label, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
      FROM exemplars),
    asked AS (
      SELECT a.label AS query, [a.vec_id, b.vec_id, c.vec_id] AS banned,
        list_transform(range(1, len(a.u) + 1), lambda i: a.u[i] - b.u[i] + c.u[i]) AS v
      FROM units a JOIN units b ON b.label = (a.label + 1) % 10
      JOIN units c ON c.label = (a.label + 2) % 10),
    ranked AS (
      SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS similarity
      FROM embeddings, asked WHERE NOT list_contains(banned, vec_id)),
    placed AS (SELECT *, row_number() OVER (
      PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM ranked)
    SELECT query, rank::INTEGER AS rank, vec_id, round(similarity, 6) AS similarity
    FROM placed WHERE rank <= 5""",
)
def _analogies(spark, sf_dir):
    firsts = _exemplars(spark, sf_dir).select("label", "vec_id")

    def side(name: str, step: int):
        owner = F.pmod(F.col("label") - step, F.lit(10))
        return firsts.select(owner.alias("query"), F.col("vec_id").alias(name))

    triples = side("a", 0).join(side("b", 1), "query").join(side("c", 2), "query")
    embeddings = table(spark, sf_dir, "embeddings")
    return rounded(vectors.analogies(triples, embeddings, 5, "vec_id", "embedding"), "similarity")


# --- Classes beyond two: the four languages ---

SQL_CLASSES = f"""
docs AS (SELECT doc_id, lang AS label, text FROM documents),
toks AS (SELECT label, unnest({sql_tokens('text')}) AS feature FROM docs WHERE label IS NOT NULL),
pairs AS (SELECT feature, label, count(*) AS n FROM toks GROUP BY ALL),
vocab AS (SELECT feature FROM pairs GROUP BY feature HAVING sum(n) >= 2),
kept AS (SELECT * FROM pairs SEMI JOIN vocab USING (feature)),
v AS (SELECT count(*) AS v FROM vocab),
class_docs AS (SELECT label, count(*) AS docs FROM docs WHERE label IS NOT NULL GROUP BY label),
totals AS (SELECT label, sum(n) AS total FROM kept GROUP BY label),
cls AS (
  SELECT c.label, coalesce(total, 0) AS total,
    ln(docs / (SELECT sum(docs) FROM class_docs)) AS prior, -ln(coalesce(total, 0) + v) AS dflt
  FROM class_docs c LEFT JOIN totals USING (label), v),
weights AS (
  SELECT feature, label, n, ln((n + 1) / (total + v)) AS weight,
    ln((n + 1) / (total + v)) - dflt AS delta
  FROM kept JOIN cls USING (label), v)"""


@query(
    "train_log_odds_classes",
    f"""WITH {SQL_CLASSES}
    SELECT feature, label, n, round(weight, 9) AS weight FROM weights""",
)
def _train_classes(spark, sf_dir):
    """(feature, label, n, weight) of a model over the four languages."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "label")
    model = classes.train_log_odds_classes(docs)
    return rounded(model.weights.select("feature", "label", "n", "weight"), "weight", digits=9)


@query(
    "predict_top_k_classes",
    f"""WITH {SQL_CLASSES},
doc_feats AS (
  SELECT doc_id, feature, count(*) AS n
  FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS feature FROM documents) GROUP BY ALL),
known AS (SELECT * FROM doc_feats SEMI JOIN vocab USING (feature)),
sizes AS (SELECT doc_id, sum(n) AS known FROM known GROUP BY doc_id),
sums AS (
  SELECT doc_id, label, sum(k.n * w.delta) AS s FROM known k JOIN weights w USING (feature)
  GROUP BY ALL),
raw AS (
  SELECT d.doc_id, c.label, CASE WHEN sz.known > 0
    THEN (c.prior + c.dflt) + coalesce(s.s, 0) / sz.known ELSE c.prior END AS s
  FROM documents d CROSS JOIN cls c LEFT JOIN sizes sz ON sz.doc_id = d.doc_id
  LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.label = c.label),
tops AS (SELECT doc_id, max(s) AS top FROM raw GROUP BY doc_id),
e AS (SELECT raw.doc_id, label, exp(s - top) AS e FROM raw JOIN tops USING (doc_id)),
p AS (SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS prob FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label)::INTEGER AS rank,
  label, prob FROM p QUALIFY rank <= 3""",
)
def _predict_classes(spark, sf_dir):
    """The three likeliest languages of every document, by a model of all four."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "label")
    model = classes.train_log_odds_classes(docs)
    return classes.predict_top_k_classes(docs, model, "doc_id", k=3)
