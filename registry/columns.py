"""Column functions and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import (
    SQL_CHUNKS,
    SQL_CLASSED,
    SQL_SCORE,
    WS,
    WS_UNICODE,
    classed,
    query,
    scored_documents,
    sql_md5_bucket,
    sql_strip,
    sql_tokens,
    table,
    vowel_score,
)
from registry.sources import SQL_LINE
from textvariety.functions import features, text
from textvariety.operators import generate, vocabulary
from textvariety.sources.scratch import broadcast_if_small, store


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("newline_to_space", "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def _newline_to_space(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.newline_to_space("text").alias("text"))


# Lines of raw pages, split at '>', start and end with all sorts of blanks.
@query(
    "strip",
    f"""WITH parts AS (SELECT page_id, unnest(string_split(html, '>')) AS part FROM pages)
    SELECT page_id, {sql_strip('part', WS)} AS python, {sql_strip('part', WS_UNICODE)} AS other
    FROM parts""",
)
def _strip(spark, sf_dir):
    parts = table(spark, sf_dir, "pages").select(
        "page_id", F.explode(F.split("html", ">")).alias("part")
    )
    return parts.select(
        "page_id",
        text.strip("part").alias("python"),
        text.strip("part", "unicode").alias("other"),
    )


@query(
    "label_tag",
    f"""WITH {SQL_CLASSED} SELECT doc_id,
      CASE WHEN label = 0 THEN '__label__PT_PT' ELSE '__label__PT_BR' END AS tag FROM classed""",
)
def _label_tag(spark, sf_dir):
    return classed(spark, sf_dir).select("doc_id", text.label_tag("label").alias("tag"))


@query("labelled_line", f"WITH {SQL_CLASSED} SELECT doc_id, {SQL_LINE} AS line FROM classed")
def _labelled_line(spark, sf_dir):
    rows = classed(spark, sf_dir)
    return rows.select("doc_id", text.labelled_line("text", "label").alias("line"))


@query(
    "tag_to_label",
    f"""WITH {SQL_CLASSED} SELECT doc_id, CASE WHEN label = 0 THEN 0 ELSE 1 END AS label,
      CASE WHEN label = 0 THEN 'PT_PT' ELSE 'PT_BR' END AS name FROM classed""",
)
def _tag_to_label(spark, sf_dir):
    tags = classed(spark, sf_dir).select("doc_id", text.label_tag("label").alias("tag"))
    return tags.select(
        "doc_id", text.tag_to_label("tag").alias("label"), text.tag_name("tag").alias("name")
    )


@query("remap_label", "SELECT doc_id, 1 - quality AS label FROM labels")
def _remap_label(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", text.remap_label("quality", {0: 1, 1: 0}).alias("label"))


@query(
    "is_positive",
    f"""WITH {SQL_CLASSED} SELECT doc_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS positive
    FROM classed""",
)
def _is_positive(spark, sf_dir):
    return classed(spark, sf_dir).select("doc_id", text.is_positive("label").alias("positive"))


@query(
    "long_enough_line",
    f"""WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, line FROM lines WHERE length({sql_strip('line')}) > 20""",
)
def _long_enough_line(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(text.long_enough_line("line"))


@query(
    "known_labels",
    f"WITH {SQL_CLASSED} SELECT doc_id, label FROM classed WHERE label IN (0, 1)",
)
def _known_labels(spark, sf_dir):
    return classed(spark, sf_dir).filter(text.known_label("label")).select("doc_id", "label")


def _pairs(spark, sf_dir):
    """User turns as `pt`, the assistant's next turn, if any, as `br`."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("pt"))
    said = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("br")
    )
    return asked.join(said, ["conv_id", "turn"], "left")


SQL_PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS pt, a.text AS br
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


@query(
    "non_empty_text",
    f"WITH {SQL_PAIRS} SELECT conv_id, turn, br FROM pairs WHERE br IS NOT NULL AND br <> ''",
)
def _non_empty_text(spark, sf_dir):
    return _pairs(spark, sf_dir).filter(text.non_empty_text("br")).select("conv_id", "turn", "br")


@query(
    "preview",
    """SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...'
      ELSE text END AS preview FROM documents""",
)
def _preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.preview("text").alias("preview"))


# Lines may be blank, and lines without a vowel have no prediction.
@query(
    "fallback",
    f"""WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
    said AS (SELECT doc_id, text, CASE WHEN length(text) > 0 AND {SQL_SCORE} > 0 THEN {SQL_SCORE} END AS s FROM lines)
    SELECT doc_id, CASE WHEN {sql_strip('text')} = '' THEN 0.0 ELSE coalesce(s, 0.0) END AS score
    FROM said""",
)
def _fallback(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    said = F.when(vowel_score() > 0, vowel_score())
    return lines.select("doc_id", text.fallback("text", said, 0.0).alias("score"))


@query(
    "keep_above",
    f"""WITH s AS (SELECT doc_id, source, {SQL_SCORE} AS score FROM documents)
    SELECT * FROM s WHERE score >= 0.7::DOUBLE""",
)
def _keep_above(spark, sf_dir):
    return scored_documents(spark, sf_dir).filter(text.keep_above("score"))


@query("sentence_chunks", f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_no, text FROM chunks")
def _sentence_chunks(spark, sf_dir):
    return generate.sentence_chunks(_docs(spark, sf_dir).select("doc_id", "text"))


@query(
    "unpivot_parallel",
    f"""WITH {SQL_PAIRS}
    SELECT conv_id, turn, pt AS text, 0 AS label FROM pairs WHERE pt <> ''
    UNION ALL SELECT conv_id, turn, br, 1 FROM pairs WHERE br <> ''""",
)
def _unpivot_parallel(spark, sf_dir):
    return generate.unpivot_parallel(_pairs(spark, sf_dir), {"pt": 0, "br": 1})


@query(
    "lines_of",
    f"""WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
    SELECT doc_id, line_no::INTEGER AS line_no, {sql_strip('line')} AS text
    FROM lines WHERE {sql_strip('line')} <> ''""",
)
def _lines_of(spark, sf_dir):
    return generate.lines_of(_docs(spark, sf_dir).select("doc_id", "text"))


@query(
    "tokens",
    f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)
    SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS words FROM t""",
)
def _tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", features.tokens("text").alias("t")).select(
        "doc_id",
        F.size("t").cast("bigint").alias("n"),
        F.array_join("t", " ").alias("words"),
    )


SQL_BIGRAMS = f"""t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
places AS (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t),
bigrams AS (SELECT doc_id, t[i] || ' ' || t[i + 1] AS ngram FROM places)"""


@query(
    "word_ngrams",
    f"WITH {SQL_BIGRAMS} SELECT ngram, count(*) AS n FROM bigrams GROUP BY ngram",
)
def _word_ngrams(spark, sf_dir):
    return vocabulary.word_ngram_counts(_docs(spark, sf_dir), 2)


def sql_char_ngrams(words: str, minn: int, maxn: int, keep: str) -> str:
    """SELECT over `words` (word, n, keep): n-grams of '<word>'."""
    parts = [
        f"SELECT {keep}, n, '<' || word || '>' AS w, {size} AS size FROM {words}"
        for size in range(minn, maxn + 1)
    ]
    return f"""
    SELECT {keep}, n, substr(w, i, size) AS ngram
    FROM (SELECT *, unnest(range(1, length(w) - size + 2)) AS i
          FROM ({' UNION ALL '.join(parts)}))"""


SQL_WORDS = (
    f"words AS (SELECT word, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS word"
    " FROM documents) GROUP BY word)"
)


@query(
    "char_ngrams",
    f"""WITH {SQL_WORDS}, grams AS ({sql_char_ngrams('words', 2, 5, 'word')})
    SELECT ngram, sum(n)::BIGINT AS n FROM grams GROUP BY ngram""",
)
def _char_ngrams(spark, sf_dir):
    return vocabulary.char_ngram_counts(_docs(spark, sf_dir), 2, 5)


@query("vocabulary", f"WITH {SQL_WORDS} SELECT word, n FROM words WHERE n >= 5")
def _vocabulary(spark, sf_dir):
    return vocabulary.vocabulary(_docs(spark, sf_dir), min_count=5)


@query(
    "word_ids",
    f"""WITH {SQL_WORDS} SELECT word, n, row_number() OVER (
      ORDER BY n DESC, md5('42:' || word), word) - 1 AS id FROM words WHERE n >= 5""",
)
def _word_ids(spark, sf_dir):
    return vocabulary.word_ids(vocabulary.vocabulary(_docs(spark, sf_dir), min_count=5))


BUCKETS = 1_000_000


@query(
    "subwords",
    f"""WITH {SQL_WORDS}, grams AS ({sql_char_ngrams('words', 3, 5, 'word')})
    SELECT word, ngram AS gram, {sql_md5_bucket('ngram', BUCKETS)} AS id FROM grams""",
)
def _subwords(spark, sf_dir):
    words = vocabulary.vocabulary(_docs(spark, sf_dir))
    return words.select("word", F.inline(features.subwords("word", 3, 5, BUCKETS)))


@query(
    "feature_counts",
    f"""WITH {SQL_WORDS}, {SQL_BIGRAMS},
    doc_words AS (SELECT doc_id, word, count(*) AS n FROM (
      SELECT doc_id, unnest(t) AS word FROM t) GROUP BY ALL),
    grams AS ({sql_char_ngrams('doc_words', 3, 4, 'doc_id')}),
    parts AS (
      SELECT doc_id, word AS feature, d.n FROM doc_words d JOIN words w USING (word) WHERE w.n >= 5
      UNION ALL
      SELECT doc_id, '# ' || {sql_md5_bucket('ngram', BUCKETS)} AS feature, n FROM grams
      UNION ALL
      SELECT doc_id, '# ' || {sql_md5_bucket('ngram', BUCKETS)} AS feature, 1 AS n FROM bigrams)
    SELECT doc_id, feature, sum(n)::BIGINT AS n FROM parts GROUP BY ALL""",
)
def _feature_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    vocab = broadcast_if_small(store(vocabulary.vocabulary(docs, min_count=5)))
    return vocabulary.feature_counts(
        docs, "doc_id", vocab=vocab, word_n=2, minn=3, maxn=4, bucket=BUCKETS
    )
