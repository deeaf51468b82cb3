"""Column functions and generators on hand-made rows."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textvariety.functions import features, text
from textvariety.operators.generate import lines_of, sentence_chunks, unpivot_parallel
from textvariety.operators.vocabulary import (
    char_ngram_counts,
    explode_char_ngrams,
    feature_counts,
    vocabulary,
    word_ids,
)

BLANKS = (
    "   \u001c\u000bhi. 　Yo!\u001fOk? end \u0085​"
)
FEW = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def each(spark, values, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_newline_to_space_leaves_other_blanks(spark):
    assert one(spark, "a\nb\r\n\tc", text.newline_to_space("x")) == "a b\r \tc"


def test_strip_flavours(spark):
    assert one(spark, BLANKS, text.strip("x")) == BLANKS.strip()
    assert BLANKS.strip().startswith("hi.") and BLANKS.strip().endswith("​")
    value = " \u001cx "
    assert one(spark, value, text.strip("x", "unicode")) == "\u001cx"
    assert one(spark, value, text.strip("x")) == "x"


@FEW
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1c\x85  　ab​"), min_size=20))
def test_strip_equals_python(spark, values):
    assert each(spark, values, text.strip("x")) == [v.strip() for v in values]


def test_label_tag_sends_null_and_others_to_the_negative_class(spark):
    tags = each(spark, [0, 1, 2, None], text.label_tag("x"), "int")
    assert tags == [text.POSITIVE_TAG] + [text.NEGATIVE_TAG] * 3


def test_labelled_line(spark):
    df = spark.createDataFrame(
        [(0, " a\nb "), (None, "c"), (1, None)], "label int, x string"
    )
    lines = [r[0] for r in df.select(text.labelled_line("x", "label")).collect()]
    assert lines == ["__label__PT_PT a b", "__label__PT_BR c", None]


def test_tag_to_label_rejects_unknown_tags(spark):
    tags = [text.POSITIVE_TAG, text.NEGATIVE_TAG, None]
    assert each(spark, tags, text.tag_to_label("x")) == [0, 1, None]
    with pytest.raises(PySparkException, match="unknown label tag"):
        each(spark, ["__label__XX"], text.tag_to_label("x"))
    assert one(spark, text.POSITIVE_TAG, text.tag_name("x")) == "PT_PT"


def test_long_enough_line_counts_the_tag(spark):
    lines = ["__label__PT_PT " + "x" * n for n in (5, 6)]
    assert each(spark, lines, text.long_enough_line("x")) == [False, True]


def test_known_label_and_non_empty(spark):
    known = each(spark, [None, 2, 0, 1], text.known_label("x"), "int")
    assert known == [False, False, True, True]
    assert each(spark, [None, "", " "], text.non_empty_text("x")) == [False, False, True]


def test_preview(spark):
    values = ["a" * 120, "a" * 121, None]
    assert each(spark, values, text.preview("x")) == ["a" * 120, "a" * 120 + "...", None]


def test_fallback(spark):
    df = spark.createDataFrame(
        [("", 0.9), ("\n", 0.9), ("x", 0.9), ("x", None), (None, 0.9)], "x string, p double"
    )
    got = [r[0] for r in df.select(text.fallback("x", "p", 0.0)).collect()]
    assert got == [0.0, 0.0, 0.9, 0.0, 0.0]


def test_keep_above_is_inclusive(spark):
    assert each(spark, [0.7, 0.69], text.keep_above("x"), "double") == [True, False]


def test_remap_label(spark):
    column = text.remap_label("x", {0: 1, 1: 0})
    assert each(spark, [0, 1, None], column, "int") == [1, 0, None]
    with pytest.raises(Exception, match="unmapped label: 2"):
        each(spark, [0, 2], column, "int")


def chunks(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, text string")
    got = sentence_chunks(df).orderBy("i", "chunk_no").collect()
    return [[r["text"] for r in got if r["i"] == i] for i in range(len(values))]


def test_sentence_chunks_edges(spark):
    four = "Sentence 0 here. Sentence 1 here. Sentence 2 here. Sentence 3 here."
    want = {
        "": [],
        "no punctuation but long enough": ["no punctuation but long enough"],
        four: [four],
        # The fifth sentence alone has no more than 20 characters.
        four + " Sentence 4 here.": [four],
        four + " " + four: [four, four],
        "x" * 19 + ".": [],
        "x" * 20 + ".": ["x" * 20 + "."],
        "Wait... what?! Really?!  Yes. And \n more words follow here": [
            "Wait... what?! Really?! Yes.",
            "And \n more words follow here",
        ],
    }
    assert chunks(spark, list(want)) == list(want.values())


@FEW
@given(st.lists(st.text(alphabet="ab.!? \n \x1fé\U0001f600", max_size=200), min_size=10))
def test_sentence_chunks_keep_order_and_size(spark, values):
    for value, found in zip(values, chunks(spark, values)):
        assert all(len(c) > 20 and c == c.strip() for c in found)
        ends = [re.findall(r"[.!?](?=\s)", c) for c in found]
        # A chunk of four sentences has three ends inside; blanks may follow a
        # mark of its own sentence only where a sentence ends.
        assert all(len(e) <= 3 for e in ends)
        rest = "".join(value.split())
        for chunk in found:
            at = rest.find("".join(chunk.split()))
            assert at >= 0
            rest = rest[at + len("".join(chunk.split())) :]


def test_unpivot_parallel(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", " ")], "i int, pt string, br string")
    got = unpivot_parallel(df, {"pt": 0, "br": 1}).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0), (2, " ", 1)]


def test_lines_of(spark):
    df = spark.createDataFrame([("a\n\n  b \n  \nc",)], "text string")
    got = lines_of(df).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in got] == [(0, "a"), (2, "b"), (4, "c")]


def test_tokens_and_word_ngrams(spark):
    assert one(spark, " A b,\t\nc d ", features.tokens("x")) == ["A", "b,", "c d"]
    words = [[], ["a"], ["a", "b"], ["a", "b", "c"]]
    for n in (1, 2, 3):
        want = [[" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] for w in words]
        assert each(spark, words, features.word_ngrams("x", n), "array<string>") == want


def python_char_ngrams(word: str, minn: int, maxn: int) -> list[str]:
    marked = f"<{word}>"
    grams = []
    for n in range(max(minn, 1), maxn + 1):
        for i in range(len(marked) - n + 1):
            if n > 1 or 0 < i < len(marked) - 1:
                grams.append(marked[i : i + n])
    return sorted(grams)


WORDS = ["a", "été", "\U0001f600b", "<>", "x" * 40 + "ç", "ab" * 63, "abc" * 43, "q\U0001f600" * 300]


@pytest.mark.parametrize("sizes", [(1, 3), (2, 5), (3, 3), (0, 0)])
def test_char_ngrams_of_any_length(spark, sizes):
    want = [python_char_ngrams(w, *sizes) for w in WORDS]
    got = each(spark, WORDS, features.char_ngrams("x", *sizes))
    assert [sorted(g) for g in got] == want
    if sizes[1]:
        df = spark.createDataFrame(list(enumerate(WORDS)), "i int, word string")
        rows = explode_char_ngrams(df, *sizes).collect()
        assert [sorted(r["gram"] for r in rows if r["i"] == i) for i in range(len(WORDS))] == want


def test_vocabulary_keeps_case_and_drops_rare(spark):
    df = spark.createDataFrame([("a A a",), ("a b",)], "text string")
    assert dict(map(tuple, vocabulary(df, min_count=2).collect())) == {"a": 3}


def test_word_ids_follow_frequency(spark):
    df = spark.createDataFrame([("a " * 5 + "b " * 9 + "c d e " * 2,)], "text string")
    got = {r["word"]: r["id"] for r in word_ids(vocabulary(df)).collect()}
    assert (got["b"], got["a"]) == (0, 1) and sorted(got.values()) == list(range(5))


def test_char_ngram_counts_weigh_words(spark):
    df = spark.createDataFrame([("ab ab b",)], "text string")
    got = dict(map(tuple, char_ngram_counts(df, 2, 2).collect()))
    assert got == {"<a": 2, "ab": 2, "b>": 3, "<b": 1}


def test_feature_counts_merge_buckets(spark):
    df = spark.createDataFrame([(1, "ab ab cd"), (2, "")], "i int, text string")
    vocab = spark.createDataFrame([("ab",)], "word string")
    got = feature_counts(df, "i", vocab=vocab, word_n=2, minn=2, maxn=2, bucket=1).collect()
    # 2 bigrams, and 3 character bigrams for each of 3 words, in one bucket.
    assert sorted(map(tuple, got)) == [(1, "# 0", 11), (1, "ab", 2)]


def test_feature_counts_are_taken_in_place(spark, monkeypatch):
    """Equal to brute force, also for repeated and null keys, without an aggregate."""
    from collections import Counter

    from textvariety.operators import document_features as dfe
    from textvariety.operators import feature_blocks as fb

    monkeypatch.setattr(fb, "BLOCK_BYTES", 60)
    monkeypatch.setattr(dfe, "ROWS", 2)
    monkeypatch.setattr(dfe, "COUNTS_AT_ONCE", 5)
    rows = [(1, "a b\ta b"), (1, "b a"), (None, "ü a"), (None, "ü"), (2, None), (3, " \n"), (4, "x𝔘y a x𝔘y")]
    rows += [(i, f"a w{i % 3} b") for i in range(5, 25)]
    df = spark.createDataFrame(rows, "i int, text string").repartition(3)
    vocab = spark.createDataFrame([("a",), ("x𝔘y",)], "word string")
    for listed in (vocab, None):
        made = feature_counts(df, "i", vocab=listed, word_n=3, minn=1, maxn=3, bucket=50)
        assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString().replace(
            "Aggregate [block", ""
        )
        want = Counter()
        for i, said in rows:
            words = (said or "").split()
            for w in words:
                if listed is None or w in ("a", "x𝔘y"):
                    want[i, w] += 1
                marked = f"<{w}>"
                grams = list(w) + [marked[j : j + n] for n in (2, 3) for j in range(len(marked) - n + 1)]
                want.update((i, f"# {dfe.bucket_of(g, 50)}") for g in grams)
            for n in (2, 3):
                runs = (" ".join(words[j : j + n]) for j in range(len(words) - n + 1))
                want.update((i, f"# {dfe.bucket_of(r, 50)}") for r in runs)
        got = made.collect()
        assert {(r["i"], r["feature"]): r["n"] for r in got} == dict(want) and len(got) == len(want)


def test_buckets_are_those_of_the_expression(spark):
    from textvariety.operators.document_features import bucket_of

    df = spark.createDataFrame([("a b",), ("ü",), ("𝔘",), ("",)], "f string")
    got = df.select("f", features.feature_bucket("f", 1_000_000).alias("b")).collect()
    assert all(r["b"] == bucket_of(r["f"], 1_000_000) for r in got)


def test_text_functions_need_no_python(spark):
    df = spark.createDataFrame([("a b. c",)], "text string")
    plan = sentence_chunks(df.select(F.lit(1).alias("i"), "text")).select(
        features.tokens("text"), text.strip("text")
    )
    assert "Python" not in plan._jdf.queryExecution().toString()
