"""Every stage of the pipeline next to plain Python on its own input."""

import re
from collections import Counter

import pytest
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from textvariety.llm import bpe, mixing, pii
from textvariety.llm.common import DOCUMENT
from textvariety.sources.scratch import store
from tests.llm.helpers import BASE_PII, base_spans, sha

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], SF_DIR)))
    return out


def rows(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_columns(stages):
    for frame in stages[1:-1]:
        assert frame.columns == list(DOCUMENT)


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r[0] for r in rows(stages[1], "doc_id")}
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    assert len(good - kept) <= 0.01 * len(good) and len(bad & kept) <= 0.05 * len(bad)


def shingles(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def test_one_of_each_group_stays(stages):
    before, after = ({d: t for d, t in rows(s, "doc_id", "text")} for s in stages[1:3])
    sets = {d: shingles(t) for d, t in before.items()}
    where = {}
    for d in sorted(sets):
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    shared = Counter()
    for ids in where.values():
        shared.update((a, b) for i, b in enumerate(ids) for a in ids[:i])
    root = {d: d for d in before}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert set(after) == {d for d in before if find(d) == d}
    assert all(after[d] == before[d] for d in after)


def test_personal_data_is_masked(stages):
    before, after = ({d: t for d, t in rows(s, "doc_id", "text")} for s in stages[2:4])
    assert before.keys() == after.keys()
    changed = 0
    for d, text in before.items():
        spans = base_spans(text, BASE_PII)
        changed += bool(spans)
        if not spans:
            assert after[d] == text
        for start, _, end, kind in spans:
            assert text[start:end] not in after[d] or kind == "ip"
        assert not [s for s in base_spans(after[d], BASE_PII) if s[3] in ("email", "card")]
    assert changed


def test_mix_meets_its_targets(stages):
    def sizes(frame):
        out = Counter()
        for source, text in rows(frame, "source", "text"):
            out[source] += len(re.findall(r"[^ \t-\r]+", text))
        return out

    had, got = sizes(stages[3]), sizes(stages[4])
    names = sorted(had)
    goals = mixing.targets([had[n] for n in names], mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    for name, goal in zip(names, goals):
        assert abs(got[name] - goal) <= 1
    texts = dict(rows(stages[3], "doc_id", "text"))
    words = Counter()
    for doc, text in rows(stages[4], "doc_id", "text"):
        assert text in texts[doc]
        words[doc] += len(text.split())
    assert all(n <= 2 * len(re.findall(r"[^ \t-\r]+", texts[d])) for d, n in words.items())


def test_tokens(stages):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((d, tuple(library.encode_ordinary(t)), sha(t)) for d, t in rows(stages[4], "doc_id", "text"))
    got = Counter((d, tuple(i), s) for d, i, s in rows(stages[5], "doc_id", "ids", "decoded_sha256"))
    assert got == want


def test_run_is_repeatable(spark, stages):
    again = corpus_pipeline.run(spark, SF_DIR)
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "ids").cast("decimal(38,0)")).alias("h"))
    assert again.agg(*mark).first() == stages[-1].agg(*mark).first()


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one", "en", "a", 3),
    (3, "one", "en", "a", 3),
    (4, "one two three four five. " * 4000, "en", "b", None),
    (5, "one two three four five. " * 4000, "en", None, 1),
    (None, "x@y.org and 4111 1111 1111 1111", "de", "b", 7),
    (None, "x@y.org and 4111 1111 1111 1111", "de", "b", 7),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in ODD], DOCS + ", TEXT string, row int, node int")
    out = stage(spark, frame, SF_DIR).collect()
    if name in ("personal_data", "byte_bpe"):
        assert len(out) == len(ODD)
    if name == "minhash_near_dedup":
        assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(["1", "2", "3", "4", "None"])
    none = stage(spark, spark.createDataFrame([], DOCS), SF_DIR)
    assert none.count() == 0
    if name != "byte_bpe":
        assert none.columns == list(DOCUMENT)
