"""Personal data next to plain regular expressions, and what the field adds."""

import random

import numpy as np
import pytest

from textvariety.llm import pii, queries
from tests.llm.helpers import BASE_PII, base_spans, sha, spans_text

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ODD = [
    (1, None),
    (2, ""),
    (3, "a@b a@b.c.d_e@f.g. é@x.org 😀x.y@z-1.com.. @@ a@@b.c"),
    (4, "1.2.3.4.5.6.7.8 300.1.1.1 0255.001.1.1 1.2.3 9" + "9" * 5000 + ".1.1.1"),
    (5, "4111 1111 1111 1111 4111-1111-1111-1112 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 +1 4111111111111111"),
    (6, "+1 (017) 555-7713 +1 2 +123456789012345 +1234567890123456 +9 ((( +1"),
    (7, "x" * 5_000 + "@" + "y" * 5_000 + " " + "1" * 6_000 + " +" + "1 " * 20_000),
    (8, "plain words only"),
    (8, "plain words only"),
    (None, "n@o.id"),
]


def check(frame, report):
    texts = sorted((repr(r["doc_id"]), r["text"] or "") for r in frame.collect())
    got = sorted(report.collect(), key=lambda r: repr(r["doc_id"]))
    assert len(texts) == len(got)
    for (_, text), row in zip(texts, got):
        base = base_spans(text, BASE_PII)
        assert row["base_sha256"] == sha(spans_text(base))
        for kind in pii.KINDS:
            assert row[f"n_{kind}"] == sum(s[3] == kind for s in base)
        assert {spans_text([s]) for s in base} <= set(row["spans"].split(","))


@pytest.fixture(scope="module")
def model(spark):
    return pii.train_skip_chain(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_odd_texts(spark, model):
    frame = spark.createDataFrame(ODD, DOCS)
    check(frame, pii.pii_report(pii.find_pii(frame, model)))


def test_table(spark):
    check(spark.read.parquet(f"{SF_DIR}/documents.parquet"), queries.op3(spark, SF_DIR))


def test_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert pii.find_pii(none, pii.train_skip_chain(none)).count() == 0


def test_random_texts():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("a@.-+1 2(0") for _ in range(rng.randrange(60)))
        assert pii.fixed_spans(text)[0] == base_spans(text, BASE_PII)


def added(model, text):
    spans = pii.added_spans(model, [text], [pii.fixed_spans(text)])[0]
    return [(kind, text[start:end]) for start, _, end, kind in spans]


def test_repeated_numbers_share_their_label(model):
    text = "call +1 (017) 555-7713 now, or later just 555-7713, but not 473696257 on page 12"
    assert added(model, text) == [("phone", "555-7713")]
    assert added(model, "items 473696257 and 12 on 2024-01-02, version 1.2.3") == []


def test_failed_checks_stay_outside(model):
    assert added(model, "9807915762804491 and 9807915762804491, 300.1.2.3") == []


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(3)
    n = 4
    model = pii.SkipChain(
        rng.normal(size=(pii.HASHES, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), rng.normal(size=(pii.LABELS,) * 2)
    )
    graph = pii.Graph(
        [(0, i, i + 1) for i in range(n)], rng.integers(0, pii.HASHES, (n, 5)), np.full(n, -1),
        np.array([(0, 1), (1, 2)]), np.array([(2, 3)]),
        np.array([True, False, False, True]), np.array([False, False, True, True]),
    )
    got = pii.marginals(model, graph, rounds=60)
    unary = model.unary(graph)
    grid = np.indices((pii.LABELS,) * n).reshape(n, -1)
    score = sum(unary[i, grid[i]] for i in range(n))
    score = score + model.chain[grid[0], grid[1]] + model.chain[grid[1], grid[2]] + model.skip[grid[2], grid[3]]
    weight = np.exp(score - score.max())
    want = np.stack([[weight[grid[i] == k].sum() for k in range(pii.LABELS)] for i in range(n)]) / weight.sum()
    assert np.allclose(got, want, atol=1e-6)


def test_masked():
    assert pii.masked("mail a@b.c or", [(5, 10, "email")]) == "mail [EMAIL] or"
    assert pii.masked("0123456789", [(2, 6, "card"), (4, 8, "phone")]) == "01[CARD]89"


def test_hundreds_of_repeats_share_the_label_of_one_match(model):
    full, short = "call +1 (017) 555-7713 now", ", or later just 555-7713"
    for n in (4, 12, 300):
        assert added(model, full + short * n) == [("phone", "555-7713")] * n
        assert added(model, short * n + " or " + full) == [("phone", "555-7713")] * n
        spread = full + ", then 98 more and 555-7713 again" * n
        assert added(model, spread) == [("phone", "555-7713")] * n


def test_failed_checks_do_not_hide_a_match():
    assert pii._links_of_equals([0, 1, 2, 3], [-1, 0, 4, -1]) == [(1, 2), (0, 2), (2, 3)]
    assert pii._links_of_equals([0, 1, 2], [-1, 0, -1]) == [(0, 1), (1, 2)]
    assert pii._links_of_equals([0, 1, 2], [-1, -1, -1]) == [(0, 1), (0, 2)]


def test_labels_reach_the_end_of_long_runs():
    n = 200
    chain = 12.0 * np.eye(pii.LABELS)
    model = pii.SkipChain(np.zeros((pii.HASHES, pii.LABELS)), chain, np.zeros_like(chain))
    near = np.array([(i, i + 1) for i in range(n - 1)])
    known = np.array([4] + [-1] * (n - 1))
    none = np.zeros(n, bool)
    graph = pii.Graph(
        [(0, i, i + 1) for i in range(n)], np.zeros((n, 5), np.int64), known,
        near, np.zeros((0, 2), np.int64), none, none,
    )
    assert pii.marginals(model, graph)[:, 4].min() > 0.95
