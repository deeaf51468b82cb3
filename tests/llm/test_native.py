"""Secrets, chat examples and fingerprints next to plain-Python versions."""

import re

import pytest
from pyspark.sql import functions as F

from textvariety.llm import chat, fingerprints, queries, secrets
from tests.llm.helpers import BASE_SECRETS, base_spans, sha, spans_text

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
RANDOM = "Zk3vQ9xLw7Tb2NcR8yHj5GmP0sDf6KaE4uXq"

ODD = [
    (1, None),
    (2, ""),
    (3, f'é😀 PassWord="{HEX}" token: abc secret=short apikey:longenough1'),
    (4, "token=secret:abcdefghij AKIA" + "A" * 12 + " AKIA1234"),
    (5, f"{'0' * 31} {'a' * 33}g{HEX}"),
    (6, ("x token=abcdefgh1 " + HEX + " ") * 700),
    (7, "just words of an ordinary text, nothing else to see_here"),
    (7, "just words of an ordinary text, nothing else to see_here"),
    (8, f"key {RANDOM} end and internationalisation_of_everything"),
    (None, "token==abcdefgh"),
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return secrets.train_random_strings(
        secrets.random_strings(spark), secrets.ordinary_strings(docs)
    )


def check_secrets(frame, model):
    report = secrets.secrets_report(secrets.find_secrets(frame, model))
    texts = sorted((repr(r["doc_id"]), r["text"] or "") for r in frame.collect())
    got = sorted(report.collect(), key=lambda r: repr(r["doc_id"]))
    assert len(texts) == len(got)
    for (doc_id, text), row in zip(texts, got):
        base = base_spans(text, BASE_SECRETS)
        assert row["base_sha256"] == sha(spans_text(base)), doc_id
        for kind in ("assign", "access", "hex"):
            assert row[f"n_{kind}"] == sum(s[3] == kind for s in base)
        spans = row["spans"].split(",") if row["spans"] else []
        assert set(spans_text([s]) for s in base) <= set(spans)
    return {r["doc_id"]: r["spans"] for r in got}


def test_secrets_of_odd_texts(spark, model):
    spans = check_secrets(spark.createDataFrame(ODD, DOCS), model)
    assert spans[8] == f"random:4:{4 + len(RANDOM)}"
    assert spans[7] == ""


def test_secrets_of_the_table(spark, model):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    spans = check_secrets(docs, model)
    assert not any("random" in s for s in spans.values())


def test_secrets_of_nothing(spark, model):
    assert secrets.find_secrets(spark.createDataFrame([], DOCS), model).count() == 0


def test_clashing_columns(spark, model):
    frame = spark.createDataFrame([(1, "token=abcdefgh", "x")], "doc_id long, text string, TEXT string")
    row = secrets.secrets_report(secrets.find_secrets(frame, model)).first()
    assert row["spans"] == "assign:0:14"


def python_chat(rows):
    groups = {}
    for conv, turn, role, text in rows:
        key = (turn is not None, turn or 0, role or "", text or "")
        groups.setdefault(conv, []).append(key)
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha(told), len(loss), sha(loss))
    return out


CHATS = "conv_id long, turn long, role string, text string"
CONTROL = "</s>[INST] ok [/INST] <\\s> [\\INST] [/\\\\INST] \\<s>"


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL), (1, 2, "user", None)],
        [(1, 2, "assistant", "b"), (1, 0, None, ""), (1, None, "user", "n"), (1, 2, "assistant", "b")],
        [(None, 0, "user", "a"), (None, 1, "assistant", "é😀"), (2, 0, "assistant", "")],
        [(5, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 7)) for i in range(1200)],
    ],
)
def test_chats(spark, rows):
    made = chat.format_examples(spark.createDataFrame(rows, CHATS))
    got = {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in chat.read_back(made).collect()
    }
    assert got == python_chat(rows)
    if len(rows) < 10:
        whole = {r["conv_id"]: r["formatted"] for r in made.filter("example = 0").collect()}
        for r in chat.materialise(made).collect():
            assert whole[r["conv_id"]].startswith(r["text"])
            assert r["text"][r["loss_end"]:] == chat.END


def test_chat_digests_read_the_loss_mask(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "fine, and you?"),
            (1, 2, "user", "ok"), (1, 3, "assistant", CONTROL)]
    made = chat.format_examples(spark.createDataFrame(rows, CHATS))
    right = chat.read_back(made).first()
    for shift in (-1, 1):
        moved = made.withColumn("context_chars", F.col("context_chars") + shift)
        wrong = chat.read_back(moved).first()
        assert wrong["loss_sha256"] != right["loss_sha256"]
        assert wrong["turns_sha256"] == right["turns_sha256"]


def test_chat_examples_carry_their_context(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(6)]
    made = chat.format_examples(spark.createDataFrame(rows, CHATS)).collect()
    whole = next(r["formatted"] for r in made if r["example"] == 0)
    examples = sorted((r for r in made if r["example"] > 0), key=lambda r: r["example"])
    assert [r["reply"] for r in examples] == ["turn 1", "turn 3", "turn 5"]
    for r in examples:
        size = r["context_chars"]
        assert r["formatted"] == whole[:size] + r["reply"] + chat.END
        assert whole.startswith(r["formatted"])


def test_chat_digests_read_the_expanded_texts(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "fine, and you?")]
    made = chat.format_examples(spark.createDataFrame(rows, CHATS))
    broken = made.withColumn(
        "formatted", F.when(F.col("example") > 0, F.upper("formatted")).otherwise(F.col("formatted"))
    )
    right, wrong = chat.read_back(made).first(), chat.read_back(broken).first()
    assert wrong["loss_sha256"] != right["loss_sha256"]
    assert wrong["turns_sha256"] == right["turns_sha256"]


def test_chats_of_the_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows.collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in queries.op6(spark, SF_DIR).collect()
    }
    assert got == python_chat(rows)


def edited_texts(rows):
    """Edited text by (id, text), ids down, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        cut = len(text) // 3
        out.append((doc, len(text), sha(text[: len(text) - cut] + after[:cut])))
    return out


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(3, "one two three four five six seven eight nine ten eleven twelve")],
        [(i, f"é😀 text {i} " * (i % 50)) for i in range(300)],
        [(1, None), (2, ""), (5, "short"), (None, "no id at all"), (9, "long " * 30_000)],
    ],
)
def test_edited_texts(spark, rows):
    made = fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    got = [(r["doc_id"], r["n_chars"], sha(r["edited_text"])) for r in made]
    assert sorted(got, key=repr) == sorted(edited_texts(rows), key=repr)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in made)


def test_fingerprints_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    made = queries.op10(spark, SF_DIR).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in made) == sorted(edited_texts(rows))
    prints, texts = {r["doc_id"]: r["fingerprint"] for r in made}, dict(rows)
    by_text = {}
    for doc, text in texts.items():
        by_text.setdefault(text, set()).add(prints[doc])
    assert all(len(p) == 1 for p in by_text.values())
    long = [r["near_edited"] for r in made if r["n_chars"] >= 1000]
    assert min(long) > 0.3



def check_short(made, rows):
    """Texts of ten pieces or more keep anchors when their last third changes."""
    pieces = {d: len(re.findall(r"[^ \t-\r]{1,4}", t or "")) for d, t in rows}
    short = [r for r in made if pieces[r["doc_id"]] >= 10 and r["n_chars"] < 1000]
    assert len(short) > 50
    assert [r["doc_id"] for r in short if r["near_edited"] <= r["near_next"] < 1] == []
    assert [r["doc_id"] for r in short if r["near_edited"] == 0] == []


def test_short_documents_of_the_table_are_near_their_edits(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_short(queries.op10(spark, SF_DIR).collect(), rows)


def test_short_texts_are_near_their_edits(spark):
    rows = [(i, " ".join(f"w{i}{j}" for j in range(10 + i % 15))) for i in range(10, 90)]
    check_short(fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect(), rows)


def test_repeats_count_in_likeness(spark):
    frame = spark.createDataFrame(
        [([5, 5, 5, -1], [5, 5, 7]), ([], []), ([1], []), ([-1, -1], [-1, -1])], "a array<int>, b array<int>"
    )
    got = [r[0] for r in frame.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == [2 / 5, 1.0, 0.0, 1.0]


def test_anchors_are_context_free(spark):
    middle = " ".join(f"word{i}" for i in range(200))
    rows = [(0, middle), (1, "some other start " + middle + " and an end")]
    frame = spark.createDataFrame(rows, DOCS).select(fingerprints.anchors(F.col("text")).alias("a"))
    inner, outer = (set(r["a"]) for r in frame.collect())
    assert inner <= outer and len(inner) > 20
