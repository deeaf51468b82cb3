"""op12: the prefix-table encoder against the sentencepiece library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from textvariety.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  two  spaces ", "a\tb\nc", "héllo 日本語  x", "x" + " " * 40 + "y", "▁",
    "a▁▁b", " " * 33, "\x00a", "a" * 15, "<s></s><unk>", "🙂🙂 ok", "ｆｕｌｌ", " 日 日  日",
    "word " * 5000, "z" * 30000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encoder_equals_library(library):
    model = pieces.PieceModel(PATH)
    rnd = random.Random(11)
    alphabet = "ab ▁éx\t日🙂.,-_0123\n"
    fuzz = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for text in ODD + fuzz:
        ids = model.encode(text)
        assert ids == library.encode(text), text[:60]
        assert model.decode(ids) == library.decode(ids)


def test_query_equals_library_on_every_document(spark, library):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame(
        [(-i - 1, t, "x", "T") for i, t in enumerate(ODD)] + [(-99, None, None, None)] * 2,
        "doc_id long, text string, lang string, Text string",
    )
    plain = spark.createDataFrame(
        [(-i - 1, t) for i, t in enumerate(ODD)] + [(-99, None)] * 2, "doc_id long, text string"
    )
    every = docs.select("doc_id", "text").unionByName(plain)
    got = {r["doc_id"]: r for r in pieces.digests(pieces.encode(every, PATH, "doc_id")).collect()}
    clashing = pieces.digests(pieces.encode(extra, PATH, "doc_id")).collect()
    assert {r["doc_id"]: r for r in clashing} == {k: v for k, v in got.items() if k < 0}
    rows = every.select("doc_id", "text").collect()
    assert len(got) == len({r["doc_id"] for r in rows})
    for r in rows:
        ids = library.encode(r["text"] or "")
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        mine = got[r["doc_id"]]
        assert (mine["n_tokens"], mine["ids_sha256"], mine["decoded_sha256"]) == (len(ids), want, decoded)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(empty, PATH, "doc_id").count() == 0


def test_segments_that_share_their_start_and_marks(library):
    model = pieces.PieceModel(PATH)
    words = ["abra", "abracadabra", "abracadabra!", "abrac", "ab", "abra.", "abra...", "é漢", "é漢字,", "?!", "."]
    texts = [" ".join(words), *words, "", "  abra  ", "a▁b abra."]
    found = [np.frombuffer(x, "<i4").tolist() for x in model.encode_all(texts)]
    assert found == [library.encode(t) for t in texts]


def test_a_task_decodes_a_few_rows_at_a_time():
    batch = pa.RecordBatch.from_pydict({"text": [f"some text {i}." for i in range(2500)]})
    sizes = [len(out) for out in pieces._encode(iter([batch]), PATH, [])]
    assert sum(sizes) == 2500 and max(sizes) <= pieces.ROWS
