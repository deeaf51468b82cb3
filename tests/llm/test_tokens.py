"""Encoding next to the tokenizer libraries; round trips of the token files."""

import base64
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from textvariety.llm import bpe, queries, token_files
from textvariety.llm.chunks import Cache
from tests.llm.helpers import sha

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "x\ty  z", "don't I'll 'S",
    "é😀 ½²x٣", "<|endoftext|> hi", "a<|endoftext|>b", "x <|endoftext|> y",
    "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n b", "a" * 5000, "ab" * 3000 + " " + "1" * 3000,
    " a   b\x1c c\x85d \x1f e", "é 日本語 テスト  한국어", "a\r\n\r\n  b", "same text", "same text",
    "a b " * 150_000,
]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(frame, library):
    texts = dict(frame.select("doc_id", "text").collect())
    got = bpe.digests(bpe.encode(frame, RANKS, public_tokenizers.PATTERN, "doc_id")).collect()
    assert len(got) == frame.count()
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids), text[:50]
        assert r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(text)


def test_bpe_of_odd_texts(spark, library):
    check_bpe(spark.createDataFrame(list(enumerate(ODD)), DOCS), library)


def test_bpe_of_the_table(spark, library):
    check_bpe(spark.read.parquet(f"{SF_DIR}/documents.parquet"), library)


def test_bpe_of_nothing(spark, library):
    check_bpe(spark.createDataFrame([], DOCS), library)


def test_merges_that_make_way_for_lower_ones():
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {b"ab": 300, b"abc": 256, b"cab": 257, b"aa": 258, b"aaa": 259}
    words = [b"abcabcab", b"aaaaaaa", b"cababab", b"abab", b"x", b"abaab" * 50]
    got = bpe.replay_merges(words, bpe.Merges(ranks))
    assert [w.tolist() for w in got] == [bpe.merge_one(w, ranks) for w in words]


def check_files(frame, path):
    tokenizer = Tokenizer.from_file(TOKENIZER)

    token_files.write_tokens(frame, TOKENIZER, path)
    got = token_files.token_report(token_files.read_tokens(frame.sparkSession, path)).collect()
    rows = sorted(frame.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_files_of_odd_texts(spark, tmp_path):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(ODD)]
    check_files(spark.createDataFrame(rows, DOCS), f"{tmp_path}/odd")


def test_files_of_the_table(spark, tmp_path):
    check_files(spark.read.parquet(f"{SF_DIR}/documents.parquet"), f"{tmp_path}/docs")


def test_files_of_nothing(spark, tmp_path):
    check_files(spark.createDataFrame([], DOCS), f"{tmp_path}/none")


def test_queries_have_all_rows(spark):
    assert queries.op7(spark, SF_DIR).count() == queries.op9(spark, SF_DIR).count() == 1000


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 65_536, 65_537, 200_000])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 999).astype("<u4")
    table = token_files.normalise(np.bincount(ids, minlength=1000))
    codec = token_files.Codec(table)
    made = codec.encode(ids)
    assert (codec.decode(n, *made) == ids).all()
    if n > 1000:
        share = np.bincount(ids) / n
        bits = -(share[share > 0] * np.log2(share[share > 0])).sum()
        assert 8 * len(made[0]) < 1.02 * bits * n + 64 * token_files.LANES
        words = bytearray(made[0])
        words[len(words) // 2] ^= 1
        with pytest.raises(ValueError):
            codec.decode(n, bytes(words), *made[1:])


def test_one_kind_of_id():
    ids = np.full(1000, 7, "<u4")
    codec = token_files.Codec(token_files.normalise(np.bincount(ids)))
    assert (codec.decode(1000, *codec.encode(ids)) == ids).all()


def test_crc32_combine():
    a, b = b"some bytes", b"others" * 1000
    assert token_files.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_files.crc32_combine(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_a_cache_that_forgets_gives_the_same_ids():
    tokenizer = Tokenizer.from_file(TOKENIZER)

    cache = Cache(token_files._chunk_encoder(TOKENIZER), most=5)
    texts = [t or "" for t in ODD[:-1]] + ["word. word, word! Word's wörd. x.y. 1. a.. ɒ."] * 2
    for _ in range(3):
        for part in (texts[::2], texts[1::2], texts):
            got = [np.frombuffer(i, "<u4").tolist() for i in cache.encode(part)]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
    assert len(cache._before) + len(cache._inner) < 200


def test_a_task_takes_a_few_texts_at_a_time(monkeypatch):
    import types

    import pyarrow as pa

    from textvariety.llm import chunks, token_files

    seen, encode = [], chunks.Cache.encode

    def watched(self, texts):
        seen.append(len(texts))
        return encode(self, texts)

    monkeypatch.setattr(chunks.Cache, "encode", watched)
    monkeypatch.setattr(token_files, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": [f"a text {i}" for i in range(2500)]})
    path = public_tokenizers.path("byte_bpe_50k.json")
    blocks = list(token_files._tokenised(iter([batch]), path, token_files.END_ID))
    assert sum(len(d) for b in blocks for d in b.column("doc_id").to_pylist()) == 2500
    assert max(seen) <= token_files.ROWS


def _tokenised_here(monkeypatch, texts):
    import types

    import pyarrow as pa

    monkeypatch.setattr(token_files, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    return list(token_files._tokenised(iter([batch]), TOKENIZER, token_files.END_ID))


def test_a_worker_keeps_few_of_many_chunks(monkeypatch):
    from textvariety.llm import chunks

    made = []
    monkeypatch.setattr(chunks, "of_worker", lambda name, make: made.append(make()) or made[-1])
    monkeypatch.setattr(token_files, "of_worker", chunks.of_worker)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(5000)]
    blocks = _tokenised_here(monkeypatch, texts)
    assert sum(len(d) for b in blocks for d in b.column("doc_id").to_pylist()) == 5000
    cache = made[1]
    # Of 300,000 chunks: two generations, and what a stretch of 60,000 adds to each.
    assert len(cache._inner) + len(cache._before) <= 2 * (token_files.KEPT_CHUNKS + 60_000) < 300_000


def test_blocks_are_coded_and_decoded_one_at_a_time(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 16)
    blocks = _tokenised_here(monkeypatch, ["some text " * 10, "another " * 30, "", "a third of them " * 8])
    assert len(blocks) > 3
    import pyarrow as pa

    whole = pa.Table.from_batches(blocks).combine_chunks().to_batches()
    (counts,) = token_files._counted(iter(whole))
    table = np.zeros(max(counts.column("id").to_pylist()) + 1, np.int64)
    table[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    coded = list(token_files._coded(iter(whole), token_files.normalise(table)))
    assert [len(c) for c in coded] == [1] * len(blocks)
    read = list(token_files._decoded(iter(pa.Table.from_batches(coded).combine_chunks().to_batches()), token_files.normalise(table)))
    assert b"".join(i for b in read for i in b.column("ids").to_pylist()) == b"".join(b.column("ids")[0].as_py() for b in blocks)


def test_words_are_cut_once_for_a_stretch_whatever_follows_them():
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["", " ", "a", " a", "a  b c", "x\n y", "y \n", "\u00a0z z\u00a0 q", "a b c a b c.", "\x1cd d\x1c d"]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), texts):
        cache = Cache(token_files._chunk_encoder(TOKENIZER))
        got = [np.frombuffer(i, "<u4").tolist() for i in cache.encode(column)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
