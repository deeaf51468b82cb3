"""Token ids in files, entropy-coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, codes all blocks. A block is
coded by LANES interleaved states, stands for itself, and keeps a checkpoint
(all states, and the place in its words) and a checksum for every segment, so
segments can be decoded side by side or alone.

A token file set is a folder of two Parquet tables: `table` holds the normalised
frequencies, `blocks` a row for each block with its documents. Parquet carries
the bytes because Spark reads and writes it on any store.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textvariety.llm.chunks import Cache, give_back, loose, of_worker
from textvariety.llm.common import pick
from textvariety.sources.scratch import store

# Fixed value: the id that ends a document.
END_ID = 2
LANES, SEGMENT_STEPS, BLOCK_IDS = 512, 128, 1 << 18
SCALE_BITS = 20
# Chunks of a generation that a worker keeps. Most chunks occur once, so more
# would take memory and spare hardly any encoding.
KEPT_CHUNKS = 60_000
ROWS = 1000  # rows whose texts are cut at a time
_PLAIN = re.compile(r"(?: \S++)++")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def normalise(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    room = 1 << bits
    some = counts > 0
    assert some.sum() <= room, "more ids than the table has room for"
    spare = room - int(some.sum())
    out = some + (counts.astype(np.float64) * (spare / total)).astype(np.int64)
    out[int(np.argmax(counts))] += room - int(out.sum())
    return out


class Codec:
    """Codes blocks of ids by a table of normalised frequencies."""

    def __init__(self, frequencies: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.size = frequencies.astype(np.uint64)
        self.start = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)
        self.mask = np.uint64((1 << bits) - 1)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, list[int], list[int]]:
        """(words, states, offsets, checksums) of a block.

        Id i is coded by lane i % LANES in step i // LANES. Steps go backwards,
        so that they can be decoded forwards.
        """
        steps = -(-len(ids) // LANES)
        x = np.full(LANES, _LOW, np.uint64)
        size, start = self.size[ids], self.start[ids]
        most = size << (np.uint64(63) - self.bits)
        words: list[np.ndarray] = [np.zeros(0, "<u4")] * steps
        states = []
        for t in range(steps - 1, -1, -1):
            here = slice(t * LANES, min((t + 1) * LANES, len(ids)))
            y, f = x[: here.stop - here.start], size[here]
            full = y >= most[here]
            words[t] = (y[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            y = np.where(full, y >> _WORD, y)
            high, low = np.divmod(y, f)
            x[: len(y)] = (high << self.bits) + low + start[here]
            if t % SEGMENT_STEPS == 0:
                states.append(x.astype("<u8").tobytes())
        before = np.cumsum([0] + [len(w) for w in words])
        segment = SEGMENT_STEPS * LANES
        checks = [zlib.crc32(ids[i : i + segment].astype("<u4").tobytes()) for i in range(0, len(ids), segment)]
        return (
            b"".join(w.tobytes() for w in words),
            b"".join(reversed(states)),
            before[:-1:SEGMENT_STEPS].tolist(),
            checks,
        )

    def decode(self, n: int, words: bytes, states: bytes, offsets: list[int], checksums: list[int]) -> np.ndarray:
        """All segments of a block, each from its checkpoint, step by step
        together. Raises ValueError where a checksum differs."""
        if not n:
            return np.zeros(0, np.uint32)
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        stream = stream if len(stream) else np.zeros(1, np.uint64)
        count = len(offsets)
        x = np.frombuffer(states, "<u8").reshape(count, LANES).astype(np.uint64)
        at = np.array(offsets, np.int64)
        segment = SEGMENT_STEPS * LANES
        out = np.zeros((count, SEGMENT_STEPS, LANES), np.uint32)
        left = np.minimum(n - np.arange(count) * segment, segment)
        lanes = np.arange(LANES)
        for t in range(min(SEGMENT_STEPS, -(-int(left.max()) // LANES))):
            active = t * LANES + lanes < left[:, None]
            slot = x & self.mask
            symbol = self.symbol[slot]
            out[:, t] = symbol
            y = self.size[symbol] * (x >> self.bits) + slot - self.start[symbol]
            short = (y < _LOW) & active
            rank = np.cumsum(short, axis=1)
            # A damaged stream may ask for more words than there are.
            place = np.minimum(at[:, None] + rank - 1, len(stream) - 1)
            if short.any():
                y = np.where(short, y << _WORD | stream[place], y)
            x = np.where(active, y, x)
            at += rank[:, -1]
        ids = out.reshape(-1)[:n]
        for i, check in enumerate(checksums):
            if zlib.crc32(ids[i * segment : (i + 1) * segment].astype("<u4").tobytes()) != check:
                raise ValueError(f"segment {i} of a block of {n} ids does not match its checksum")
        return ids


def crc32_combine(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings after each other; `length` is of the second.

    Appending zero bytes is linear over GF(2): its matrix is squared for every
    bit of the length.
    """

    def apply(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    bit = [0xEDB88320, *(1 << i for i in range(31))]
    matrix = bit
    for _ in range(3):
        matrix = [apply(matrix, column) for column in matrix]
    while length:
        if length & 1:
            first = apply(matrix, first)
        matrix = [apply(matrix, column) for column in matrix]
        length >>= 1
    return first ^ second


_BLOCKS = (
    "part int, block int, before long, n long, doc_no array<long>, doc_id array<bigint>,"
    " sizes array<long>, ids binary"
)


def _chunk_encoder(path: str):
    """A function from chunks to their ids as bytes, little-endian.

    Chunks that start with their only blank are encoded many at a time as one
    text: there, a token starts with a blank just where a chunk does. The rest
    is encoded one by one, a few at a time, for their memory.
    """
    os.environ.update(TOKENIZERS_PARALLELISM="false", RAYON_NUM_THREADS="1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    opens = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        opens[i] = token.startswith("\u0120")

    def one_by_one(chunks: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def together(chunks: list[str]) -> list[bytes]:
        (found,) = tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        at = np.flatnonzero(opens[ids])
        if len(at) != len(chunks):
            return one_by_one(chunks)
        raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
        return [raw[s:e] for s, e in zip((4 * at).tolist(), ends)]

    def all_plain(chunks: list[str]) -> bool:
        """Whether every chunk is a blank and a word, without an added token's
        string; seen on their joined text, without a look at each."""
        joined = "".join(chunks)
        return (
            _PLAIN.fullmatch(joined) is not None
            and joined.count(" ") == len(chunks)
            and all(c.startswith(" ") for c in chunks)
            and not any(s in joined for s in added)
        )

    def encode(chunks: list[str]) -> list[bytes]:
        if all_plain(chunks):
            return [r for i in range(0, len(chunks), 8192) for r in together(chunks[i : i + 8192])]
        plain = [
            c[:1] == " " and c.count(" ") == 1 and not loose(c[1:]) for c in chunks
        ]
        joined = "\0".join(chunks)
        if any(s in joined for s in added):  # a chunk that holds one goes alone
            plain = [p and not any(s in c for s in added) for p, c in zip(plain, chunks)]
        out: dict[int, bytes] = {}
        for want, size, how in ((True, 8192, together), (False, 1024, one_by_one)):
            at = [i for i, p in enumerate(plain) if p == want]
            for i in range(0, len(at), size):
                part = at[i : i + size]
                out.update(zip(part, how([chunks[k] for k in part])))
        return [out[i] for i in range(len(chunks))]

    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    encode.added = added
    encode.whole = lambda text: one_by_one([text])[0]
    return encode


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of _BLOCKS from texts in order; a document may go on in further blocks."""

    chunks = of_worker(f"chunks {path}", lambda: _chunk_encoder(path))
    cache = of_worker(f"tokenizer {path}", lambda: Cache(chunks, KEPT_CHUNKS))
    part, block, before, doc = TaskContext.get().partitionId(), 0, 0, 0
    end = np.array([end_id], "<u4").tobytes()
    pieces: list[tuple[int, int | None, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = [
            pa.array([part], pa.int32()),
            pa.array([block], pa.int32()),
            pa.array([before], pa.int64()),
            pa.array([size // 4], pa.int64()),
            pa.array([[p[0] for p in pieces]], pa.list_(pa.int64())),
            pa.array([[p[1] for p in pieces]], pa.list_(pa.int64())),
            pa.array([[len(p[2]) // 4 for p in pieces]], pa.list_(pa.int64())),
            pa.array([b"".join(p[2] for p in pieces)], pa.binary()),
        ]
        names = ["part", "block", "before", "n", "doc_no", "doc_id", "sizes", "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    def encoded(texts: pa.Array) -> Iterator[bytes]:
        """Texts that hold an added token's string are encoded whole, as the
        library cuts them there first; the rest chunk by chunk."""
        alone = np.zeros(len(texts), bool)
        for added in chunks.added:
            alone |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        rest = iter(cache.encode(texts.filter(pa.array(~alone)) if alone.any() else texts))
        for i, whole in enumerate(alone.tolist()):
            yield chunks.whole(texts[i].as_py()) if whole else next(rest)

    # A slice of the texts is cut and held in parts at a time.
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
        ids = batch.column("doc_id").to_pylist()
        for doc_id, coded in zip(ids, encoded(batch.column("text"))):
            coded += end
            for i in range(0, len(coded), 4 * BLOCK_IDS):
                piece = coded[i : i + 4 * BLOCK_IDS]
                if size and size + len(piece) > 4 * BLOCK_IDS:
                    yield flush()
                    block, before, pieces, size = block + 1, before + size // 4, [], 0
                pieces.append((doc, doc_id, piece))
                size += len(piece)
            doc += 1
    if pieces:
        yield flush()
        pieces = []
    give_back()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column("ids"):
            more = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"), minlength=len(total))
            more[: len(total)] += total
            total = more
    (some,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks alone, for what Python makes of each."""
    return (batch.slice(i, 1) for batch in batches for i in range(len(batch)))


def _coded(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    codec = Codec(table)
    for batch in _one_by_one(batches):
        made = [codec.encode(np.frombuffer(i.as_buffer(), "<u4")) for i in batch.column("ids")]
        kept = [n for n in batch.schema.names if n != "ids"]
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), *new],
            [*kept, "words", "states", "offsets", "checksums"],
        )
    give_back()


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of all whole texts, each with `end_id` after it, in ascending
    order of doc_id to the folder `path`.

    Null ids come first, equal ids go by the hash of their text; null texts are
    empty and have the end id only; repeated rows are written again; other
    columns are left out. `tokenizer` is a tokenizers file every executor can
    read. The texts are shuffled once, by ranges of ids; the table of counts has
    a row for each id of the vocabulary.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text", doc_id="bigint", text="string")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = store(
        ordered.mapInArrow(partial(_tokenised, path=tokenizer, end_id=end_id), _BLOCKS)
    )
    counts = blocks.select("ids").mapInArrow(_counted, "id long, n long")
    found = counts.groupBy("id").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(max((r["id"] for r in found), default=-1) + 1, np.int64)
    for r in found:
        table[r["id"]] = r["n"]
    table = normalise(table)
    spark.createDataFrame(
        pd.DataFrame({"id": np.arange(len(table)), "frequency": table}), "id long, frequency long"
    ).write.parquet(f"{path}/table")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name != "ids")
    coded = blocks.mapInArrow(
        partial(_coded, table=table),
        f"{schema}, words binary, states binary, offsets array<long>, checksums array<long>",
    )
    coded.write.parquet(f"{path}/blocks")


def _decoded(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    codec = Codec(table)
    for batch in _one_by_one(batches):
        for row in batch.to_pylist():
            ids = codec.decode(row["n"], row["words"], row["states"], row["offsets"], row["checksums"])
            ends = np.cumsum(row["sizes"])
            pieces = [ids[e - s : e].astype("<u4").tobytes() for s, e in zip(row["sizes"], ends)]
            count = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * count, pa.int32()),
                    pa.array([row["block"]] * count, pa.int32()),
                    pa.array(row["before"] + ends - row["sizes"], pa.int64()),
                    pa.array(row["doc_no"], pa.int64()),
                    pa.array(row["doc_id"], pa.int64()),
                    pa.array(pieces, pa.binary()),
                ],
                ["part", "block", "before", "doc_no", "doc_id", "ids"],
            )
    give_back()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, before, doc_no, doc_id, ids) of the pieces of documents.

    `ids` are little-endian 32-bit integers; `before` counts the ids of the part
    that come before the piece. Only documents that did not fit into a block
    have several pieces. Raises on a damaged segment.
    """
    found = spark.read.parquet(f"{path}/table").collect()
    table = np.zeros(len(found), np.int64)
    for r in found:
        table[r["id"]] = r["frequency"]
    return spark.read.parquet(f"{path}/blocks").mapInArrow(
        partial(_decoded, table=table),
        "part int, block int, before long, doc_no long, doc_id bigint, ids binary",
    )


def token_report(pieces: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document that was read."""

    @F.pandas_udf("long")
    def combined(parts: pd.Series) -> pd.Series:
        out = []
        for row in parts:
            crc = 0
            for p in row:
                crc = crc32_combine(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    n = (F.length("ids") / 4).cast("bigint")
    piece = F.struct("block", F.crc32("ids").alias("crc"), n.alias("n"))
    # Stored, as it is used twice: a narrow row for each document.
    docs = store(
        pieces.groupBy("part", "doc_no", "doc_id").agg(
            F.min("before").alias("before"), F.sum(n).alias("n_tokens"),
            F.array_sort(F.collect_list(piece)).alias("pieces"),
        )
    )
    sizes = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each part of the files.
    base = sizes.select(
        "part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base")
    )
    one = F.get(F.col("pieces"), F.lit(0))["crc"]
    several = F.when(F.size("pieces") > 1, F.col("pieces"))
    crc = F.when(F.size("pieces") > 1, combined(F.coalesce(several, F.array().cast(docs.schema["pieces"].dataType)))).otherwise(one)
    return docs.join(F.broadcast(base), "part").select(
        "doc_id",
        (F.col("base") + F.col("before")).alias("start"),
        "n_tokens",
        crc.alias("ids_crc32"),
    )
