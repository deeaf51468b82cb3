"""Byte-level BPE by replaying the merges over a corpus of distinct words.

The distinct words of a stretch of the corpus are written out symbol after
symbol. An inverted index keeps, for every merge, the places where its pair
stands. Merges are applied in order of rank, each at all its places at once, and
touch only those places and the pairs next to them. As words do not depend on
one another, a stretch gives the ids that the whole corpus would give.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.llm.chunks import Cache, give_back, of_worker
from textvariety.llm.common import pick

_SHIFT = 24  # room for a token id in the key of a pair
ROWS = 2000  # rows whose texts are Python strings at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of a rank file; the rank is the id as well."""
    with open(path, "rb") as lines:
        parts = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in parts}


class Merges:
    """Every pair of tokens that merges into a token, for look-up in bulk."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (ranks[t[:i]] << _SHIFT | ranks[t[i:]], rank)
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        pairs.sort()
        self.ranks = ranks
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.merged = np.array([r for _, r in pairs] or [-1], np.int32)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; -1 for none."""
        key = a.astype(np.int64) << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted places, those left when the one before took its neighbour."""
    taken = np.isin(after, at)
    if not taken.any():
        return at
    kept, gone = [], set()
    for here, following in zip(at.tolist(), after.tolist()):
        if here not in gone:
            kept.append(here)
            gone.add(following)
    return np.array(kept, at.dtype)


def merge_one(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by its definition: the lowest, leftmost pair first."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        pairs = [ranks.get(a + b, len(ranks) + 256) for a, b in zip(parts, parts[1:])]
        i = min(range(len(pairs)), key=pairs.__getitem__)
        if parts[i] + parts[i + 1] not in ranks:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def replay_merges(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """Ids of each word; no word may be empty.

    `left` and `right` link a symbol to its neighbours in the word, -1 at its
    ends; `pair` is the rank of the merge that starts at a symbol. A merge that
    makes way for one of lower rank could meet the places of its own rank in
    another order, so such words, hardly any, are merged one pair at a time.
    """
    if not words:
        return []
    symbol = merges.bytes[np.frombuffer(b"".join(words), np.uint8)]
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    left = np.arange(-1, len(symbol) - 1)
    right = np.arange(1, len(symbol) + 1)
    left[end - size], right[end - 1] = -1, -1
    pair = np.full(len(symbol), -1, np.int32)
    places: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []
    odd: list[np.ndarray] = []

    def note(at: np.ndarray) -> np.ndarray:
        """File the pairs that start at these symbols; returns their ranks."""
        after = right[at]
        rank = merges.rank(symbol[at], symbol[after])
        rank[after < 0] = -1
        pair[at] = rank
        able = rank >= 0
        at, rank = at[able], rank[able]
        if len(at):
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heapq.heappush(waiting, r)
        return rank

    note(np.flatnonzero(right >= 0))
    while waiting:
        rank = heapq.heappop(waiting)
        found = places.pop(rank)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        # A merge of lower rank may have broken a pair since it was filed.
        at = at[pair[at] == rank]
        if not len(at):
            continue
        at = _apart(at, right[at])
        gone = right[at]
        after = right[gone]
        symbol[at], symbol[gone], pair[gone] = rank, -1, -1
        right[at] = after
        inside = after >= 0
        left[after[inside]] = at[inside]
        before = left[at]
        changed = np.unique(np.concatenate((at, before[before >= 0])))
        lowered = note(changed)
        if len(lowered) and lowered.min() < rank:
            odd.append(changed)
    alive = symbol >= 0
    counts = np.add.reduceat(alive.astype(np.int64), end - size)
    out = np.split(symbol[alive], np.cumsum(counts)[:-1])
    if odd:
        for i in np.unique(np.searchsorted(end, np.concatenate(odd), "right")).tolist():
            out[i] = np.array(merge_one(words[i], merges.ranks), np.int32)
    return out


def encoder(ranks: dict[bytes, int], pattern: str):
    """A function from chunks to their ids: the pattern cuts words, which merge."""
    import regex

    find = regex.compile(pattern).findall
    merges = Merges(ranks)

    def encode(chunks: list[str]) -> list[bytes]:
        cut = [find(c) for c in chunks]
        words = sorted(set(chain.from_iterable(cut)))
        raw = [w.encode() for w in words]
        known = {w: ranks[r].to_bytes(4, "little") for w, r in zip(words, raw) if r in ranks}
        rest = [(w, r) for w, r in zip(words, raw) if w not in known]
        merged = replay_merges([r for _, r in rest], merges)
        known.update((w, ids.astype("<i4").tobytes()) for (w, _), ids in zip(rest, merged))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    return encode


def _encode(
    batches: Iterator[pa.RecordBatch], path: str, pattern: str
) -> Iterator[pa.RecordBatch]:
    def make():
        ranks = read_ranks(path)
        return encoder(ranks, pattern), {rank: t for t, rank in ranks.items()}

    encode_chunks, tokens = of_worker(f"bpe {path} {pattern}", make)
    # Known chunks go with the task, so that later stages have their memory.
    cache = Cache(encode_chunks)
    for whole in batches:
        # Texts become Python strings a slice at a time.
        for start in range(0, len(whole), ROWS):
            yield from _encode_slice(whole.slice(start, ROWS), cache, tokens)
    give_back()


def _encode_slice(
    batch: pa.RecordBatch, cache: Cache, tokens: dict[int, bytes]
) -> Iterator[pa.RecordBatch]:
    kept = [n for n in batch.schema.names if n != "text"]
    rows = batch.select(kept)
    done = 0
    for part in _parts(cache.encode(batch.column("text").to_pylist())):
        ids = np.frombuffer(b"".join(part), "<i4")
        ends = np.cumsum([0] + [len(p) // 4 for p in part]).astype(np.int32)
        texts = [
            hashlib.sha256(decode(np.frombuffer(p, "<i4").tolist(), tokens)).hexdigest()
            for p in part
        ]
        yield pa.RecordBatch.from_arrays(
            [
                *rows.slice(done, len(part)).columns,
                pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                pa.array(texts, pa.string()),
            ],
            [*kept, "ids", "decoded_sha256"],
        )
        done += len(part)


def _parts(rows: Iterator[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Rows of about `most` bytes at a time."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """The columns `keep` of every row, `ids` (an int array) of its whole text and
    `decoded_sha256`, the digest of the bytes those ids decode to.

    `path` is a rank file every executor can read, `pattern` cuts the words.
    Null texts count as empty and have no ids; rows are never merged or dropped,
    and nothing is shuffled. Special tokens' names are ordinary text. A task
    holds an Arrow batch and the distinct chunks its worker has met lately.
    """
    rows = pick(docs, *dict.fromkeys((*keep, "text")))
    whole = rows.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in whole.drop("text").dtypes)
    return whole.mapInArrow(
        partial(_encode, path=path, pattern=pattern),
        f"{schema}, ids array<int>, decoded_sha256 string",
    )


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `encode`'s rows."""
    told = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(told, 256).alias("ids_sha256"),
        "decoded_sha256",
    )


def decode(ids: list[int], tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))
