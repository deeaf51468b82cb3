"""Counts of the features of documents, taken where a document lies.

Rows of one key are sorted next to one another, and a task counts the features
of some megabytes of text at a time, so no table of counts is grouped, shuffled
or spilled. Each distinct word, n-gram and run of words of such a chunk is named
or hashed once; what is counted are places in the list of these names, and pairs
of a document and a place are counted by sorting them as numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from math import sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textvariety.operators.feature_blocks import runs_of_blocks, words_of

# Rows and bytes of text of a chunk, features that are sorted at once unless a
# document has more, and counts given at once.
ROWS, CHUNK_BYTES, SORTED_AT_ONCE, COUNTS_AT_ONCE = 10_000, 8 << 20, 1 << 18, 1 << 18
# Strings hashed at once, and the most bytes that md5 takes in one block.
HASHED_AT_ONCE, ONE_BLOCK = 1 << 13, 55
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_ADDED = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_PLACES = [(m * i + n) % 16 for r, (m, n) in enumerate(((1, 0), (5, 1), (3, 5), (7, 0))) for i in range(16 * r, 16 * r + 16)]


def bucket_of(feature: str, bucket: int) -> int:
    """As functions.features.feature_bucket."""
    return int(_buckets_of(pa.array([feature]), bucket)[0])


def _buckets_of(features: pa.Array, bucket: int) -> np.ndarray:
    """The bucket of each string."""
    features = features.cast(pa.large_binary())
    sizes = pc.binary_length(features).to_numpy()
    heads = np.empty(len(features), np.uint32)
    for start in range(0, len(features), HASHED_AT_ONCE):
        here = slice(start, start + HASHED_AT_ONCE)
        heads[here] = _md5_heads(features[here], sizes[here])
    for i in np.flatnonzero(sizes > ONE_BLOCK).tolist():
        digest = md5(features[i].as_py(), usedforsecurity=False).digest()
        heads[i] = int.from_bytes(digest[:4], "big")
    return heads.astype(np.int64) % bucket


def _md5_heads(features: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The leading 32 bits of the md5 of each string of at most ONE_BLOCK bytes,
    by the 64 steps of RFC 1321 on all of them at once; of others, anything."""
    count, kept = len(sizes), np.minimum(sizes, ONE_BLOCK)
    begins = np.frombuffer(features.buffers()[1], np.int64, count, 8 * features.offset)
    data = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    rows = np.arange(count) * 64
    at = np.repeat(begins - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())
    block = np.zeros(count * 64, np.uint8)
    block[np.repeat(rows - begins, kept) + at] = data[at]
    block[rows + kept] = 0x80
    words = np.ascontiguousarray(block.view("<u4").reshape(count, 16).T)
    words[14] = kept * 8
    a, b, c, d = (np.full(count, x, np.uint32) for x in MD5_START)
    f, g = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        turn = MD5_TURNS[i // 16][i % 4]
        f += a
        f += words[MD5_PLACES[i]]
        f += MD5_ADDED[i]
        np.left_shift(f, np.uint32(turn), g)
        f >>= np.uint32(32 - turn)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(MD5_START[0])
    return a.byteswap()


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and each value's place among them."""
    told = pa.array(values).dictionary_encode()
    return told.dictionary.to_numpy(), told.indices.to_numpy()


def _longer(shorter: pa.Array, ends: pa.Array, values: np.ndarray, mark: str) -> pa.Array:
    """Names of values that are place in `shorter` * len(ends) + place in `ends`."""
    first, last = np.divmod(values, len(ends))
    return pc.binary_join_element_wise(shorter.take(pa.array(first)), ends.take(pa.array(last)), mark)


def _char_grams(
    words: pa.Array, minn: int, maxn: int
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """As functions.features.char_ngrams, for each length: the distinct n-grams,
    the places of those of all words among them, how many each word has."""
    if maxn < 1:
        return
    marked = [f"<{w}>" for w in words.to_pylist()]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    points, chars = _distinct(np.frombuffer("".join(marked).encode("utf-32-le"), "<u4"))
    names = letters = pa.array(map(chr, points.tolist()), pa.string())
    chars, ends = chars.astype(np.int64), np.cumsum(sizes)
    at = np.arange(len(chars))
    left = np.repeat(ends, sizes) - at
    if minn <= 1:
        inside = (left > 1) & (left < np.repeat(sizes, sizes))
        yield letters, chars[inside], sizes - 2
    grams = chars
    for n in range(2, maxn + 1):
        fits = left[at] >= n
        at, grams = at[fits], grams[fits]
        values, grams = _distinct(grams * len(letters) + chars[at + n - 1])
        names, grams = _longer(names, letters, values, ""), grams.astype(np.int64)
        if n >= minn:
            yield names, grams, np.maximum(sizes - (n - 1), 0)


def _word_runs(
    words: pa.Array, ids: np.ndarray, row: np.ndarray, word_n: int
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each length from 2: the distinct runs of words within a row, the places
    of all runs among them, where they start."""
    names, runs, at = words, ids, np.arange(len(ids))
    for n in range(2, word_n + 1):
        fits = at < len(ids) - (n - 1)
        at, runs = at[fits], runs[fits]
        fits = row[at] == row[at + n - 1]
        at, runs = at[fits], runs[fits]
        values, runs = _distinct(runs * len(words) + ids[at + n - 1])
        names, runs = _longer(names, words, values, " "), runs.astype(np.int64)
        yield names, runs, at


def _starts(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal sorted values start."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


@dataclass
class _Features:
    """What to count: words by name, n-grams by bucket."""

    word_n: int
    minn: int
    maxn: int
    bucket: int

    def counts(
        self, texts: pa.Array, doc: np.ndarray, known: pa.Array | None
    ) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(names, document, place in names, n) of some documents after others;
        `doc` has the number of each text's document, in order."""
        row, flat = words_of(texts)
        told = flat.dictionary_encode()
        words, ids = told.dictionary, told.indices.to_numpy().astype(np.int64)
        if not len(ids):
            return
        many = len(words).bit_length()
        pairs = np.sort((doc[row] << many) + ids)
        starts = _starts(pairs)
        times = np.diff(np.r_[starts, len(pairs)])
        whose, which = pairs[starts] >> many, pairs[starts] & ((1 << many) - 1)
        named = np.ones(len(words), bool)
        if known is not None:
            named = pc.is_in(words, value_set=known).to_numpy(zero_copy_only=False)

        grams = list(_char_grams(words, self.minn, self.maxn))
        runs = list(_word_runs(words, ids, row, self.word_n))
        hashed = [_buckets_of(x[0], self.bucket) for x in (*grams, *runs)]
        buckets, at = _distinct(np.concatenate([np.zeros(0, np.int64), *hashed]))
        names = pc.binary_join_element_wise("# ", pa.array(buckets).cast(pa.string()), "")
        names = pa.concat_arrays([words, names])
        # A number holds document, place of the bucket, and how often it is met.
        bits = int(times.max()).bit_length()
        wide = bits + len(buckets).bit_length()
        at = np.split(at.astype(np.int64) << bits, np.cumsum([len(h) for h in hashed])[:-1])
        of_words = [(a[x[1]], np.cumsum(x[2]) - x[2], x[2]) for a, x in zip(at, grams)]
        of_rows = [(a[x[1]] + 1, doc[row[x[2]]]) for a, x in zip(at[len(grams) :], runs)]

        last = int(whose[-1]) + 1
        load = np.bincount(whose, weights=sum((n[which] for *_, n in of_words), np.zeros(len(which))), minlength=last)
        for _, docs in of_rows:
            load += np.bincount(docs, minlength=last)
        part = np.cumsum(load) // SORTED_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), last]
        for low, high in zip(cuts, cuts[1:]):
            here = slice(*np.searchsorted(whose, (low, high)))
            doc_here, word, n = whose[here], which[here], times[here]
            heads, met = ((doc_here - low) << wide) + n, []
            for places, firsts, counts in of_words:
                count = counts[word]
                ends = np.cumsum(count)
                begin = np.repeat(firsts[word] - (ends - count), count)
                begin += np.arange(len(begin))
                met.append(places[begin])
                met[-1] += np.repeat(heads, count)
            for places, docs in of_rows:
                mine = slice(*np.searchsorted(docs, (low, high)))
                met.append(((docs[mine] - low) << wide) + places[mine])
            by_name = named[word]
            out = [doc_here[by_name]], [word[by_name]], [n[by_name]]
            if met:
                met = np.concatenate(met)
                met.sort()
                every = met >> bits
                starts = _starts(every)
                if len(starts):
                    each = every[starts]
                    docs, places = each >> (wide - bits), each & ((1 << (wide - bits)) - 1)
                    sums = np.add.reduceat(met & ((1 << bits) - 1), starts)
                    for whole, some in zip(out, (docs + low, places + len(words), sums)):
                        whole.append(some)
            yield names, *(np.concatenate(x) for x in out)


def _alike(a, b) -> bool:
    return a == b or (a != a and b != b)


def _batch(keys: pa.Array, features: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, features, pa.array(counts, pa.int64())], ["key", "feature", "n"])


class _Counts:
    """Counts of the keys of one block, in order. Those of a chunk's last key are
    kept, since the next chunk may go on with it."""

    def __init__(self, features: _Features, known: pa.Array | None):
        self.features, self.known = features, known
        self.key, self.kept = None, Counter()

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key")
        told = keys.to_pylist()
        new = [i > 0 and not _alike(told[i - 1], key) for i, key in enumerate(told)]
        doc = np.cumsum(np.array(new, np.int64))
        last = int(doc[-1])
        goes_on = bool(self.kept) and _alike(self.key, told[0])
        if not goes_on:
            yield from self.end(keys.type)
        first, final = self.kept, Counter()
        heads = keys.take(pa.array(np.flatnonzero(np.r_[True, np.diff(doc) > 0])))
        for names, docs, places, n in self.features.counts(rows.column("text"), doc, self.known):
            apart = docs == last
            if goes_on:
                apart |= docs == 0
            for d, name, count in zip(
                docs[apart].tolist(), names.take(pa.array(places[apart])).to_pylist(), n[apart].tolist()
            ):
                (first if goes_on and d == 0 else final)[name] += count
            rest = np.flatnonzero(~apart)
            for start in range(0, len(rest), COUNTS_AT_ONCE):
                some = rest[start : start + COUNTS_AT_ONCE]
                yield _batch(
                    heads.take(pa.array(docs[some])), names.take(pa.array(places[some])), n[some]
                )
        if not goes_on or last > 0:
            if goes_on:
                yield from self.end(keys.type)
            self.key, self.kept = told[-1], final

    def end(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The counts of the key that is kept."""
        names, counts = list(self.kept), list(self.kept.values())
        key, self.kept = pa.array([self.key], kind), Counter()
        for start in range(0, len(names), COUNTS_AT_ONCE):
            some = slice(start, start + COUNTS_AT_ONCE)
            at = pa.array(np.zeros(len(names[some]), np.int64))
            yield _batch(key.take(at), pa.array(names[some], pa.string()), np.array(counts[some], np.int64))


def _chunks(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_pylist()
    start, size = 0, 0
    for i, more in enumerate(sizes):
        if i > start and (i - start >= ROWS or size + more > CHUNK_BYTES):
            yield rows.slice(start, i - start)
            start, size = i, 0
        size += more
    if len(rows):
        yield rows.slice(start)


def count_features(
    batches: Iterator[pa.RecordBatch], named: bool, word_n: int, minn: int, maxn: int, bucket: int
) -> Iterator[pa.RecordBatch]:
    """(key, feature, n) from rows sorted by block, side and key: a block's words
    to name (side 0) if `named`, else all are, before its texts (side 1)."""
    features = _Features(word_n, minn, maxn, bucket)
    block, known, made, kind = None, [], None, None
    for place, side, rows in runs_of_blocks(batches):
        if place != block:
            if made is not None:
                yield from made.end(kind)
            block, known, made, kind = place, [], None, rows.schema.field("key").type
        if side == 0:
            known.append(rows.column("feature"))
            continue
        if made is None:
            listed = pa.concat_arrays([pa.array([], pa.string()), *known]) if named else None
            made, known = _Counts(features, listed), []
        for chunk in _chunks(rows):
            yield from made.add(chunk)
    if made is not None:
        yield from made.end(kind)
