"""Phrase collocations: mergeable Misra-Gries summaries, then exact counts.

Texts are lower-cased (A-Z only), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and
pieces into words `[^\\x20\\x09]+`. Every count is per language (null: `und`).

1. Words are counted exactly (a grouped count; n per language comes from it).
   A phrase cannot occur more often than any of its words, so only runs of
   words that occur `threshold` times can hold a candidate; their 64-bit hashes
   are broadcast, if they are few enough. The texts are stored once more as the
   numbers of these words, with a break where a run ends.
2. Lengths go up one by one, from 2 words to 5. A phrase cannot occur more often
   than the two phrases one word shorter inside of it, so only places where both
   survived the step before are counted. numpy forms a 64-bit key of every such
   phrase; a task counts keys exactly in bounded memory, writes partial counts
   whenever its table is full, and these are stored in the shared scratch folder.
   Keys are cut into B hash buckets. A bucket of mass M (all its occurrences)
   gets a Misra-Gries summary of k = floor(SLACK * M / threshold) + 1 counters.
   Partial counts are merged into it and reduced by the (k+1)-th largest
   counter, which removes at least (k+1) times what any one key loses, so no key
   loses more than D <= M / (k+1) < threshold / SLACK. A counter and the D that
   was really taken add up to at least a key's count: keys where they reach
   `threshold` survive, every phrase of `threshold` occurrences among them.
   Colliding keys only add candidates. B grows with the mass, so a summary holds
   at most twice COUNTERS counters plus one batch.
3. The survivors' phrases are counted exactly in a last pass over the texts,
   grouped by their text. A task counts its phrases and gives them packed, a row
   for each cell of keys; a cell's counts are summed in one place. Up to BROADCAST_KEYS keys are broadcast and tested in the task, more
   are joined by key in Spark.

Scores, cuts, containment and ranks are joins and windows over the candidates.

Defined results: null or empty texts and pieces without words add nothing; a
table without any phrase of `threshold` occurrences gives no rows; repeated rows
count as often as they occur; ties of score and count go to the smaller phrase
in UTF-8 byte order; columns beside `text` and `lang`, also with clashing
names, are ignored; very long texts are handled like short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvariety.llm.chunks import give_back
from textvariety.llm.common import pick
from textvariety.sources.scratch import store

# Fixed by the contract: piece and word breaks, phrase lengths, threshold, top.
PIECE_BREAKS = r"[.,;:!?\x0A-\x0D]"
WORD_BREAKS = r"[\x20\x09]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LONGEST = 2, 5
THRESHOLD = 100
TOP = 2000

# Parameters of the method (not of the result).
COUNTERS = 1 << 20  # counters one bucket's summary is sized for
SLACK = 8  # counters a summary has for each phrase that could reach the threshold
FLUSH = 1 << 21  # keys a task holds before it writes partial counts
BROADCAST_KEYS = 1 << 22  # stored key sets of up to so many are broadcast to tasks
SLICE = 2 << 20  # bytes of text a task splits at a time
CELL_BITS = 12  # keys travel packed by their leading bits
PHRASES = 1 << 17  # phrases a task counts before it gives partial counts
SALTS = 64  # first ranking step: per language and salt


def texts_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text) of every row, nulls filled in."""
    return pick(docs, text, lang).select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(lang, words, piece of each word) of about SLICE bytes of one language."""
    for batch in batches:
        order = pc.array_sort_indices(batch.column("lang"))
        langs = batch.column("lang").take(order).dictionary_encode()
        texts = batch.column("text").take(order)
        codes = langs.indices.to_numpy()
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        places = codes.astype(np.int64) << 32 | size // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield langs[start].as_py(), *_split(texts.slice(start, end - start))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), PIECE_BREAKS).flatten()
    listed = pc.split_pattern_regex(pieces, WORD_BREAKS)
    words, piece = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
    some = pc.binary_length(words).to_numpy() > 0
    return words.filter(pa.array(some)), piece[some]


# Odd 64-bit multipliers of the two independent phrase keys (any odd values do).
_KEY_A = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
          0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_KEY_B = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
          0x1D8E4E27C47D124F, 0xBF58476D1CE4E5B9)


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """64-bit hash of each word together with its language."""
    told = words.dictionary_encode()
    both = pd.util.hash_array(
        np.array([*told.dictionary.to_pylist(), lang], dtype=object), categorize=False
    )
    with np.errstate(over="ignore"):
        hashes = (both[:-1] ^ (both[-1] * np.uint64(_KEY_A[0]))) * np.uint64(_KEY_B[0])
    hashes[hashes == 0] = 1  # 0 stands for a break
    return hashes[told.indices.to_numpy()].view(np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def phrase_positions(values, piece, ok, length):
    """Starts of phrases of `length` words inside one piece, all words frequent,
    and their two keys. Without `piece`, words that are not `ok` part the pieces."""
    m = len(values) - length + 1
    if m <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    good = ok[:m].copy()
    for j in range(1, length):
        good &= ok[j : j + m]
    if piece is not None:
        good &= piece[:m] == piece[length - 1 : length - 1 + m]
    starts = np.flatnonzero(good)
    return starts, *_keys(values, starts, length)


def _keys(values, starts, length):
    """The two keys of the phrases of `length` words at these places."""
    key_a = np.full(len(starts), (_KEY_A[5] * length) % (1 << 64), np.uint64)
    key_b = np.full(len(starts), (_KEY_B[5] * length) % (1 << 64), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            here = values[starts + j]
            key_a += here * np.uint64(_KEY_A[j])
            key_b += here * np.uint64(_KEY_B[j])
    return key_a.view(np.int64), key_b.view(np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys summed; exact in 64 bits."""
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def _coded(frequent):
    """Texts as little-endian 32-bit numbers of their frequent words, from 1 in
    order of the hashes; without `frequent`, as the 64-bit hashes of all words.
    0 is a break; words without a neighbour are left out."""

    def run(batches):
        for lang, words, piece in word_slices(batches):
            hashes = word_hashes(lang, words)
            if frequent is None:
                codes = hashes
            else:
                known = frequent.value
                codes = np.where(_among(hashes, known), np.searchsorted(known, hashes) + 1, 0)
            ok = codes != 0
            linked = ok[1:] & ok[:-1] & (piece[1:] == piece[:-1])
            kept = np.r_[linked, False] | np.r_[False, linked]
            # A break before each run but the first.
            first = kept & ~np.r_[False, linked]
            (at,) = np.nonzero(kept)
            out = np.insert(codes[at], np.flatnonzero(first[at]), 0)
            if len(out):
                raw = out.astype("<i8" if frequent is None else "<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["codes"])
        give_back()

    return run


def _runs(raw: bytes, frequent):
    """Word hashes of `_coded` texts, and which places hold a word."""
    if frequent is None:
        values = np.frombuffer(raw, "<i8")
        return values.view(np.uint64), values != 0
    codes = np.frombuffer(raw, "<i4")
    return frequent.value[np.maximum(codes - 1, 0)].view(np.uint64), codes != 0


def _partial_counts(frequent, shorter, length):
    """Exact counts of a task's keys of phrases of `length` words, written whenever
    FLUSH are held. `shorter`: the keys of phrases one word shorter that survived."""

    def run(batches):
        held_keys = np.empty(0, np.int64)
        held_counts = np.empty(0, np.int64)
        pending: list[np.ndarray] = []
        waiting = 0

        def table(keys, counts):
            """A row for each cell of the sorted keys."""
            cells = (keys >> (64 - CELL_BITS)) + (1 << (CELL_BITS - 1))
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            ends = [*starts[1:].tolist(), len(keys)]
            parts = [slice(s, e) for s, e in zip(starts.tolist(), ends)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(cells[starts].astype(np.int32)),
                    pa.array(np.add.reduceat(counts, starts)),
                    pa.array([keys[p].astype("<i8").tobytes() for p in parts], pa.binary()),
                    pa.array([counts[p].astype("<i8").tobytes() for p in parts], pa.binary()),
                ],
                ["cell", "mass", "keys", "counts"],
            )

        for raw in (r.as_py() for batch in batches for r in batch.column("codes")):
            values, ok = _runs(raw, frequent)
            if shorter is None:
                keys = phrase_positions(values, None, ok, length)[1]
            else:
                starts, inner, _ = phrase_positions(values, None, ok, length - 1)
                starts = starts[_among(inner, shorter.value)]
                starts = starts[:-1][np.diff(starts) == 1]
                keys = _keys(values, starts, length)[0]
            pending.append(keys)
            waiting += len(keys)
            if waiting < FLUSH:
                continue
            new = np.concatenate(pending)
            pending, waiting = [], 0
            held_keys, held_counts = _merged(
                np.concatenate([held_keys, new]),
                np.concatenate([held_counts, np.ones(len(new), np.int64)]),
            )
            if len(held_keys) >= FLUSH:
                yield table(held_keys, held_counts)
                held_keys, held_counts = np.empty(0, np.int64), np.empty(0, np.int64)
        new = np.concatenate(pending) if pending else np.empty(0, np.int64)
        keys, counts = _merged(
            np.concatenate([held_keys, new]),
            np.concatenate([held_counts, np.ones(len(new), np.int64)]),
        )
        if len(keys):
            yield table(keys, counts)
        give_back()

    return run


def reduce_summary(keys: np.ndarray, counts: np.ndarray, capacity: int):
    """Misra-Gries reduction: merge equal keys, then if more than `capacity`
    counters remain, subtract the (capacity+1)-th largest from all and keep the
    positive ones."""
    return _reduced(keys, counts, capacity)[:2]


def _reduced(keys: np.ndarray, counts: np.ndarray, capacity: int):
    """`reduce_summary` and what was subtracted."""
    keys, counts = _merged(keys, counts)
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
    counts = counts - cut
    alive = counts > 0
    return keys[alive], counts[alive], int(cut)


def _summaries(batches, threshold: int):
    """Keys of the Misra-Gries summary of every bucket in this partition that may
    occur `threshold` times."""
    held: dict[int, list] = {}  # by bucket: keys, counts, their number, what was taken
    for batch in batches:
        buckets, capacity = batch.column("bucket").to_pylist(), batch.column("capacity").to_pylist()
        for i, (b, k) in enumerate(zip(buckets, capacity)):
            state = held.setdefault(b, [[], [], 0, 0])
            state[0].append(np.frombuffer(batch.column("keys")[i].as_py(), "<i8"))
            state[1].append(np.frombuffer(batch.column("counts")[i].as_py(), "<i8"))
            state[2] += len(state[0][-1])
            if state[2] > 2 * k:
                keys, counts, cut = _reduced(np.concatenate(state[0]), np.concatenate(state[1]), k)
                held[b] = [[keys], [counts], len(keys), state[3] + cut]
    for keys, counts, _, taken in held.values():
        keys, counts = _merged(np.concatenate(keys), np.concatenate(counts))
        keys = keys[counts + taken >= threshold]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])


def _counted_words(batches):
    """(lang, phrase, f) of the words of each slice."""
    for lang, words, _ in word_slices(batches):
        told = pc.value_counts(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(told), pa.string()), told.field("values"), told.field("counts")],
            ["lang", "phrase", "f"],
        )


def _hashed_words(batches):
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            words = batch.filter(pc.equal(batch.column("lang"), lang)).column("phrase")
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(lang, words))], ["key"])


def frequent_words(texts: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Stored exact counts (lang, length 1, phrase, f) of words occurring
    `threshold` times, and the total n of word occurrences per language."""
    words = texts.mapInArrow(_counted_words, "lang string, phrase string, f long")
    counted = words.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    counted = store(counted.select("lang", F.lit(1).alias("length"), "phrase", "f"))
    totals = counted.groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    return counted.filter(F.col("f") >= threshold), totals


def _known(table: DataFrame):
    """Broadcast sorted keys of a stored table, unless there are too many."""
    if table.count() > BROADCAST_KEYS:
        return None
    values = np.asarray(table.select("key").toArrow().column(0).to_numpy(), np.int64)
    return table.sparkSession.sparkContext.broadcast(np.unique(values))


def frequent_keys(coded: DataFrame, frequent, threshold: int) -> DataFrame:
    """Keys that include every phrase key of 2 to LONGEST frequent words occurring
    `threshold` times, length by length."""
    survivors = shorter = None
    for length in range(SHORTEST, LONGEST + 1):
        found = _survivors(coded, frequent, shorter, length, threshold)
        survivors = found if survivors is None else survivors.unionByName(found)
        shorter = _known(found)
        if shorter is not None and not len(shorter.value):
            break
    return survivors


def _survivors(coded, frequent, shorter, length, threshold):
    """Stored keys of one length."""
    partial = store(
        coded.mapInArrow(
            _partial_counts(frequent, shorter, length),
            "cell int, mass long, keys binary, counts binary",
        )
    )
    mass = partial.agg(F.sum("mass")).first()[0] or 0
    width = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A cell is not split: beyond 2**CELL_BITS buckets, a summary grows above COUNTERS.
    buckets = min(max(width, -(-mass * SLACK // (threshold * COUNTERS))), 1 << CELL_BITS)
    bucketed = partial.withColumn("bucket", F.pmod("cell", F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("bucket").agg(
        (F.floor(F.sum("mass") * SLACK / threshold) + 1).cast("long").alias("capacity")
    )
    # `sizes` has at most `buckets` rows, a number fixed above.
    summed = bucketed.join(F.broadcast(sizes), "bucket").repartition(buckets, "bucket")
    return store(
        summed.select("bucket", "keys", "counts", "capacity").mapInArrow(
            lambda batches: _summaries(batches, threshold), "key long"
        )
    )


_PHRASE = {"lang": pa.string(), "length": pa.int32(), "phrase": pa.string(),
           "key": pa.int64(), "cnt": pa.int64()}


def _exact_counts(frequent, survivors, cells):
    """A task's distinct phrases of frequent words whose key survived, with their
    counts: a row for each cell of keys, its columns lists. PHRASES of them are
    counted before they are given."""

    def told(counted):
        lang, length, key, phrase = zip(*counted)
        where = np.array(key, np.int64).view(np.uint64) % np.uint64(cells)
        order = np.argsort(where, kind="stable")
        where = where[order]
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        ends = pa.array(np.r_[starts, len(where)].astype(np.int32))
        columns = zip((lang, length, phrase, key, counted.values()), _PHRASE.values())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(where[starts].astype(np.int32)),
                *(
                    pa.ListArray.from_arrays(ends, pa.array(list(c), kind).take(pa.array(order)))
                    for c, kind in columns
                ),
            ],
            ["cell", *_PHRASE],
        )

    def run(batches):
        counted: dict[tuple, int] = {}
        for lang, words, piece in word_slices(batches):
            hashes = word_hashes(lang, words)
            ok = np.ones(len(hashes), bool) if frequent is None else _among(hashes, frequent.value)
            for length in range(SHORTEST, LONGEST + 1):
                starts, key_a, key_b = phrase_positions(hashes.view(np.uint64), piece, ok, length)
                if survivors is not None:
                    hit = _among(key_a, survivors.value)
                    starts, key_a, key_b = starts[hit], key_a[hit], key_b[hit]
                if not len(starts):
                    continue
                order = np.lexsort((key_b, key_a))
                key_a, key_b = key_a[order], key_b[order]
                first = np.flatnonzero(
                    np.r_[True, (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])]
                )
                at = starts[order[first]]
                parts = [words.take(pa.array(at + j)) for j in range(length)]
                phrases = pc.binary_join_element_wise(*parts, " ").to_pylist()
                sums = np.diff(np.r_[first, len(order)]).tolist()
                for key, phrase, cnt in zip(key_a[first].tolist(), phrases, sums):
                    phrase = lang, length, key, phrase
                    counted[phrase] = counted.get(phrase, 0) + cnt
                if len(counted) >= PHRASES:
                    yield told(counted)
                    counted = {}
        if counted:
            yield told(counted)

    return run


def _summed_counts(batches):
    """The counts of `_exact_counts` summed by phrase, PHRASES held at a time."""
    keys = [n for n in _PHRASE if n != "cnt"]
    held = None
    for batch in batches:
        new = pa.table({n: batch.column(n).flatten() for n in _PHRASE})
        both = new if held is None else pa.concat_tables([held, new])
        held = both.group_by(keys, use_threads=False).aggregate([("cnt", "sum")])
        held = held.select([*keys, "cnt_sum"]).rename_columns(list(_PHRASE))
        if len(held) >= PHRASES:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()
    give_back()


def exact_counts(texts, frequent, survivors):
    """(lang, length, phrase, f) of every surviving phrase, counted exactly."""
    known = _known(survivors)
    cells = min(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << CELL_BITS)
    packed = texts.mapInArrow(
        _exact_counts(frequent, known, cells),
        "cell int, lang array<string>, length array<int>, phrase array<string>,"
        " key array<long>, cnt array<long>",
    )
    found = packed.repartition(cells, "cell").mapInArrow(
        _summed_counts, "lang string, length int, phrase string, key long, cnt long"
    )
    if known is None:  # too many to carry to every task: joined by key in Spark
        found = found.join(survivors.distinct(), "key", "left_semi")
    return found.groupBy("lang", "length", "phrase").agg(F.sum("cnt").cast("long").alias("f"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language the TOP phrases of 2 to 5 words by association score:
    lang, rank, phrase, a, l, r, n, score (longs)."""
    texts = texts_of(docs, text, lang)
    threshold = THRESHOLD
    singles, totals = frequent_words(texts, threshold)
    frequent = _known(store(singles.mapInArrow(_hashed_words, "key long")))
    coded = store(texts.mapInArrow(_coded(frequent), "codes binary"))
    survivors = frequent_keys(coded, frequent, threshold)
    phrases = exact_counts(texts, frequent, survivors)
    counts = store(phrases.filter(F.col("f") >= threshold).unionByName(singles))
    candidates = counts.filter(F.col("length").between(SHORTEST, LONGEST)).select(
        "lang", "phrase", "length", F.col("f").alias("a")
    )
    words = F.split("phrase", " ")
    cuts = candidates.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    ).select(
        "*",
        F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("length")), " ").alias("right"),
    )
    parts = counts.select("lang", "phrase", "f")
    lefts = parts.withColumnsRenamed({"phrase": "left", "f": "l"})
    rights = parts.withColumnsRenamed({"phrase": "right", "f": "r"})
    exact = "decimal(38,0)"
    scored = (
        cuts.join(lefts, ["lang", "left"])
        .join(rights, ["lang", "right"])
        .join(totals, "lang")
        .withColumn(
            "score",
            F.expr(
                f"CAST(a AS {exact}) * CAST(n AS {exact}) * 1000"
                f" div (CAST(l AS {exact}) * CAST(r AS {exact}))"
            ),
        )
    )
    lowest = scored.groupBy("lang", "phrase", "length", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    longer = candidates.filter(F.col("length") > SHORTEST).select(
        "lang",
        F.explode(
            F.array(
                F.array_join(F.slice(words, 1, F.col("length") - 1), " "),
                F.array_join(F.slice(words, 2, F.col("length") - 1), " "),
            )
        ).alias("inner"),
        F.col("a").alias("outer_a"),
    )
    kept = lowest.alias("p").join(
        longer.alias("q"),
        (F.col("p.lang") == F.col("q.lang"))
        & (F.col("p.phrase") == F.col("q.inner"))
        & (F.col("q.outer_a") >= F.col("p.a")),
        "left_anti",
    )
    result = kept.select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = result.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    ).filter(F.col("rank") <= TOP)
    ranked = first.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ).filter(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
