"""Personal data in texts: fixed patterns and a skip-chain conditional random field.

The patterns' matches always count. Around them, a conditional random field
labels the tokens that hold a digit or an @; all other tokens are outside by
definition. Neighbouring tokens share a potential, and so do distant tokens that
are equal or have the same digits, so that a number found in full once is also
recognised where it stands shortened or in other punctuation. Loopy message
passing finds the marginals of all documents of a batch at once.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvariety.llm.chunks import give_back
from textvariety.llm.common import n_of, pick, span_text

# --- Fixed values: the patterns that must be found ---
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MOST_OCTET, CARD_DIGITS, PHONE_DIGITS = 255, (12, 19), (9, 15)
# --- end of fixed values ---

OUTSIDE = 0  # label 0; label k is KINDS[k - 1]
LABELS = len(KINDS) + 1
HASHES = 4096
# Documents the field is trained on at most, and characters of each at most.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 1500, 20_000
STEPS, RATE, DECAY = 150, 0.5, 1e-3
# Before training, linked tokens are taken to share their label that much.
SKIP_PRIOR = 6.0
DAMPING, CERTAIN = 0.5, 0.95
# Messages are settled when none moves further; loops that never settle end after ROUNDS.
SETTLED, ROUNDS = 1e-4, 1000
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_HAS = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^ \t-\r]+")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int, str]


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, its digits summed."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches by their @, so that long runs without one cost nothing."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            low = match.end()
        at = text.find("@", max(at + 1, low))


def _octets(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= MOST_OCTET for p in parts)


def fixed_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Sorted spans of the patterns, and the places that look like a card or an
    address but fail its check: those are known to be none."""
    if not _HAS.search(text):
        return [], []
    spans = [(s, 0, e, "email") for s, e in _emails(text)]
    failed = []
    for m in IP.finditer(text):
        if _octets(m[0]):
            spans.append((m.start(), 1, m.end(), "ip"))
        else:
            failed.append(m.span())
    for m in CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= CARD_DIGITS[0] else ""
        if len(digits) >= CARD_DIGITS[0]:
            if len(digits) <= CARD_DIGITS[1] and luhn(digits):
                spans.append((m.start(), 2, m.end(), "card"))
            else:
                failed.append(m.span())
    for m in PHONE.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]:
            spans.append((m.start(), 3, m.end(), "phone"))
    return sorted(spans), failed


def _shape(token: str) -> str:
    """Runs of digits by length, runs of letters as one a, the rest as it is."""
    token = token[:60].strip(".,;:!?\"'")
    token = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub("[0-9]+", lambda m: f"d{min(m.end() - m.start(), 9)}", token)


@dataclass
class Graph:
    """Candidate tokens of some documents, one after another.

    features: hashed, a row each; known: the label where it is given, else -1;
    edges (i, j) of neighbours and of linked tokens; open_left / open_right: an
    outside token is next on that side.
    """

    where: list[tuple[int, int, int]]  # text, start, end
    features: np.ndarray
    known: np.ndarray
    near: np.ndarray
    linked: np.ndarray
    open_left: np.ndarray
    open_right: np.ndarray


def _linked_key(token: str) -> str | None:
    digits = _NOT_DIGIT.sub("", token)
    if "@" in token:
        return token.strip(".,;:!?\"'()<>").lower()
    return digits if len(digits) >= 4 else None


def _links_of_equals(nodes: list[int], known: list[int]) -> list[tuple[int, int]]:
    """Links between the equal tokens of a text, so that no label has a way to go.

    Tokens of a known label are linked to the next such; each other one is linked
    to the pattern match nearest to it, or without any to the nearest place that
    failed its check, or without either to the first of its like.
    """
    given = [n for n in nodes if known[n] >= 0]
    links = list(zip(given, given[1:]))
    centres = [n for n in given if known[n] != OUTSIDE] or given or nodes[:1]
    for n in nodes:
        if known[n] < 0 and n != centres[0]:
            i = bisect(centres, n)
            near = min(centres[max(i - 1, 0) : i + 1], key=lambda c: abs(c - n))
            links.append((min(near, n), max(near, n)))
    return links


def build_graph(texts: list[str], spans: list[list[Span]], failed: list[list[tuple[int, int]]]) -> Graph:
    """Tokens that hold a digit or an @, with what is known of them.

    A token repeated n times makes at most n - 1 links: see _links_of_equals.
    """
    where, rows, known, near, linked, left, right = [], [], [], [], [], [], []
    for t, text in enumerate(texts):
        if not _HAS.search(text):
            continue
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        shapes: dict[int, str] = {}
        equals: dict[str, list[int]] = {}
        marks = [(s, e, r + 1) for s, r, e, _ in spans[t]] + [(s, e, OUTSIDE) for s, e in failed[t]]
        marks.sort()
        mark, before = 0, -2
        running: list[tuple[int, int, int]] = []

        def shape(k: int) -> str:
            if not 0 <= k < len(tokens):
                return "^"
            if k not in shapes:
                shapes[k] = _shape(text[slice(*tokens[k])])
            return shapes[k]

        for k, (start, end) in enumerate(tokens):
            if not _HAS.search(text, start, end):
                continue
            node = len(where)
            token = text[start:end]
            cue = text[slice(*tokens[k - 1])][:12].lower() if k else "^"
            named = (f"s={shape(k)}", f"p={shape(k - 1)}", f"n={shape(k + 1)}", f"w={cue}", "bias")
            rows.append([zlib.crc32(f.encode()) % HASHES for f in named])
            while mark < len(marks) and marks[mark][0] < end:
                running.append(marks[mark])
                mark += 1
            running = [m for m in running if m[1] > start]
            found = [m[2] for m in running]
            known.append(max(found) if found else -1)
            if k == before + 1:
                near.append((node - 1, node))
                right[-1] = False
            left.append(k != before + 1)
            right.append(True)
            key = _linked_key(token)
            if key is not None:
                equals.setdefault(key, []).append(node)
            where.append((t, start, end))
            before = k
        for nodes in equals.values():
            linked += _links_of_equals(nodes, known)
    pairs = (np.array(e, np.int64).reshape(-1, 2) for e in (near, linked))
    return Graph(
        where, np.array(rows, np.int64).reshape(-1, 5), np.array(known, np.int64), *pairs,
        np.array(left, bool), np.array(right, bool),
    )


@dataclass
class SkipChain:
    """weights: of features by label; chain: of neighbours; skip: of linked tokens."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, graph: Graph) -> np.ndarray:
        score = self.weights[graph.features].sum(1)
        score += graph.open_left[:, None] * self.chain[OUTSIDE]
        score += graph.open_right[:, None] * self.chain[:, OUTSIDE]
        (given,) = np.nonzero(graph.known >= 0)
        score[given] -= 50.0
        score[given, graph.known[given]] += 50.0
        return score


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def marginals(model: SkipChain, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product with damping over both kinds of edges, until messages settle.

    Only messages that still move, or whose sender has met one that does, are
    made anew, so a text takes its own number of rounds whatever is beside it.
    Known tokens take no messages: many repeats of one would outvote it.
    """
    unary = model.unary(graph)
    edges = np.concatenate([graph.near, graph.linked])
    if len(edges):
        size = len(edges)
        tables = np.concatenate(
            [
                np.broadcast_to(model.chain, (len(graph.near), LABELS, LABELS)),
                np.broadcast_to(model.skip, (len(graph.linked), LABELS, LABELS)),
            ]
        )
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(size, 2 * size), np.arange(size)])
        sent = np.zeros((2 * size, LABELS))
        takes = graph.known[target] < 0
        (active,) = np.nonzero(takes)
        for _ in range(rounds):
            out = _log_sum((unary[source[active]] - sent[back[active]])[:, :, None] + tables[active], 1)
            out -= _log_sum(out, 1)[:, None]
            step = (1 - DAMPING) * (out - sent[active])
            sent[active] += step
            np.add.at(unary, target[active], step)
            moved = active[np.abs(step).max(1) > SETTLED]
            if not len(moved):
                break
            met = np.zeros(len(unary), bool)
            met[target[moved]] = True
            again = met[source]
            again[moved] = True
            (active,) = np.nonzero(again & takes)
    return np.exp(unary - _log_sum(unary, 1)[:, None])


def fit_skip_chain(graph: Graph) -> SkipChain:
    """Pseudo-likelihood: every token given its features and the labels around it.

    Tokens of no pattern count as outside. Gradient steps with a decay, towards
    linked tokens sharing their label for the skip table and towards 0 else.
    """
    y = np.maximum(graph.known, OUTSIDE)
    weights = np.zeros((HASHES, LABELS))
    chain = np.zeros((LABELS, LABELS))
    prior = SKIP_PRIOR * np.eye(LABELS)
    skip = prior.copy()
    if not len(y):
        return SkipChain(weights, chain, skip)
    seen = [np.full_like(a, 1e-8) for a in (weights, chain, skip)]
    gold = np.eye(LABELS)[y]
    outside = np.eye(LABELS)[OUTSIDE]
    for _ in range(STEPS):
        score = weights[graph.features].sum(1)
        score += graph.open_left[:, None] * chain[OUTSIDE] + graph.open_right[:, None] * chain[:, OUTSIDE]
        for edges, table in ((graph.near, chain), (graph.linked, skip)):
            i, j = edges[:, 0], edges[:, 1]
            np.add.at(score, j, table[y[i]])
            np.add.at(score, i, table[:, y[j]].T)
        error = gold - np.exp(score - _log_sum(score, 1)[:, None])
        slopes = [np.zeros_like(weights), np.zeros_like(chain), np.zeros_like(skip)]
        np.add.at(slopes[0], graph.features, error[:, None, :])
        slopes[1] += np.outer(outside, error[graph.open_left].sum(0))
        slopes[1] += np.outer(error[graph.open_right].sum(0), outside)
        for edges, slope in ((graph.near, slopes[1]), (graph.linked, slopes[2])):
            i, j = edges[:, 0], edges[:, 1]
            np.add.at(slope, y[i], error[j])
            np.add.at(slope.T, y[j], error[i])
        for value, slope, square, centre in zip((weights, chain, skip), slopes, seen, (0, 0, prior)):
            slope = slope / len(y) - DECAY * (value - centre)
            square += slope**2
            value += RATE * slope / np.sqrt(square)
    return SkipChain(weights, chain, skip)


def train_skip_chain(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> SkipChain:
    """Fit on the patterns' matches in at most `sample` texts with a digit or an @
    and at most SAMPLE_CHARS characters, those of smallest hash; equal rows once."""
    rows = pick(docs, "doc_id", "text", text="string")
    rows = rows.filter((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("lot"), "text")
    last = rows.select("lot").orderBy("lot").limit(sample).agg(F.max("lot")).first()[0]
    chosen = rows.filter(F.col("lot") <= F.lit(last)).groupBy("lot").agg(F.first("text").alias("text"))
    texts = [r["text"] for r in chosen.orderBy("lot").collect()]
    found = [fixed_spans(t) for t in texts]
    return fit_skip_chain(build_graph(texts, [f[0] for f in found], [f[1] for f in found]))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in ".,;:!?\"'<>[]":
        start += 1
    while end > start and text[end - 1] in ".,;:!?\"'<>[]":
        end -= 1
    return start, end


def added_spans(model: SkipChain, texts: list[str], fixed: list[tuple[list[Span], list[tuple[int, int]]]]) -> list[list[Span]]:
    """Spans the field is certain of, apart from those of the patterns."""
    graph = build_graph(texts, [f[0] for f in fixed], [f[1] for f in fixed])
    out: list[list[Span]] = [[] for _ in texts]
    if not graph.where:
        return out
    certain = marginals(model, graph)
    label = certain.argmax(1)
    chosen = (certain.max(1) >= CERTAIN) & (label != OUTSIDE) & (graph.known < 0)
    joined = {(int(i), int(j)) for i, j in graph.near}
    for node in np.flatnonzero(chosen).tolist():
        t, start, end = graph.where[node]
        start, end = _trimmed(texts[t], start, end)
        kind = KINDS[int(label[node]) - 1]
        follows = (node - 1, node) in joined and chosen[node - 1] and label[node - 1] == label[node]
        if follows and out[t]:
            first = out[t].pop()
            start = first[0]
        if start < end:
            out[t].append((start, int(label[node]) - 1, end, kind))
    return out


def _scan(batches: Iterator[pa.RecordBatch], model: SkipChain) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def column(rows: list[list[Span]]) -> pa.Array:
        return pa.array([[dict(zip(("start", "rank", "end", "kind"), s)) for s in r] for r in rows], kind)

    for batch in batches:
        for start in range(0, len(batch), 1000):
            part = batch.slice(start, 1000)
            texts = part.column("text").to_pylist()
            fixed = [fixed_spans(t) for t in texts]
            added = added_spans(model, texts, fixed)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, column([f[0] for f in fixed]), column(added)],
                [*batch.schema.names, "base", "added"],
            )
    give_back()


def _rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    rows = pick(docs, *dict.fromkeys(("doc_id", "text", *keep)))
    return rows.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def find_pii(docs: DataFrame, model: SkipChain, *keep: str) -> DataFrame:
    """doc_id, text, the columns `keep`, and the spans `base` and `added`.

    Spans are (start, rank, end, kind) structs in code points, end exclusive and
    sorted; `added` touch none of `base`. Null texts count as empty and come back
    empty; repeated rows and null ids are rows like any other. A row is scanned
    where it lies, without a shuffle.
    """
    rows = _rows(docs, keep)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(partial(_scan, model=model), f"{schema}, base {_SPANS}, added {_SPANS}")


def pii_report(found: DataFrame) -> DataFrame:
    """Counts, digest and texts of the spans of `find_pii`."""
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *(n_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(every).alias("spans"),
    )


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with [EMAIL], [IP], … in place of its spans; spans that overlap
    are one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        texts = columns["text"].to_pylist()
        for i, (base, added) in enumerate(zip(columns.pop("base").to_pylist(), columns.pop("added").to_pylist())):
            if base or added:
                texts[i] = masked(texts[i], [(s["start"], s["end"], s["kind"]) for s in base + added])
        columns["text"] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _scan_and_mask(batches: Iterator[pa.RecordBatch], model: SkipChain) -> Iterator[pa.RecordBatch]:
    yield from _masked(_scan(batches, model))


def mask_pii(docs: DataFrame, model: SkipChain, *keep: str) -> DataFrame:
    """The rows of `find_pii` with every span masked in `text`, without the spans.

    Found and masked in one function: two in a row would take two Python
    processes for each task.
    """
    rows = _rows(docs, keep)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(partial(_scan_and_mask, model=model), schema)
