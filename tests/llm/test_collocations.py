"""op11: Misra-Gries summaries and phrase collocations against brute force."""

from collections import Counter

import numpy as np
import pytest

from textvariety.llm import collocations as co


def test_summary_keeps_every_key_above_mass_over_capacity():
    rng = np.random.default_rng(7)
    keys = np.concatenate([rng.integers(0, 5000, 20000), np.repeat([1, 2, 3], [400, 250, 101])])
    rng.shuffle(keys)
    counts = Counter(keys.tolist())
    threshold = 100
    capacity = len(keys) // threshold + 1
    held_k, held_c = np.empty(0, np.int64), np.empty(0, np.int64)
    for part in np.array_split(keys, 37):  # merged piece by piece, reduced as it grows
        held_k = np.concatenate([held_k, part.astype(np.int64)])
        held_c = np.concatenate([held_c, np.ones(len(part), np.int64)])
        held_k, held_c = co.reduce_summary(held_k, held_c, capacity)
        assert len(held_k) <= capacity
    frequent = {k for k, c in counts.items() if c >= threshold}
    assert frequent <= set(held_k.tolist())
    got = dict(zip(held_k.tolist(), held_c.tolist()))
    assert all(counts[k] - len(keys) / (capacity + 1) <= got[k] <= counts[k] for k in frequent)


def brute(rows, threshold=co.THRESHOLD, top=co.TOP):
    """Plain Python version of the contract."""
    import re

    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans(co.UPPER, co.LOWER))
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(ws)
            for n in range(1, 6):
                for i in range(len(ws) - n + 1):
                    key = (lang, " ".join(ws[i : i + n]))
                    counts[key] = counts.get(key, 0) + 1
    cand = {k: f for k, f in counts.items() if len(k[1].split(" ")) >= 2 and f >= threshold}
    out = []
    for (lang, phrase), a in cand.items():
        if any(
            q_lang == lang and len(q.split(" ")) > len(phrase.split(" ")) and fa >= a
            and f" {phrase} " in f" {q} "
            for (q_lang, q), fa in cand.items()
        ):
            continue
        ws, n = phrase.split(" "), totals[lang]
        cuts = []
        for k in range(1, len(ws)):
            l, r = counts[(lang, " ".join(ws[:k]))], counts[(lang, " ".join(ws[k:]))]
            cuts.append((1000 * a * n // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, phrase, a, l, r, n, score))
    ranked = []
    for lang in sorted({o[0] for o in out}):
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(mine[:top])]
    return ranked


def _rows(frame):
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in cols) for r in frame.collect())


@pytest.fixture(scope="module")
def fixture_rows():
    base = [
        ("The quick fox. the quick fox jumps", "en"),
        ("New York is big; NEW YORK city, new york city", "en"),
        (None, "en"),
        ("", None),
        ("sin idioma\tsin idioma!", None),
        ("über straße über straße", "de"),
    ]
    return base * 40 + [("new york new york new york", "en")] * 3


def test_collocations_equal_brute_force(spark, fixture_rows, monkeypatch):
    monkeypatch.setattr(co, "THRESHOLD", 50)
    monkeypatch.setattr(co, "TOP", 3)
    docs = spark.createDataFrame(fixture_rows, "text string, lang string").repartition(3)
    got = _rows(co.collocations(docs))
    assert got == sorted(brute(fixture_rows, 50, 3))
    assert {g[0] for g in got} >= {"en", "und", "de"}


def test_collocations_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(co, "THRESHOLD", 2)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert co.collocations(empty).count() == 0
    clash = spark.createDataFrame(
        [(1, "a b a b", "x", "TEXT"), (2, None, None, None)] * 2,
        "doc_id long, text string, lang string, Text string",
    )
    got = _rows(co.collocations(clash))
    assert got == sorted(brute([("a b a b", "x"), (None, None)] * 2, 2))
    long_text = " ".join(["alpha beta"] * 20000)
    assert co.collocations(spark.createDataFrame([(long_text, "en")], "text string, lang string")).count() >= 1


def test_only_phrases_of_frequent_shorter_ones_are_counted(spark, monkeypatch):
    """Frequent words in ever new order: their longer phrases take no disk."""
    rng = np.random.default_rng(5)
    rows = [(" ".join(f"w{j}" for j in rng.integers(0, 60, 50)), "en") for _ in range(60)]
    rows += [("one two three four. five\vOne two three", None)] * 20
    monkeypatch.setattr(co, "THRESHOLD", 20)
    stored, store = [], co.store
    monkeypatch.setattr(co, "store", lambda df: stored.append(store(df)) or stored[-1])
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = _rows(co.collocations(docs))
    assert got == sorted(brute(rows, 20)) and got
    mass = [t.agg({"mass": "sum"}).first()[0] or 0 for t in stored if "mass" in t.columns]
    assert len(mass) >= 2
    # Counted all at once, lengths 2 to 5 would be four times the pairs.
    assert sum(mass) < 1.2 * (60 * 49 + 20 * 5)


def test_more_keys_than_are_broadcast(spark, fixture_rows, monkeypatch):
    monkeypatch.setattr(co, "THRESHOLD", 50)
    monkeypatch.setattr(co, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(co, "SLICE", 40)
    monkeypatch.setattr(co, "PHRASES", 3)
    monkeypatch.setattr(co, "FLUSH", 4)
    docs = spark.createDataFrame(fixture_rows, "text string, lang string").repartition(3)
    assert _rows(co.collocations(docs)) == sorted(brute(fixture_rows, 50))


def test_a_task_gives_a_row_for_each_cell_of_phrases():
    import pyarrow as pa

    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 50, "text": texts})
    rows = [r for b in co._exact_counts(None, None, 7)(iter([batch, batch])) for r in b.to_pylist()]
    assert len(rows) <= 7
    found = Counter({(l, p): c for r in rows for l, p, c in zip(r["lang"], r["phrase"], r["cnt"])})
    assert len(found) == 50 * (19 + 18 + 17 + 16) and set(found.values()) == {2}
    whole = pa.Table.from_batches(co._exact_counts(None, None, 7)(iter([batch]))).to_batches()
    summed = pa.Table.from_batches(co._summed_counts(iter([*whole, *whole])))
    assert summed.num_rows == len(found) and set(summed.column("cnt").to_pylist()) == {2}
