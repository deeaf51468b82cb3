"""op13: spelling variants against a plain-Python version of the contract."""

import re
import zlib
from collections import Counter

from textvariety.llm import variants as va


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans(va.UPPER, va.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            if len(low) >= 5:
                counts[low] += 1
    words = {w: n for w, n in counts.items() if n >= 3}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long_ = sorted((a, b), key=len)
        return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))

    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        top = min(others, key=lambda v: (-words[v], v)) if others else None
        form = top if top is not None and words[top] >= 2 * n else None
        out[w] = [form, None, n, len(others), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return sorted((w, *row) for w, row in out.items())


def _rows(frame):
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r[c] for c in cols) for r in frame.collect())


def test_variants_equal_brute_force(spark):
    text = (
        "colour color colour colour colours COLOUR colour color colour "
        "colours colour collour theatre theater theatre theatre theatre "
        "Straße strasse straße straße Strasse naïve naive naïve naïve naive "
        "abcde abcdf abcdf abcde abcdf abcdf abcdf abcdf abcdf abcde xyz "
    )
    rows = [(i, text * (1 + i % 3)) for i in range(60)] + [(None, text), (7, None), (8, "")]
    rows += [(i, "colorr colorrr colorrrr") for i in range(200, 230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = _rows(va.spelling_variants(docs))
    want = brute(rows)
    assert got == want
    assert any(r[1] is not None for r in got)


def test_variants_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert va.spelling_variants(empty).count() == 0
    rows = [(1, "hello hello hellox", "x", "T")] * 3 + [(2, None, None, None)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, lang string, Text string")
    assert _rows(va.spelling_variants(clash)) == brute([(r[0], r[1]) for r in rows])
    long_run = "a" * 5_000
    docs = spark.createDataFrame([(i, f"{long_run} {long_run}b") for i in range(3)], "doc_id long, text string")
    assert _rows(va.spelling_variants(docs)) == brute([(i, f"{long_run} {long_run}b") for i in range(3)])
