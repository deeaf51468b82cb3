"""Mixing, quality, neighbours and near-duplicates: rules and odd cases."""

import re
from collections import Counter

import numpy as np
import pytest

from textvariety.llm import mixing, near_dedup, neighbours, quality, queries
from tests.llm.test_pipeline import shingles

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string"


def size(text):
    return len(re.findall(r"[^ \t-\r]+", text or ""))


# --- mixing ---


def check_mix(rows, got):
    had = Counter()
    for _, text, source in rows:
        had[source] += size(text)
    names = sorted(had, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([had[n] for n in names], mixing.WEIGHTS, mixing.SHARE, mixing.MOST)))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = Counter()
    by_target = {}
    for r in got:
        taken[(r["source_size"], r["target"])] += r["taken"]
    for name in names:
        by_target.setdefault((had[name], goals[name]), []).append(goals[name])
    for key, parts in by_target.items():
        assert abs(taken[key] - sum(parts)) <= len(parts)
    assert abs(sum(goals.values()) - 1.5 * sum(had.values())) < 1e-6


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, None), (2, "", "a")],
        [(1, "one two three", "a")],
        [(None, "a b c", None), (None, "a b c", None), (3, "d " * 9000, "x"), (4, "e " * 100, "y"), (3, "f", "z")],
        [(i, "word " * (i % 40), "hot" if i % 3 else f"s{i % 7}") for i in range(2000)],
    ],
)
def test_mix(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.words_taken(mixing.mix(frame)).collect()
    check_mix(rows, got)
    again = mixing.words_taken(mixing.mix(frame.repartition(3))).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mix_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    check_mix(rows, queries.op1(spark, SF_DIR).collect())


def test_shards_take_disjoint_blocks(spark):
    rows = [(i, "word " * (1 + i % 60), f"s{i % 4}") for i in range(1500)]
    made = mixing.mix(spark.createDataFrame(rows, DOCS), block_words=16, shard_blocks=100)
    draws = made.draws.collect()
    assert len({(d["row"], d["pass"], d["block"]) for d in draws}) == len(draws)
    shards = Counter(d["shard"] for d in draws)
    assert max(shards.values()) - min(shards.values()) <= 1
    slots = {}
    for d in draws:
        slots.setdefault(d["shard"], []).append(d["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tree_deals_out_every_quota():
    tree = mixing.SplittingTree((1000, 0, 37, 5000), 13, 5)
    leaves = list(tree.leaves(np.arange(13)))
    assert sum(c for _, _, c in leaves).tolist() == [1000, 0, 37, 5000]
    for (_, first, count), (_, after, _) in zip(leaves, leaves[1:]):
        assert (first + count == after).all()
    (one,) = tree.leaves(np.array([7]))
    assert (one[1] == leaves[7][1]).all() and (one[2] == leaves[7][2]).all()
    large = mixing.draw(np.random.default_rng(1), np.array([3 * 10**9, 10**9, 5]), 10**9)
    assert large.sum() == 10**9 and abs(large[0] - 75 * 10**7) < 10**6 and (large >= 0).all()


def test_targets_reshare_what_capped_sources_leave():
    assert mixing.targets([10, 1000, 1000], (5, 2, 1), 1.5, 2.0) == pytest.approx([20, 1996.6667, 998.3333], abs=1e-3)
    assert mixing.targets([0, 0], (5, 2, 1), 1.5, 2.0) == [0, 0]


def test_cut_words():
    assert mixing.cut_words("  a b\n\nc d ", 1, 2) == "b\n\nc"
    assert mixing.cut_words("", 0, 5) == ""


# --- quality ---


def test_quality_of_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op4(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(r["quality"], got[r["doc_id"]]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(held) > 500
    assert np.mean([q == g["predicted"] for q, g in held]) > 0.98


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "text " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Text string")
    model = quality.train_quality(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 and r["predicted"] == 0 for r in got)
    assert quality.scored(docs.limit(0), model).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


# --- neighbours ---

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, top=20, every=20):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if not fine:
        return {}
    usual = Counter(len(v) for _, v in fine)
    width = min(usual, key=lambda n: (-usual[n], n))
    fine = [(i, np.array(v)) for i, v in fine if len(v) == width]
    out = {}
    for at, (i, v) in enumerate(fine):
        if i % every == 0:
            others = sorted((-float((v * w).sum()), j) for k, (j, w) in enumerate(fine) if k != at)
            out.setdefault(i, []).append([(j, -s) for s, j in others[:top]])
    return out


def found(frame):
    out = {}
    for r in sorted(neighbours.nearest_neighbours(frame).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("odd", [True, False])
def test_neighbours_of_odd_vectors(spark, odd):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)]
    if odd:
        rows += [
            (20 * i + 4000, v)
            for i, v in enumerate(
                [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan")] * 4, [float("inf")] * 4, [1.0], [2.0] * 5]
            )
        ]
        rows += [(None, [1.0] * 4)]
    got, want = found(spark.createDataFrame(rows, VECTORS)), brute(rows)
    assert got.keys() == want.keys()
    for i, (one,) in want.items():
        assert [v for v, _ in got[i]] == [v for v, _ in one]
        assert np.allclose([s for _, s in got[i]], [s for _, s in one], rtol=0, atol=1e-12)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0])]])
def test_few_neighbours(spark, rows):
    got, want = found(spark.createDataFrame(rows, VECTORS)), brute(rows)
    assert got == {i: w[0] for i, w in want.items() if w[0]}


def test_hilbert_curve_visits_its_cells_in_steps():
    cells = np.indices((8, 8, 8)).reshape(3, -1).T
    keys = neighbours.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- near-duplicates ---


def groups(rows):
    sets = [shingles(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return out


def edited(words, at):
    return " ".join("x" if i in at else w for i, w in enumerate(words))


WORDS = [f"w{i}" for i in range(120)]
NEAR = [
    [],
    [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (7, "Éa b c"), (8, "éa b c")],
    [(None, "a b c d"), (None, "a b c d"), (9, "a b c d"), (2, "A b\tc  d")],
    [(50 - i, edited(WORDS, set(range(3 * i, 3 * i + 2)))) for i in range(20)] + [(99, " ".join(WORDS))],
    # A chain: each is near the next only.
    [(i, " ".join(WORDS[4 * i : 4 * i + 80])) for i in range(10)],
    [(i, "same " * 3 + f"text number {i}") for i in range(30)] + [(70, "long " * 40_000), (71, "long " * 40_001)],
]


@pytest.mark.parametrize("rows", NEAR)
def test_near_duplicates(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.dedup_report(near_dedup.near_duplicates(frame)).collect()
    want = groups(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_group_around_one_text(spark):
    """Copies near their base only: most links are found through it."""
    rng = np.random.default_rng(2)
    rows = [(i + 1, edited(WORDS, set(rng.choice(120, 3, False).tolist()))) for i in range(400)]
    rows.append((1000, " ".join(WORDS)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.dedup_report(near_dedup.near_duplicates(frame)).collect()
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: find(d) for d in ids}


def test_posterior_bounds():
    needed = near_dedup.fewest_matches(6)
    assert needed == sorted(needed) and len(needed) == 6
    # A pair at the threshold is all but sure to stay.
    rng = np.random.default_rng(1)
    matches = rng.random((20_000, 192)) < 0.85
    counts = np.stack([matches[:, : 32 * (k + 1)].sum(1) for k in range(6)])
    assert (counts >= np.array(needed)[:, None]).all()


@pytest.mark.parametrize(("percent", "shingle"), [(80, 5), (85, 3), (80, 1)])
def test_what_stays_at_other_shingles(spark, percent, shingle):
    """Texts with a passage put in or scattered edits, next to brute force."""
    rows = []
    for k in range(40):
        words = [f"v{k}_{i}" for i in range(150)]
        cut = 6 + k % 20
        rows += [
            (10 * k, " ".join(words)),
            (10 * k + 1, " ".join([*words, *(f"more{k}_{i}" for i in range(cut + 10))])),
            (10 * k + 2, edited(words, set(range(5, 150, 150 // (1 + k % 8))))),
        ]

    def sets_of(text):
        words = text.split()
        return {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}

    sets = {d: sets_of(t) for d, t in rows}
    root = {d: d for d in sets}
    for k in range(40):
        trio = [10 * k + i for i in range(3)]
        for _ in trio:
            for a in trio:
                for b in trio:
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    stay = near_dedup.drop_near_duplicates(frame, percent, shingle).collect()
    assert {r["doc_id"] for r in stay} == {d for d in root if root[d] == d}
    assert {r["doc_id"]: r["text"] for r in stay}.items() <= dict(rows).items()


def test_dedup_leaves_one_scratch_table(spark, tmp_path, monkeypatch):
    from textvariety.sources import scratch

    monkeypatch.setattr(scratch, "scratch_root", lambda spark: str(tmp_path))
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join(words[i % 5 :] * 9) + " x" * (i // 5 % 2), "s") for i in range(40)]
    rows += [(None, None, "s"), (90, "a b", "s"), (90, "a b", "s")]
    frame = spark.createDataFrame(rows, DOCS)
    stay = near_dedup.drop_near_duplicates(frame)
    assert len([p for p in tmp_path.iterdir() if any(p.glob("part-*"))]) == 1
    found = near_dedup.dedup_report(near_dedup.near_duplicates(frame))
    assert len([p for p in tmp_path.iterdir() if any(p.glob("part-*"))]) == 2
    firsts = {r["component_id"] for r in found.collect()}
    assert {r["doc_id"] for r in stay.collect()} == firsts and stay.count() == len(firsts)


def test_spark_decides_how_texts_meet_the_kept_rows(spark):
    frame = spark.createDataFrame([(i, f"text {i} of a few", "s") for i in range(50)], DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stay = near_dedup.drop_near_duplicates(frame)
        plan = stay._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and stay.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
