import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from alertmill.llm import balanced, components, overlap, splits


def union_find(links):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    links = [(f"n{r.randrange(60):03d}", f"n{r.randrange(60):03d}") for _ in range(40)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    links += [("hub", f"leaf{i}") for i in range(50)] + [("hub", "leaf1")]
    df = spark.createDataFrame([*links, (None, "x"), ("y", None), ("self", "self")], "a string, b string")
    want = union_find([*links, ("self", "self")])
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == want
    assert components.connected_components(df.limit(0)).count() == 0


def test_splits_keep_components_and_proportions(spark, monkeypatch):
    monkeypatch.setattr(splits, "SHARD_COMPONENTS", 40)
    r = random.Random(9)
    data = [(f"c{c}", r.choice(["a", "b", "c", None])) for c in range(120) for _ in range(r.choice([1, 2, 5, 30]))] + [("big", "a")] * 200
    df = spark.createDataFrame([(i, *d, 1) for i, d in enumerate(data)], "id long, comp string, label string, at int")
    got = {r["comp"]: r["split"] for r in splits.component_splits(df, "comp", "label", {"train": 800, "validation": 100, "test": 100}).collect()}
    assert set(got) == {d[0] for d in data}
    n = Counter(got[d[0]] for d in data)
    assert abs(n["train"] / len(data) - 0.8) < 0.01 and abs(n["test"] / len(data) - 0.1) < 0.01
    for label in ("a", "b", "c"):
        of = [got[d[0]] for d in data if d[1] == label]
        assert abs(of.count("train") / len(of) - 0.8) < 0.05
    again = {r["comp"]: r["split"] for r in splits.component_splits(df.repartition(5), "comp", "label", {"train": 800, "validation": 100, "test": 100}).collect()}
    assert again == got
    assert splits.component_splits(df.limit(0), "comp", "label", {"train": 800, "test": 200}).count() == 0


def test_hundred_labels_are_balanced_one_by_one(spark):
    r = random.Random(2)
    data = [(f"c{c}", f"l{r.randrange(100)}") for c in range(4000) for _ in range(r.choice([1, 2, 3]))]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "id long, comp string, label string")
    shares = {"train": 800, "validation": 100, "test": 100}
    got = {x["comp"]: x["split"] for x in splits.component_splits(df, "comp", "label", shares).collect()}
    total, n = Counter(d[1] for d in data), Counter((got[d[0]], d[1]) for d in data)
    assert len(total) == 100
    off = [abs(n[s, v] - total[v] * p / 1000) for s, p in shares.items() for v in total]
    assert max(off) < 4 and sum(off) / len(off) < 0.8  # in rows; 0.3 is what rounding alone leaves


def record(r, words, drop, add):
    w = words[: len(words) - drop]
    return w + [f"new{r.randrange(10**9)}" for _ in range(add)]


def brute_pairs(docs):
    train, evals = ([(i, set(w)) for i, s, w in docs if s == side and w] for side in ("train", "eval"))
    return sorted((min(i, j), max(i, j)) for i, a in train for j, b in evals if 4 * len(a & b) >= 3 * len(a | b))


def test_overlap_matches_brute_force(spark, rows):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(60):
        base = r.sample(vocab, r.choice([3, 8, 40, 130]))
        for _ in range(6):
            cut = r.randrange(0, max(1, len(base) // 6 + 1))
            docs.append((record(r, base, cut, r.randrange(0, cut + 1))))
    docs = [(i, r.choice(["train", "train", "eval"]), w) for i, w in enumerate(docs)]
    docs += [(1000 + i, r.choice(["train", "eval"]), ["same", "words", "again"]) for i in range(40)] + [(2000, "train", []), (2001, "eval", [])]
    df = spark.createDataFrame(docs, "id long, side string, words array<string>")
    members, codes, words = overlap.word_classes(df)
    got = rows(overlap.cross_split_pairs(members, overlap.similar_classes(codes, words)))
    want = set(brute_pairs(docs))
    assert set(got) <= want and len(got) == len(set(got))
    assert len(set(got)) >= 0.999 * len(want) and len(want) > 500
    members, codes, words = overlap.word_classes(df.limit(0))
    assert overlap.cross_split_pairs(members, overlap.similar_classes(codes, words)).count() == 0


def test_overlap_recall_at_the_threshold(spark):
    """Pairs of exactly three quarters, the worst case that the blocks are set for."""
    docs = []
    for g in range(800):
        common = [f"g{g}c{i}" for i in range(60)]
        docs += [(2 * g, "train", common + [f"g{g}a{i}" for i in range(10)]), (2 * g + 1, "eval", common + [f"g{g}b{i}" for i in range(10)])]
    df = spark.createDataFrame(docs, "id long, side string, words array<string>")
    members, codes, words = overlap.word_classes(df)
    assert overlap.similar_classes(codes, words).count() >= 797


@pytest.mark.parametrize(("num", "den"), [(1, 2), (9, 10), (1, 1)])
def test_blocks_and_radius_follow_the_threshold(spark, num, den):
    docs = []
    for g in range(150):
        own = 20 * (den - num) // (den + num) if num < den else 0
        common = [f"g{g}c{i}" for i in range(20 - own)]
        while own and len(common) * den > num * (len(common) + 2 * own):
            common.pop()
        while own and len(common) * den < num * (len(common) + 2 * own):
            common.append(f"g{g}x{len(common)}")
        docs += [(2 * g, "train", common + [f"g{g}a{i}" for i in range(own)]), (2 * g + 1, "eval", common + [f"g{g}b{i}" for i in range(own)])]
    members, codes, words = overlap.word_classes(spark.createDataFrame(docs, "id long, side string, words array<string>"), num, den)
    assert overlap.overlap_counts(members, overlap.similar_classes(codes, words, num, den)).count() >= 149
    with pytest.raises(ValueError):
        overlap.Code.for_threshold(3, 2)


def test_counts_equal_the_expanded_pairs(spark, rows):
    r = random.Random(3)
    docs = [(i, r.choice(["train", "eval"]), [f"w{r.randrange(3)}", *"abcdefgh"][: r.choice([1, 8, 9])]) for i in range(300)]
    members, codes, words = overlap.word_classes(spark.createDataFrame(docs, "id long, side string, words array<string>"))
    links = overlap.similar_classes(codes, words)
    side = {i: s for i, s, _ in docs}
    want = Counter(i for pair in rows(overlap.cross_split_pairs(members, links)) for i in pair if side[i] == "eval")
    assert dict(rows(overlap.overlap_counts(members, links))) == want


def test_equal_keys(spark, rows):
    df = spark.createDataFrame([(1, "train", "u"), (2, "eval", "u"), (3, "eval", "v"), (4, "train", None), (5, "eval", None), (6, "train", "u")], "id long, side string, key string")
    m = overlap.equal_key_classes(df)
    none = m.selectExpr("cls as train_cls", "cls as eval_cls").limit(0)
    assert rows(overlap.cross_split_pairs(m, none)) == [(1, 2), (2, 6)]


def open_records(p):
    return (p > 0) & (p < 1)


def test_equal_flight_keeps_sums_and_expectations():
    rng = np.random.default_rng(1)
    cat = rng.integers(0, 5, 400)
    p = np.array([0.3, 0.5, 0.011, 0.99, 1 / 3])[cat]
    hits = np.zeros(400)
    for i in range(2000):
        s = balanced.equal_flight(p, cat, np.random.default_rng(i))
        for c in range(5):
            assert s[cat == c].sum() == pytest.approx(p[cat == c].sum()) and open_records(s[cat == c]).sum() <= 1
        hits += s
    assert np.abs(hits / 2000 - p).max() < 0.05


def test_flight_keeps_all_margins_and_expectations():
    rng = np.random.default_rng(2)
    s, l = rng.choice(["a", "b", "c"], 60), rng.choice(["x", "y"], 60)
    x, p = balanced.margins(s, l), rng.random(60)
    hits = np.zeros(60)
    for i in range(1500):
        f = balanced.flight(p, x, np.random.default_rng(i))
        assert x.T @ f == pytest.approx(x.T @ p)
        assert open_records(f).sum() <= 6  # as many as there are independent margins
        land = balanced.landing(f, x, np.random.default_rng(i + 10_000))
        assert not open_records(land).any() and abs(land.sum() - p.sum()) < 1
        hits += land
    assert np.abs(hits / 1500 - p).max() < 0.07


def test_a_unit_of_two_categories_is_drawn_once(spark, rows):
    frame = [(f"u{i}", "a", "x") for i in range(40)] + [(f"u{i}", "b", "x") for i in range(30, 60)] + [("u0", "rare", "x")]
    df = balanced.categories(spark.createDataFrame(frame, "uid string, stratum string, label string"), "uid", "stratum", "label")
    targets = spark.createDataFrame([(1, "a", "x", 500, 500, 1), (1, "b", "x", 400, 500, 1), (1, "rare", "x", 1, 500, 1)], "plan_id long, stratum string, label string, target_permille long, frame_permille long, min_rows long")
    sample, report = balanced.sample_report(df, targets)
    units = [r["unit"] for r in sample.collect()]
    assert len(units) == len(set(units)) and "u0" in units
    assert all(r["met"] and r["as_wanted"] for r in report.collect())


def test_a_broken_flight_shows(spark, monkeypatch):
    monkeypatch.setattr(balanced, "cube_sample", lambda drawable, seed: drawable.filter("p = 1").drop("p"))
    df = spark.createDataFrame([(f"u{i}", "a", "x") for i in range(100)], "unit string, s string, l string")
    targets = spark.createDataFrame([(1, "a", "x", 500, 500, 1)], "plan_id long, stratum string, label string, target_permille long, frame_permille long, min_rows long")
    row = balanced.sample_report(df, targets)[1].first()
    assert not row["met"] and not row["as_wanted"]


def test_sample_meets_targets_and_reports_the_rest(spark, monkeypatch):
    monkeypatch.setattr(balanced, "FLIGHT_ROWS", 300)
    monkeypatch.setattr(balanced, "FAN_IN", 2)
    frame = [(f"u{i}", "Mixed Attack" if i % 3 else "single_attack", " attack" if i % 2 else "Attack") for i in range(1200)] + [("u0", "single_attack", "Attack")] * 5
    frame += [("r1", "rare", "Attack"), ("r2", "rare", "Attack"), (None, "rare", "Attack"), ("z", None, "Attack")]
    df = balanced.categories(spark.createDataFrame(frame, "uid string, stratum string, label string"), "uid", "stratum", "label")
    targets = [(1, "mixed_attack", "Attack", 500, 500, 2), (1, "SINGLE_ATTACK", "attack", 250, 333, 2), (1, "rare", "Attack", 1, 100, 3), (2, "rare", "Attack", 1, 100, 2), (2, "nowhere", "x", 10, 10, 0), (3, "single attack", "Attack", 900, 900, 1), (3, None, "Attack", 1, 1, 1)]
    sample, report = balanced.sample_report(df, spark.createDataFrame(targets, "plan_id long, stratum string, label string, target_permille long, frame_permille long, min_rows long"))
    got = {(r["plan_id"], r["stratum"]): r for r in report.collect()}
    assert len(got) == len(targets)
    assert got[1, "mixed_attack"]["n_drawn"] in (300, 301) and got[1, "mixed_attack"]["met"]
    assert got[1, "SINGLE_ATTACK"]["n_drawn"] in (100, 101)
    assert not got[1, "rare"]["met"] and got[1, "rare"]["n_drawn"] == 2 and got[2, "rare"]["met"]
    assert not got[2, "nowhere"]["met"] and not got[3, "single attack"]["met"] and got[3, "single attack"]["n_drawn"] == 400
    assert not got[3, None]["met"]
    drawn = sample.collect()
    assert len(drawn) == len({(r["plan_id"], r["unit"], r["s"]) for r in drawn})
    per = defaultdict(int)
    for r in drawn:
        per[r["plan_id"]] += 1
    assert per[1] == got[1, "mixed_attack"]["n_drawn"] + got[1, "SINGLE_ATTACK"]["n_drawn"] + 2
