import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from alertmill.operators import bootstrap, metrics, models, reports

A, N = "Attack", "Non-Attack"
PRED = "sys string, truth string, pred string, w double"


def test_counts_and_invalid_policies(spark):
    cells = {(A, A): 5, (N, A): 1, (N, N): 7, (A, N): 2, (A, None): 3, (N, None): 4}  # (truth, prediction): rows
    data = [("m", t, p, 0.5) for (t, p), n in cells.items() for _ in range(n)] + [("m", None, A, 0.5)]
    df = spark.createDataFrame(data, PRED)
    f = metrics.confusion(df, ["sys"]).first()
    assert (f["tp"], f["fp"], f["tn"], f["fn"], f["n"], f["n_invalid"]) == (5, 1 + 4, 7, 2 + 3, 22, 7)
    e = metrics.confusion(df, ["sys"], "w", "exclude").first()
    assert (e["tp"], e["fp"], e["tn"], e["fn"], e["n"], e["n_invalid"]) == (2.5, 0.5, 3.5, 1.0, 15, 7)
    with pytest.raises(ValueError):
        metrics.confusion(df, ["sys"], invalid="other")
    with pytest.raises(PySparkException):
        metrics.confusion(spark.createDataFrame([("m", "attack", A, 1.0)], PRED), ["sys"]).collect()


def test_undefined_rates_in_both_families(spark):
    df = spark.createDataFrame([("all", A, A, 1.0), ("all", N, A, 1.0), ("neg", N, N, 1.0)], PRED)
    r = {x["sys"]: x for x in metrics.hard_metrics(df, ["sys"]).collect()}
    assert r["all"]["f1"] == pytest.approx(2 / 3)
    assert (r["neg"]["tpr"], r["neg"]["precision"], r["neg"]["f1"], r["neg"]["balanced_accuracy"]) == (None, None, 0.0, None)
    z = {x["sys"]: x for x in metrics.zero_rates(metrics.confusion(df, ["sys"])).collect()}
    assert (z["neg"]["tpr"], z["neg"]["precision"], z["neg"]["f1"]) == (0.0, 0.0, 0.0)
    assert metrics.hard_metrics(df.limit(0), ["sys"]).count() == 0


def pairwise(t, s, w):
    pos, neg = [(x, v) for y, x, v in zip(t, s, w) if y], [(x, v) for y, x, v in zip(t, s, w) if not y]
    if not pos or not neg:
        return None
    hit = sum(a * b * ((x > y) + 0.5 * (x == y)) for x, a in pos for y, b in neg)
    return hit / (sum(a for _, a in pos) * sum(b for _, b in neg))


def test_auroc_matches_all_pairs(spark):
    r, data, want = random.Random(2), [], {}
    for g in range(6):
        n = 3 + 9 * g
        t, s, w = [r.random() < 0.3 for _ in range(n)], [round(r.gauss(0.4, 0.2), 1) for _ in range(n)], [float(r.choice([1, 2, 5])) for _ in range(n)]
        want[g] = pairwise(t, s, w)
        data += [(g, A if x else N, y, z) for x, y, z in zip(t, s, w)]
    df = spark.createDataFrame(data, "g int, truth string, score double, w double")
    got = {x["g"]: x["auroc"] for x in metrics.auroc(df, ["g"], weight="w").collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    one = spark.createDataFrame([(1, A, 0.5, 1.0)], df.schema)
    assert metrics.auroc(one, ["g"]).first()["auroc"] is None
    with pytest.raises(PySparkException):
        metrics.auroc(spark.createDataFrame([(1, A, float("nan"), 1.0)], df.schema), ["g"]).collect()


def test_auroc_bounds(spark):
    r = random.Random(8)
    data = [(r.random() < 0.6, None if r.random() < 0.25 else round(r.random(), 1)) for _ in range(37)]
    df = spark.createDataFrame([(A if x else N, y) for x, y in data], "truth string, score double")
    b = metrics.auroc_bounds(df, []).first()
    t, known = [x for x, _ in data], [(x, y) for x, y in data if y is not None]
    fill = lambda hi, lo: [y if y is not None else (hi if x else lo) for x, y in data]
    ones = [1.0] * len(data)
    assert b["n_available"] == len(known) and b["coverage"] == pytest.approx(len(known) / len(data))
    assert b["auroc"] == pytest.approx(pairwise(*zip(*known), ones))
    assert b["lower"] == pytest.approx(pairwise(t, fill(0.0, 1.0), ones)) and b["upper"] == pytest.approx(pairwise(t, fill(1.0, 0.0), ones))


def test_rule_majority_ties_and_unseen(spark):
    shares = {"scan": (4, 1), "even": (3, 3), "noise": (1, 6)}  # rule: attacks, others
    data = [(k, label) for k, (a, n) in shares.items() for label, c in ((A, a), (N, n)) for _ in range(c)]
    test = spark.createDataFrame([(k,) for k in (*shares, "new", None)], "rule_name string")
    by = {r["rule_name"]: r for r in models.predict_rule_majority(models.fit_rule_majority(spark.createDataFrame(data, "rule_name string, label string")), test).collect()}
    assert {k: r["pred"] for k, r in by.items()} == {"scan": A, "even": A, "noise": N, "new": N, None: N}
    assert by["new"]["score"] == pytest.approx(8 / 18) and not by["new"]["seen"] and by["scan"]["score"] == pytest.approx(0.8)


def test_cross_fit_equals_a_fit_on_the_other_folds(spark, rows):
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.choice(["a", "b", "c", None]), r.choice([A, N]), r.randrange(3)) for i in range(60)], "i int, rule_name string, label string, fold int")
    got = rows(models.cross_fit_rule_majority(df).select("i", "pred", "seen"))
    want = []
    for f in range(3):
        m = models.fit_rule_majority(df.filter(f"fold <> {f}"))
        want += rows(models.predict_rule_majority(m, df.filter(f"fold = {f}")).select("i", "pred", "seen"))
    assert sorted(got) == sorted(want)


def test_replicates_are_whole_groups(spark):
    size = {"a": 4, "b": 7, None: 2}
    df = spark.createDataFrame([(f"{g}{i}", g) for g, n in size.items() for i in range(n)], "u string, g string")
    named = df.selectExpr("u", "coalesce(g, '') AS g")
    m = bootstrap.multiplicities(df, "u", "g", 40, 1).join(named, "u").groupBy("rep", "g").sum("m").collect()
    assert len(m) == 120 and all(r["sum(m)"] == size[r["g"] or None] for r in m)
    same = bootstrap.multiplicities(df.repartition(3), "u", "g", 40, 1)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, bootstrap.multiplicities(df, "u", "g", 40, 1).collect()))


@pytest.mark.parametrize("broadcast_units", [0, 200_000])
def test_any_statistic_over_replicates(spark, broadcast_units, monkeypatch):
    """The hook against multiplicities: a weighted mean per system, points from replicate 0, undefined replicates counted."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(bootstrap, "BROADCAST_UNITS", broadcast_units)
    data = [(f"u{i}", "g", float(i % 4), i % 5 == 0) for i in range(12)]
    df = spark.createDataFrame(data, "u string, g string, x double, rare boolean")
    cells = bootstrap.weighted_cells(df, "u", "g", ["x", "rare"], 60, 3)

    def statistic(rows):
        return rows.groupBy("rep").agg((F.sum(F.when(F.col("rare"), F.col("x") * F.col("m"))) / F.sum(F.when(F.col("rare"), F.col("m")))).alias("value"))

    got = {r["rep"]: r["value"] for r in bootstrap.replicate_values(cells, statistic).collect()}
    draws = {}
    for r in bootstrap.multiplicities(df, "u", "g", 60, 3).collect():
        draws.setdefault(r["rep"], []).extend([data[int(r["u"][1:])]] * r["m"])
    draws[0] = data
    mean = lambda v: sum(v) / len(v) if v else None
    want = {k: mean([d[2] for d in v if d[3]]) for k, v in draws.items()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and None in want.values()
    ci = bootstrap.intervals(bootstrap.replicate_values(cells, statistic), []).first()
    known = [v for k, v in want.items() if k and v is not None]
    assert ci["point"] == pytest.approx(want[0]) and ci["n_undefined"] == 60 - len(known)
    assert (ci["lo"], ci["hi"]) == tuple(pytest.approx(x) for x in np.percentile(known, [2.5, 97.5]))


def test_rows_of_a_cluster_share_its_multiplicity(spark):
    df = spark.createDataFrame([(f"r{i % 5}", "t1" if i % 5 < 3 else "t2", i % 2 == 0) for i in range(30)], "rule string, kind string, hit boolean")
    m = {(r["rep"], r["rule"]): r["m"] for r in bootstrap.cluster_multiplicities(df, "rule", "kind", 25, 2).collect()}
    got = {(r["rep"], r["hit"]): r["m"] for r in bootstrap.cluster_cells(df, "rule", "kind", ["hit"], 25, 2).collect()}
    for rep in range(1, 26):
        assert sum(v for (k, _), v in got.items() if k == rep) == 6 * sum(v for (k, _), v in m.items() if k == rep)
    assert got[0, True] == got[0, False] == 15


def test_cluster_with_two_types_raises(spark):
    df = spark.createDataFrame([("r1", "mixed"), ("r1", "single")], "rule string, kind string")
    with pytest.raises(PySparkException):
        bootstrap.cluster_multiplicities(df, "rule", "kind", 2, 1).collect()


def test_paired_difference_of_equal_systems_is_zero(spark):
    df = spark.createDataFrame([(r, s, 0.1 * r if r else None) for r in range(4) for s in ("a", "b")], "rep int, system string, f1 double")
    got = bootstrap.paired_differences(df, "system", "f1", [("a", "b")]).collect()
    assert sorted((r["rep"], r["difference"]) for r in got if r["difference"] is not None) == [(1, 0.0), (2, 0.0), (3, 0.0)]
    ci = bootstrap.percentile_ci(df, ["system"], "f1").first()
    lo, hi = np.percentile([0.1, 0.2, 0.3], [2.5, 97.5])
    assert (ci["lo"], ci["hi"], ci["n_undefined"]) == (pytest.approx(lo), pytest.approx(hi), 1)


def test_interpolated_quantiles(spark):
    r = random.Random(3)
    data = [(g, r.choice([None, float("nan"), 1.0, round(r.gauss(0, 9), 1)])) for g in ("a", "b", "b", None) for _ in range(60)] + [("none", None), ("one", 4.0)]
    got = {x["g"]: x for x in reports.interpolated_quantiles(spark.createDataFrame(data, "g string, x double"), ["g"], "x", {"lo": 0.0, "mid": 0.5, "p95": 0.95, "hi": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, row in got.items():
        v = [x for k, x in data if k == g and x is not None and x == x]
        assert [row[c] for c in ("lo", "mid", "p95", "hi")] == [pytest.approx(q) for q in np.percentile(v, [0, 50, 95, 100])]


def test_rank_elements(spark):
    v = [5.0, 1.0, 1.0, 9.0, 7.0, float("nan"), None]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    from pyspark.sql import functions as F

    assert reports.rank_element(df, "x", lambda n: F.floor(n / 2)).first()["element"] == 5.0
    assert reports.rank_element(df, "x", lambda n: F.floor(n * 0.95)).first()["element"] == 9.0


def test_tfidf_learns_and_keeps_test_rows(spark):
    train = spark.createDataFrame([(f"union select {i} password", A) for i in range(12)] + [(f"index page {i} welcome", N) for i in range(24)], "text string, label string")
    test = spark.createDataFrame([("select password 7", 1), ("welcome page", 2), ("", 3), (None, 4)], "text string, i int")
    got = {r["i"]: r for r in models.tfidf_logistic(train, test, n_features=1 << 10, max_iter=30).collect()}
    assert got[1]["pred"] == A and got[2]["pred"] == N and set(got) == {1, 2, 3, 4}


def test_tfidf_query_scores_every_row_under_every_condition(spark, monkeypatch):
    import inspect

    from alertmill.plans import evaluation
    from alertmill.plans.bindings import frame

    d, fits = "/root/testdata/sf0.001", []
    signature = inspect.signature(models.tfidf_logistic)

    def stub(*args, **kwargs):
        b = signature.bind(*args, **kwargs)
        b.apply_defaults()
        train, test = b.arguments["train"], b.arguments["test"]
        shared = train.select("uid").intersect(test.select("uid")).count()
        fits.append((b.arguments["n_features"], b.arguments["max_iter"], train.count() + test.count(), shared))
        return test.selectExpr("*", "0.5d AS score", "'Attack' AS pred")

    monkeypatch.setattr(models, "tfidf_logistic", stub)
    got = evaluation.QUERIES["m4_tfidf"](spark, d).select("uid", "condition").collect()
    uids = {r["uid"] for r in frame(spark, d).collect()}
    assert sorted(map(tuple, got)) == sorted((u, c) for u in uids for c in "abc")
    assert fits == [(1 << 16, 100, len(uids), 0)] * 15


def test_tfidf_cross_fit_learns_from_the_other_folds(spark):
    rows = [(i, f"union select {i} password", A, i % 2) for i in range(12)] + [(i, f"index page {i} welcome", N, i % 2) for i in range(12, 36)]
    df = spark.createDataFrame(rows, "i int, text string, label string, fold int")
    got = models.cross_fit_tfidf(df, n_features=1 << 10, max_iter=10).collect()
    assert sorted(r["i"] for r in got) == list(range(36)) and all(r["pred"] == r["label"] for r in got)


def test_ngrams_cross_lines_and_collapse_space(spark):
    df = models.with_char_ngrams(spark.createDataFrame([("a\nb  c",), ("ab",), ("é\U0001f600xy",)], "text string"))
    g = [r["grams"] for r in df.collect()]
    text = "a\nb c"
    assert g[0] == [text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]
    assert g[1] == [] and g[2] == ["é\U0001f600x", "\U0001f600xy", "é\U0001f600xy"]
