import math
import random
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertmill.llm import copies, quantiles


def brute_copies(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1:3]].append(r[0])
    return sorted((min(v), i) for v in by.values() for i in v if i != min(v))


@pytest.mark.parametrize("n", [0, 1, 300])
def test_copies_match_brute_force(spark, rows, n, monkeypatch):
    monkeypatch.setattr(copies, "VERIFY_ROWS", 10)  # the hot group is compared in many slots
    r = random.Random(n)
    data = [(i * 3, *(("a", "b") if r.random() < 0.4 else (r.choice(["", "x", None]), r.choice(["", "y", None]))), "clash", 1) for i in range(n)]
    df = spark.createDataFrame(data, "id long, f string, g string, _hi string, n int")
    assert sorted(rows(copies.formal_copies(df, "id", ["f", "g"]))) == brute_copies(data)
    counts = copies.copy_counts(df, "id", ["f", "g"]).collect()
    assert sum(c["n_copies"] for c in counts) == n and len(counts) == len({d[1:3] for d in data})


def test_equal_fingerprints_of_other_values_are_kept_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(copies, "fingerprint", lambda fields: [F.lit(1).cast("long").alias("_hi"), F.lit(1).cast("long").alias("_lo")])
    data = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, None), (6, None), (7, "c")]
    df = spark.createDataFrame(data, "id long, f string")
    assert sorted(rows(copies.formal_copies(df, "id", ["f"]))) == [(1, 3), (2, 4), (5, 6)]


def rank_value(v, p):
    v = sorted(v)
    return v[max(1, math.ceil(len(v) * p / 1000)) - 1]


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_percentiles_are_exact(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", broadcast_rows)
    r = random.Random(1)
    draw = {"long": lambda: r.lognormvariate(0, 3) * r.choice([1, -1]), "same": lambda: 4.25, "odd": lambda: r.choice([0.0, -0.0, float("inf"), float("-inf"), float("nan"), None, 5e-324, 1e308, -3.0])}
    data = [(k, 1, f()) for k, f in draw.items() for _ in range(400)] + [(None, 1, 2.0), ("none", 1, None), ("nan", 1, float("nan")), ("one", 1, 7.5)]
    df = spark.createDataFrame(data, "g string, _k int, x double")
    got = quantiles.exact_percentiles(df, ["g"], "x", [0, 1, 500, 999, 1000]).collect()
    by = defaultdict(list)
    for g, _, x in data:
        if x is not None and x == x:
            by[g].append(x)
    assert {r["g"] for r in got} == set(by) and len(got) == 5 * len(by)
    for r_ in got:
        assert r_["n"] == len(by[r_["g"]])
        assert r_["value"] == r_["lo"] == r_["hi"] == rank_value(by[r_["g"]], r_["permille"])


def test_scopes_are_rolled_up_from_the_finest_groups(spark):
    """Values that share three digits, so all levels are walked, in groups that follow different bins."""
    r = random.Random(5)
    data = [(r.choice(["a", "b", None]), r.choice(["x", "y", "z"]), 1.0 + r.randrange(300) * 2**-50 if r.random() < 0.7 else r.choice([-1, 1]) * r.random()) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, day string, x double").select("g", "day", quantiles.ordered(F.col("x")).alias("k"))
    scopes = {"g": ["g"], "day": ["day"], "both": ["g", "day"]}
    got = {(x["scope"], x["g"], x["day"], x["permille"]): x["value"] for x in quantiles.select_ranks(df, ["g", "day"], "k", [1, 250, 500, 750, 999], scopes=scopes).collect()}
    by = defaultdict(list)
    for g, day, x in data:
        for key in (("g", g, None), ("day", None, day), ("both", g, day)):
            by[key].append(x)
    assert got == {(*k, p): rank_value(v, p) for k, v in by.items() for p in (1, 250, 500, 750, 999)}


def test_few_digits_bound_the_error(spark):
    v = np.random.default_rng(3).lognormal(0, 2, 2000)
    df = spark.createDataFrame([(1, float(x)) for x in v], "g int, x double")
    for r in quantiles.exact_percentiles(df, ["g"], "x", [100, 500, 990], digits=2).collect():
        true = rank_value(v.tolist(), r["permille"])
        assert r["lo"] <= true <= r["hi"] and r["hi"] / r["lo"] - 1 <= 2**-20


def test_merged_days_equal_the_whole(spark, rows):
    v = np.random.default_rng(4).lognormal(0, 2, 3000)
    df = spark.createDataFrame([("r", f"d{i % 7}", float(x)) for i, x in enumerate(v)], "g string, day string, x double")
    merged = quantiles.merge_histograms(quantiles.histogram(df, ["g", "day"], "x"), ["g"])
    assert rows(merged) == rows(quantiles.histogram(df, ["g"], "x"))
    for r in quantiles.histogram_percentiles(merged, ["g"], [10, 500, 900]).collect():
        true = rank_value(v.tolist(), r["permille"])
        assert r["lo"] <= true <= r["hi"] and r["hi"] / r["lo"] - 1 <= 2**-8
    assert quantiles.exact_percentiles(df.limit(0), ["g"], "x", [500]).count() == 0


def test_ordered_bits_keep_the_order(spark):
    xs = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    k = [r[0] for r in df.select(quantiles.ordered_bits("x")).collect()]
    assert k == sorted(k) and len(set(k)) == len(xs) and struct.calcsize("d") == 8
