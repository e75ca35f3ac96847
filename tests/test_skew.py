import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertmill.operators import skew

SCHEMA = "id long, k string, s string, t timestamp_ntz, w double, _n int, c int"


def make(n, seed):
    r = random.Random(seed)
    t0 = datetime(2026, 1, 1)
    return [
        (i, r.choice(["hot"] * 8 + ["a", "b", "", None]), r.choice(["x", "y", None]), None if r.random() < 0.05 else t0 + timedelta(seconds=r.randrange(50)), r.choice([1.5, None, -1.0, 0.0]), 1, 2)
        for i in range(n)
    ]


@pytest.mark.parametrize(("n", "chunk"), [(400, 7), (60, 1), (5, 1000), (0, 10)])
def test_profile_matches_a_walk(spark, n, chunk):
    data = make(n, n)
    got = {r["k"]: r for r in skew.per_key_profile(spark.createDataFrame(data, SCHEMA), "k", "s", "t", "id", "w", chunk).collect()}
    by = defaultdict(list)
    for d in data:
        by[d[1]].append(d)
    assert set(got) == set(by)
    for k, v in by.items():
        v.sort(key=lambda d: (d[3] is not None, d[3] or datetime.min, d[0]))
        gaps = [(b[3] - a[3]).total_seconds() for a, b in zip(v, v[1:]) if a[3] and b[3]]
        g = got[k]
        assert g["n_rows"] == len(v)
        assert g["n_changes"] == sum(a[2] != b[2] for a, b in zip(v, v[1:]))
        assert g["longest_gap_s"] == (max(gaps) if gaps else None)
        assert g["weight_sum"] == sum(d[4] for d in v if d[4] and d[4] > 0)
        assert g["first_at"] == v[0][3] and g["last_at"] == v[-1][3]


def test_chunks_are_of_equal_size(spark):
    df = spark.createDataFrame(make(500, 1), SCHEMA).select("id", "k")
    got = skew.keyed_chunks(df, "k", ["id"], 20).groupBy("k", "_chunk").count().collect()
    assert max(r["count"] for r in got) == 20
    short = Counter(r["k"] for r in got if r["count"] < 20)
    assert all(v == 1 for v in short.values())


def test_heavy_keys(spark, rows):
    data = make(400, 3)
    count = Counter(d[1] for d in data)
    want = sorted((k,) for k, c in count.items() if k is not None and c * 1000 >= 70 * 400)
    assert rows(skew.heavy_keys(spark.createDataFrame(data, SCHEMA), "k", "id", 70).select("k")) == want
    assert skew.heavy_keys(spark.createDataFrame([], SCHEMA), "k", "id", 70).count() == 0


def test_join_hot_aware(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FRACTION", 0.3)
    data = [(i, "hot" if i % 2 else f"k{i % 7}") for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(data, "id long, k string")
    groups = df.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew.join_hot_aware(df, groups, ["k"], "n", 201)
    assert rows(got.select("id", "first")) == rows(df.join(groups, "k").select("id", "first"))


def test_prefix_sums_and_ranks(spark, rows):
    r = random.Random(5)
    data = [(r.choice(["a", "a", "a", "b", None]), i, float(r.randrange(5))) for i in range(300)]
    df = spark.createDataFrame(data, "g string, i int, v double")
    cum, want = defaultdict(float), []
    for g, i, v in sorted(data, key=lambda d: d[1]):
        cum[g] += v
        want.append((i, cum[g]))
    assert sorted(rows(skew.prefix_sums(df, ["g"], "i", ["v"]).select("i", "v_cum"))) == sorted(want)
    assert sorted(r["p"] for r in skew.rank_within(df, None, ["i"], "p").collect()) == list(range(1, 301))
    assert skew.prefix_sums(df.limit(0), ["g"], "i", ["v"]).count() == 0
