import random
from collections import Counter

import pytest

from alertmill.operators import audit, frame, sampling
from alertmill.schema import FIELD_ORDER

A, N = "Attack", "Non-Attack"
SCHEMA = "row_index long, " + ", ".join(f"{f} {'int' if f in ('dport', 'sport') else 'string'}" for f in FIELD_ORDER) + ", label string, extra string"


def alert(i, label, **change):
    base = {f: f"value {i} of {f}" for f in FIELD_ORDER} | {"dport": 443 + i, "sport": 1024 - i, "xff": ""} | change
    return (change.pop("row_index", i), *[base[f] for f in FIELD_ORDER], label, "x")


def test_frame_drops_conflicts_and_counts_copies(spark):
    data = [
        alert(0, A, rule_name="r"), alert(1, N, rule_name="r"), alert(0, A, rule_name="r", sip="other", row_index=7), alert(2, A, rule_name="r2"), alert(2, N, rule_name="r2", row_index=9),
        alert(3, N, rule_name=None), alert(4, None, rule_name="r"),
    ]
    data = [tuple([d[0] if i == 0 else x for i, x in enumerate(d)]) for d in data]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["row_index"]: r for r in frame.build_frame(df).collect()}
    assert set(got) == {0, 1, 3}
    assert got[0]["n_duplicates"] == 2 and got[0]["stratum"] == "mixed_attack" and got[3]["stratum"] == "single_non_attack"
    assert all(len(r["uid"]) == 16 and r["key"].startswith(r["uid"]) for r in got.values())
    assert frame.build_frame(df, keep_conflicts=True).count() == 1
    assert frame.build_frame(df.limit(0)).count() == 0
    assert tuple(frame.duplicate_stats(df.filter("label is not null")).first()) == (2, 4)


def test_collisions_are_refused(spark):
    ok = spark.createDataFrame([("u1", "k1"), ("u2", "k2")], "uid string, key string")
    assert frame.refuse_collisions(ok) is ok
    with pytest.raises(ValueError, match="u1"):
        frame.refuse_collisions(ok.union(spark.createDataFrame([("u1", "k9")], ok.schema)))


def test_null_and_shifted_fields_have_different_keys(spark):
    df = spark.createDataFrame([alert(0, A, parameter=None, uri="x"), alert(0, A, parameter="x", uri=None), alert(0, A, parameter="", uri="x")], SCHEMA)
    from alertmill.functions.keys import content_key

    assert df.select(content_key().alias("k")).distinct().count() == 3


def test_stratified_sample_is_exact_and_stable(spark):
    r = random.Random(1)
    pool = spark.createDataFrame([(f"u{i}", r.choice("abc")) for i in range(200)] + [("x1", "short")], "uid string, stratum string")
    one = sampling.stratified_sample(pool, "stratum", "uid", 12, 5)
    assert sorted((r["stratum"], r["count"]) for r in one.groupBy("stratum").count().collect()) == [("a", 12), ("b", 12), ("c", 12), ("short", 1)]
    assert audit.same_rows(one, sampling.stratified_sample(pool.repartition(7), "stratum", "uid", 12, 5)).first()["same"]
    with pytest.raises(ValueError):
        sampling.stratified_sample(pool, "stratum", "uid", 12, 5, strict=True)
    two = sampling.two_phase_sample(pool, "stratum", "uid", 5, 9, 5)
    assert two.select("uid").distinct().count() == two.count()
    assert sampling.stratified_sample(pool, "stratum", "uid", {"a": 3}, 5).count() == 3
    assert sampling.stratified_sample(pool.limit(0), "stratum", "uid", 3, 5).count() == 0


def test_folds_keep_groups_and_balance_strata(spark):
    data = [(f"r{i}", f"u{i}-{j}", "mixed_attack" if i % 3 == 0 and j > 2 else "single_non_attack") for i in range(45) for j in range(5)]
    df = spark.createDataFrame(data, "rule_name string, uid string, stratum string")
    for folds in (sampling.grouped_folds(df, "rule_name", 5, 1), sampling.stratified_group_folds(df, "rule_name", "stratum", 5, 1)):
        assert folds.count() == 225
        assert folds.select("rule_name", "fold").distinct().count() == 45
    sizes = sampling.stratified_group_folds(df, "rule_name", "stratum", 5, 1).groupBy("fold", "stratum").count().collect()
    assert {r["count"] for r in sizes if r["stratum"] == "mixed_attack"} == {6}
    assert {r["count"] for r in sampling.random_folds(df, "uid", 5, 1).groupBy("fold").count().collect()} == {45}


def test_folds_in_shards_stay_even(spark, monkeypatch):
    """Many strata and more groups than one task deals: null groups and strata are values, every stratum is spread evenly."""
    monkeypatch.setattr(sampling, "SHARD_GROUPS", 100)
    r = random.Random(6)
    data = [(None if g == 0 else f"g{g}", i, None if (s := r.randrange(300)) == 7 else f"s{s}") for g in range(700) for i in range(r.choice([1, 3, 20]))]
    df = spark.createDataFrame(data, "grp string, i int, s string")
    got = sampling.stratified_group_folds(df, "grp", "s", 4, 2).collect()
    assert len(got) == len(data) and len({(x["grp"], x["fold"]) for x in got}) == 700
    n = Counter((x["s"], x["fold"]) for x in got)
    total = Counter(x["s"] for x in got)
    assert sum(abs(n[s, f] - total[s] / 4) for s in total for f in range(4)) / (4 * len(total)) < 1.6
    assert len(total) > 290


def test_call_order_keeps_conditions_together(spark):
    got = sorted(sampling.call_order(spark.createDataFrame([(f"u{i}",) for i in range(9)], "uid string"), "uid", 3, ["a", "b", "c"]).collect(), key=lambda r: r["call_position"])
    assert [r["condition"] for r in got] == ["a", "b", "c"] * 9
    assert all(len({r["uid"] for r in got[i : i + 3]}) == 1 for i in range(0, 27, 3))


def test_audits(spark):
    pred = spark.createDataFrame([("m", "k1", A, "r"), ("m", "k2", N, None), ("m", "zz", A, "r")], "model string, key string, truth string, rule_name string")
    data = spark.createDataFrame([("k1", A, "r"), ("k1", N, "r2"), ("k2", N, None)], "key string, label string, rule_name string")
    r = audit.content_match(pred, data, ["model"]).first()
    assert (r["n_rows"], r["unmatched"], r["ambiguous"], r["label_conflict"], r["rule_conflict"]) == (3, 1, 1, 1, 1)
    lens = spark.createDataFrame([("u", "x", 1), ("u", "y", 5), ("v", "x", 2)], "u string, m string, n int")
    got = {r["u"]: r for r in audit.complete_lengths(lens, "u", "m", "n", ["x", "y"]).collect()}
    assert got["u"]["complete"] and got["u"]["longest"] == 5 and not got["v"]["complete"]
    lock = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    assert sorted(map(tuple, audit.lock_diff(lock, now).collect())) == [("b", "changed"), ("c", "missing"), ("d", "new")]
