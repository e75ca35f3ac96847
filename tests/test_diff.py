import random
from collections import Counter

import pytest

from alertmill.operators import diff

FIELDS = ["f", "g"]
SCHEMA = "uid string, f string, g string, at int, k string, h int"


def brute(a, b):
    """Versions of every key on either side, compared as sets of values."""
    l, r, out = {}, {}, []
    for t in a:
        if t[0] is not None and (t[0] not in l or t[3] > l[t[0]][0][3]):
            l[t[0]] = [t]
    for t in b:
        if t[0] is not None:
            r.setdefault(t[0], []).append(t)
    n_left = Counter(t[0] for t in a)
    out += [(u, "only_l", "row", n_left[u]) for u in l if u not in r] + [(u, "only_r", "row", len(r[u])) for u in r if u not in l]
    out += [(u, "differs", n, n_left[u] + len(r[u])) for u in l if u in r for i, n in enumerate(FIELDS, 1) if len({t[i] for t in (*l[u], *r[u])}) > 1]
    out += [(u, "versions_r", n, len(v)) for u, v in r.items() for i, n in enumerate(FIELDS, 1) if len({t[i] for t in v}) > 1]
    lost = [(None, f"no_key_{x}", "row", n) for x, d in (("l", a), ("r", b)) if (n := sum(t[0] is None for t in d))]
    return sorted(out + lost, key=lambda t: [(x is not None, str(x)) for x in t])


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, rows, seed):
    r = random.Random(seed)
    vals = ["x", "y", "", None]
    a = [(f"u{i:04d}", "x", "y", 1, "clash", 5) for i in range(900)]
    b = [t for t in a if r.random() > 0.02] + [(f"v{i}", "x", None, 1, "clash", 5) for i in range(5)]
    a = [t if r.random() > 0.02 else (t[0], r.choice(vals), r.choice(vals), 1, "c", 6) for t in a]
    a += [(t[0], r.choice(vals), t[2], 2, "c", 6) for t in a[:40]] + [(None, "x", "y", 1, "c", 6)]
    b += b[:30] + [(t[0], r.choice(vals), r.choice(vals), 3, "c", 7) for t in b[100:160]] + [(None, "x", None, 1, "c", 6)] * 2
    got = diff.diff_tables(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "uid", FIELDS, ("l", "r"), newest_left=["at"])
    assert rows(got) == brute(a, b)


def test_disagreeing_copies_on_either_side(spark, rows):
    one, two = [("u", "x", "y", 1, "", 1)], [("u", "x", "y", 1, "", 1), ("u", "z", "y", 1, "", 1)]
    run = lambda a, b: rows(diff.diff_tables(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "uid", FIELDS, ("l", "r")))
    assert run(one, two) == [("u", "differs", "f", 3), ("u", "versions_r", "f", 2)]
    assert run(two, one) == [("u", "differs", "f", 3), ("u", "versions_l", "f", 2)]
    assert run(two, two) == [("u", "differs", "f", 4), ("u", "versions_l", "f", 2), ("u", "versions_r", "f", 2)]
    assert run(one, one * 3) == []


def test_one_key_may_hold_a_third_of_the_rows(spark, rows):
    a = [("hot", "x", "y", i, "", 1) for i in range(500)] + [(f"u{i}", "x", "y", 1, "", 1) for i in range(1000)]
    b = [*a[500:], ("hot", "new", "y", 1, "", 1)]
    got = diff.diff_tables(spark.createDataFrame(a, SCHEMA).repartition(4), spark.createDataFrame(b, SCHEMA), "uid", FIELDS, ("l", "r"), newest_left=["at"])
    assert rows(got) == [("hot", "differs", "f", 501)]


def test_empty_sides(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("u", None, "", 1, "", 1)], SCHEMA)
    run = lambda a, b: rows(diff.diff_tables(a, b, "uid", FIELDS, ("l", "r"), newest_left=["at"]))
    assert run(none, none) == []
    assert run(one, none) == [("u", "only_l", "row", 1)]
    assert run(none, one) == [("u", "only_r", "row", 1)]
    assert run(one, one) == []


def test_equal_chunks_never_reach_the_row_join(spark):
    a = spark.createDataFrame([(f"u{i:05d}", str(i), "g", 1, "", 1) for i in range(4000)], SCHEMA)
    changed = spark.createDataFrame([(f"u{i:05d}", "new" if i == 1700 else str(i), "g", 1, "", 1) for i in range(4000)], SCHEMA)
    left, right = diff.unmatched_rows(diff.digest_rows(a, "uid", FIELDS), diff.digest_rows(changed, "uid", FIELDS))
    assert 0 < left.count() < 1500 and 0 < right.count() < 1500
