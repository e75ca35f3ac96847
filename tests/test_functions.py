import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from alertmill.functions import keys, labels, text

A, N = "Attack", "Non-Attack"


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("answer", "want"), [
    (None, None), ("", None), (" Attack ", A), ("Non-Attack", N), ("Label: Attack", A), ("Label: Non-Attack.", N), ("Attack or Non-Attack", N), ("attack", None), ("I am not sure", None),
])
def test_label_parser(spark, answer, want):
    assert one(spark, answer, labels.parse_label) == want


@pytest.mark.parametrize(("value", "want"), [(None, None), ("", ""), (" A-b_9 ", "ab9"), ("ÜBER（X）", "überx"), ("é", "e"), ("!!", ""), ("Ⅷ½", "ⅷ½")])
def test_plain_form(spark, value, want):
    assert one(spark, value, text.plain_form) == want


def test_uid_and_words(spark):
    assert one(spark, "  AB12\t", text.uid_form) == "ab12"
    assert sorted(one(spark, "GET /a/a?b=É1 x", text.record_words)) == ["a", "b", "get", "x", "é1"]
    assert one(spark, None, text.record_words) == [] and one(spark, "--", text.record_words) == []


def score(spark, positions, a, n):
    schema = "p array<struct<id:int,top_logprobs:array<struct<id:int,logprob:double>>>>, a array<int>, n array<int>"
    df = spark.createDataFrame([([(i, top) for i, top in positions], a, n)], schema)
    return df.select(labels.divergent_token_score(F.col("p"), F.col("a"), F.col("n")).alias("s")).first()["s"]


def test_token_score(spark):
    import math

    top = [(7, math.log(0.6)), (8, math.log(0.2))]
    s = score(spark, [(7, top)], [7], [8])
    assert s["available"] and s["s"] == pytest.approx(0.75)
    assert score(spark, [], [7], [8])["reason"] == "output_ends_early"
    assert score(spark, [(7, top[:1])], [7], [8])["reason"] == "negative_unlisted"
    assert score(spark, [(7, top[1:])], [7], [8])["reason"] == "positive_unlisted"
    assert score(spark, [(7, [])], [7], [8])["reason"] == "neither_listed"
    assert score(spark, [(9, top), (7, top)], [5, 7], [5, 8])["reason"] == "other_prefix"
    assert score(spark, [(5, top), (7, top)], [5, 7], [5, 8, 1])["available"]


def test_classifier_text(spark):
    df = spark.createDataFrame([("A\r\nB\rC", None, 7, "é")], "p string, q string, r int, s string")
    got = df.select(keys.classifier_text(["p", "q", "r", "s"], dict(df.dtypes)).alias("t")).first()["t"]
    assert got == unicodedata.normalize("NFC", "a\nb\nc\n\n7\né")
    with pytest.raises(TypeError):
        keys.classifier_text(["b"], {"b": "boolean"})


def test_canonical_json_is_pythons(spark):
    df = spark.createDataFrame([("é", None, 8, None), ("b\n\"", "x", None, 3)], "z string, a string, n int, m int")
    got = [r[0] for r in df.select(keys.canonical_json(F.struct("z", "a", "n", "m"))).collect()]
    want = [json.dumps({k: v for k, v in zip("zanm", r)}, sort_keys=True, ensure_ascii=False) for r in [("é", None, 8, None), ('b\n"', "x", None, 3)]]
    assert got == want


def test_hard_label_and_dates(spark):
    assert [one(spark, v, labels.hard_label, "double") for v in (0.5, 0.49, None)] == [A, N, None]
    assert one(spark, "on 2026-01-02", keys.mentions_date) and not one(spark, "none", keys.mentions_date)
    assert one(spark, "2026-03-05", lambda c: keys.date_texts(F.to_date(c)))[1] == "5 Mar 2026"
