import importlib

import pytest


def test_every_query_without_sql_is_known():
    e = importlib.import_module("__spark_entry__")
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "flagship" in q
    core = {k for k, f in q.items() if ".llm." not in f.__module__}
    assert core - set(s) == {"m4_tfidf", "r9_stratified_group_folds", "gates_details"}


@pytest.mark.parametrize("name", ["flagship", "p3_found", "p5_found"])
def test_sample_of_queries_runs(spark, name):
    e = importlib.import_module("__spark_entry__")
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
