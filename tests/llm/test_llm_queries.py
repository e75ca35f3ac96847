import pytest


@pytest.mark.parametrize("name", ["p1_counts", "p2_merged", "p4_balance", "p6_report", "p7_sample", "p9_fill", "p10_restored"])
def test_queries_run_on_the_smallest_tables(spark, name):
    from alertmill.llm.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import re

    root = Path(__file__).resolve().parents[2] / "alertmill"
    assert [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"import llm|\.llm\b|llm import", p.read_text())] == []
