"""Joins that audit data against data: content matches, splits, completeness, runs, locks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import settings_hash


def content_match(pred: DataFrame, data: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """Per group of predictions: rows, unmatched, ambiguous, label and rule conflicts against the dataset.

    pred (by, key, truth, rule_name), data (key, label, rule_name). The dataset is reduced to one line per key first, so
    the join cannot fan out; conflicts are decided on the least and greatest label and rule of the key.
    """
    per_key = data.withColumn("_r", F.coalesce("rule_name", F.lit(""))).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("label").alias("_l1"), F.max("label").alias("_l2"), F.min("_r").alias("_r1"), F.max("_r").alias("_r2")
    )
    j = pred.join(per_key, key, "left")
    rule = F.coalesce("rule_name", F.lit(""))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_n").isNull()).alias("unmatched"), F.count_if(F.col("_n") > 1).alias("ambiguous"),
        F.count_if((F.col("_l1") != F.col("truth")) | (F.col("_l2") != F.col("truth"))).alias("label_conflict"),
        F.count_if((F.col("_r1") != rule) | (F.col("_r2") != rule)).alias("rule_conflict"),
    )


def matched_flag(pred: DataFrame, data: DataFrame, key: str = "key") -> DataFrame:
    keys = data.select(key).distinct().withColumn("_m", F.lit(True))
    return pred.join(keys, key, "left").withColumn("matched", F.coalesce("_m", F.lit(False))).drop("_m")


def split_audit(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_test_values, n_overlap, n_absent_rows): distinct test values also in train, and test rows whose value is not."""
    out = None
    for c in columns:
        t = train.select(c).distinct().withColumn("_in", F.lit(True))
        per = test.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        j = per.join(t, per[c].eqNullSafe(t[c]), "left").agg(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_test_values"), F.count("_in").alias("n_overlap"),
            F.coalesce(F.sum(F.when(F.col("_in").isNull(), F.col("_n"))), F.lit(0)).alias("n_absent_rows"),
        )
        out = j if out is None else out.unionByName(j)
    return out


def complete_lengths(lengths: DataFrame, unit: str, source: str, value: str, sources: list[str], strict: bool = False) -> DataFrame:
    """(unit, one column per source, longest, complete). With strict any unit that lacks a source raises."""
    wide = lengths.groupBy(unit).pivot(source, sources).agg(F.max(value))
    complete = F.lit(True)
    for s in sources:
        complete = complete & F.col(f"`{s}`").isNotNull()
    if strict:
        complete = F.when(complete, True).otherwise(F.raise_error(F.concat(F.lit("incomplete: "), F.col(unit).cast("string"))).cast("boolean"))
    return wide.withColumns({"longest": F.greatest(*[F.col(f"`{s}`") for s in sources]), "complete": complete})


def compare_runs(a: DataFrame, b: DataFrame, on: list[str], label: str, score: str) -> DataFrame:
    """One row: pairs, identical labels, equal availability, scores compared, greatest absolute difference."""
    x = a.select(*on, F.col(label).alias("_la"), F.col(score).alias("_sa"))
    y = b.select(*on, F.col(label).alias("_lb"), F.col(score).alias("_sb"))
    return x.join(y, on).agg(
        F.count(F.lit(1)).alias("paired"), F.count_if(F.col("_la").eqNullSafe(F.col("_lb"))).alias("identical_labels"),
        F.count_if(F.col("_sa").isNull() == F.col("_sb").isNull()).alias("availability_identical"),
        F.count(F.col("_sa") + F.col("_sb")).alias("scores_compared"), F.max(F.abs(F.col("_sa") - F.col("_sb"))).alias("max_abs_delta"),
    )


def set_report(rows: DataFrame, member: str, group: str) -> DataFrame:
    """One row: groups, members in every group, members in any."""
    per = rows.filter(F.col(member).isNotNull()).groupBy(member).agg(F.count_distinct(group).alias("k"))
    groups = rows.agg(F.count_distinct(group).alias("n_groups"))
    return per.crossJoin(F.broadcast(groups)).agg(  # groups: one row
        F.max("n_groups").alias("n_groups"), F.count_if(F.col("k") == F.col("n_groups")).alias("in_all"), F.count(F.lit(1)).alias("in_any")
    )


def overlap_with(rows: DataFrame, member: str, group: str, first: str | None = None) -> DataFrame:
    """(group, n_common): distinct members of each group that one group, by default the first by name, holds as well."""
    of = rows.agg(F.min(group).alias("_f")) if first is None else rows.sparkSession.range(1).select(F.lit(first).alias("_f"))
    base = rows.join(F.broadcast(of), F.col(group) == F.col("_f"), "left_semi").select(member).distinct()  # of: one row
    return rows.select(group, member).distinct().join(base, member, "left_semi").groupBy(group).agg(F.count(F.lit(1)).alias("n_common"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b (as multisets), and whether both are 0."""
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    both = n(a.exceptAll(b), "only_a").crossJoin(n(b.exceptAll(a), "only_b"))  # one row each
    return both.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def concatenated(manifests: dict[str, DataFrame]) -> DataFrame:
    """Manifests one after another with their name in column manifest: columns of all, null where a manifest lacks one."""
    parts = [d.withColumn("manifest", F.lit(n)) for n, d in manifests.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def lock_entries(files: DataFrame, settings: dict[str, object]) -> DataFrame:
    """The lock of a run, (path, sha256): its files as file_hashes gives them, and each setting as ``setting:<name>``."""
    spark = files.sparkSession
    rows = [(f"setting:{k}", settings_hash({k: v})) for k, v in sorted(settings.items())]
    return files.select("path", "sha256").unionByName(spark.createDataFrame(rows, "path string, sha256 string"))


def lock_diff(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): missing, new or changed files between two (path, sha256) tables."""
    j = recorded.select("path", F.col("sha256").alias("_a")).join(found.select("path", F.col("sha256").alias("_b")), "path", "full_outer")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return j.select("path", problem.alias("problem")).filter("problem is not null")
