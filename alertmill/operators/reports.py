"""Latency and token statistics, cells over several groupings, histograms, folds, reported against recomputed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .skew import join_hot_aware, prefix_sums


def interpolated_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column per share): quantiles interpolated between the two ranks next to share * (n - 1).

    Rows shrink to distinct values with counts, whose running sums over range partitions give the ranks: a group's values
    are never gathered in one buffer. NaN and null are left out; a group without values has no row.
    """
    keys = by or ["_all"]
    v = rows.withColumn("_all", F.lit(0)).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = v.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(counted, keys, "_v", ["_c"])
    sizes = materialize(cum.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d")), "sizes")
    ranked = join_hot_aware(cum, sizes, keys, "_d", null_safe=True)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_c_cum") > rank) & (F.col("_c_cum") - F.col("_c") <= rank), F.col("_v")))

    where = {k: F.lit(q) * (F.col("_n") - 1) for k, q in shares.items()}
    ends = [f(F.floor(w), F.ceil(w)).alias(f"_{k}_{i}") for k, w in where.items() for i, f in enumerate((lambda lo, hi: at(lo), lambda lo, hi: at(hi)))]
    got = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)
    mixed = [(F.col(f"_{k}_0") + (F.col(f"_{k}_1") - F.col(f"_{k}_0")) * (w - F.floor(w))).alias(k) for k, w in where.items()]
    return got.select(*by, *mixed)


def latency_stats(rows: DataFrame, by: list[str], value: str, calls: int | None = None) -> DataFrame:
    """(by, n, mean, median, least, most, p95, projected_hours); median and p95 interpolate, for picked elements see rank_element.

    NaN and null are left out.
    """
    v = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    g = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    q = interpolated_quantiles(v, by, value, {"median": 0.5, "p95": 0.95})
    both = g.join(q, reduce(lambda a, b: a & b, [g[c].eqNullSafe(q[c]) for c in by])) if by else g.crossJoin(q)  # one row each
    out = both.select(*[g[c] for c in by], "n", "mean", "median", "least", "most", "p95")
    if calls:
        out = out.withColumn("projected_hours", F.col("mean") * calls / 3600)
    return out


def rank_element(rows: DataFrame, value: str, position) -> DataFrame:  # noqa: ANN001
    """One row (n, element): the element of the sorted values at position(n), counted from 0. Ordered by range partitions."""
    v = rows.select(F.col(value).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    counted = v.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    cum = prefix_sums(counted.withColumn("_a", F.lit(0)), ["_a"], "v", ["c"])
    n = counted.agg(F.sum("c").alias("n"))
    at = cum.crossJoin(F.broadcast(n))  # one row
    return at.filter((F.col("c_cum") > position(F.col("n"))) & (F.col("c_cum") - F.col("c") <= position(F.col("n")))).select("n", F.col("v").alias("element"))


def grouped_cells(rows: DataFrame, groupings: list[str], pred: str = "pred", score: str = "score") -> DataFrame:
    """(grouping, value, n, invalid, invalid_rate, score_available, score_coverage) for each grouping column, in one pass."""
    sets = rows.groupingSets([[F.col(g)] for g in groupings], *groupings).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred).isNull()).alias("invalid"), F.count(score).alias("score_available"),
        *[F.grouping(g).alias(f"_g_{g}") for g in groupings],
    )
    which = F.coalesce(*[F.when(F.col(f"_g_{g}") == 0, F.lit(g)) for g in groupings])
    value = F.coalesce(*[F.when(F.col(f"_g_{g}") == 0, F.coalesce(F.col(g).cast("string"), F.lit("(null)"))) for g in groupings])
    return sets.select(
        which.alias("grouping"), value.alias("value"), "n", "invalid", (F.col("invalid") / F.col("n")).alias("invalid_rate"), "score_available",
        (F.col("score_available") / F.col("n")).alias("score_coverage"),
    )


def over_limit(lengths: DataFrame, by: list[str], value: str, limit: int) -> DataFrame:
    return lengths.groupBy(*by).agg(F.max(value).alias("longest"), F.count_if(F.col(value) > limit).alias("over_limit"))


def value_types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value_type, n): null or the type of every value; of a variant column, the type that each value has."""
    kinds = dict(rows.dtypes)
    of = lambda c: F.lower(F.regexp_extract(F.schema_of_variant(c), r"^\w+", 0)) if kinds[c] == "variant" else F.lit(kinds[c])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNull(), "null").otherwise(of(c)).alias("value_type")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.column_name", "x.value_type").agg(F.count(F.lit(1)).alias("n"))


def keyword_counts(texts: DataFrame, by: list[str], text: str, word: str) -> DataFrame:
    return texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains(F.lower(F.col(text)), F.lit(word))).alias("n_with_word"))


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by the value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.asc_nulls_first(column)).limit(n)


def fold_report(rows: DataFrame, strata: list[str], fold: str = "fold", rule: str = "rule_name", key: str = "key") -> DataFrame:
    """Per fold: rows, rules, classes, strata, training rows, rules and keys that also lie in other folds, missing classes."""
    base = rows.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(rule, F.lit(""))).alias("n_rules"), F.count_if(F.col("label") == "Attack").alias("attack"),
        F.count_if(F.col("label") == "Non-Attack").alias("non_attack"), *[F.count_if(F.col("stratum") == s).alias(s) for s in strata],
    )
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    shared = None
    for c, name in ((rule, "rule_overlap"), (key, "key_overlap")):
        per = rows.select(F.coalesce(F.col(c), F.lit("")).alias("_v"), fold).distinct()
        many = per.groupBy("_v").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1")
        hits = per.join(many, "_v").groupBy(fold).agg(F.count(F.lit(1)).alias(name))
        shared = hits if shared is None else shared.join(hits, fold, "full_outer")
    out = base.crossJoin(F.broadcast(total)).join(shared, fold, "left")  # total: one row
    lacking = F.concat_ws(",", F.when(F.col("attack") == 0, "Attack"), F.when(F.col("non_attack") == 0, "Non-Attack"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("rule_overlap", "key_overlap")}
    return out.withColumns(zero | {"train_n": F.col("_all") - F.col("n"), "missing_class": lacking}).drop("_all")


def reported_vs_recomputed(reported: DataFrame, recomputed: DataFrame, on: str, columns: list[str], digits: int = 6) -> DataFrame:
    """(on, column_name, reported, recomputed, same): equal after rounding both to the digits."""
    r = reported.select(on, *[F.col(c).alias(f"_r_{c}") for c in columns]).join(recomputed.select(on, *columns), on)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(f"_r_{c}", digits).alias("reported"), F.round(c, digits).alias("recomputed")) for c in columns])
    return r.select(on, F.explode(rows).alias("x")).select(on, "x.*").withColumn("same", F.col("reported").eqNullSafe(F.col("recomputed")))
