"""Weighted confusion metrics and rank AUROC, always by arbitrary grouping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_attack
from .skew import prefix_sums

INVALID_POLICIES = ("failure", "exclude")


def confusion(rows: DataFrame, by: list[str], weight: str | None = None, invalid: str = "failure", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(by, tp, fp, tn, fn, n, n_invalid): weighted counts.

    A null prediction counts as the wrong label under ``failure`` and is left out under ``exclude``; n_invalid counts it
    either way. Rows without a truth or with a null weight take no part. No rows, no groups.
    """
    if invalid not in INVALID_POLICIES:
        raise ValueError(invalid)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    t, p = is_attack(F.col(truth)), is_attack(F.col(pred))
    base = rows.select(*by, w.alias("_w"), t.alias("_t"), p.alias("_p")).filter("_t is not null and _w is not null")
    eff = F.coalesce(F.col("_p"), ~F.col("_t")) if invalid == "failure" else F.col("_p")
    cell = lambda a, b: F.coalesce(F.sum(F.when((F.col("_t") == a) & (F.col("_e") == b), F.col("_w"))), F.lit(0.0))
    return base.withColumn("_e", eff).groupBy(*by).agg(
        cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(False, False).alias("tn"), cell(True, False).alias("fn"),
        F.count("_e").alias("n"), F.count_if(F.col("_p").isNull()).alias("n_invalid"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def rates(counts: DataFrame) -> DataFrame:
    """Adds tpr, fpr, precision, f1, balanced_accuracy. Undefined is null, but f1 is 0 whenever tp is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"tpr": _ratio(tp, tp + fn), "fpr": _ratio(fp, fp + tn), "precision": _ratio(tp, tp + fp)})
    f1 = F.when(tp == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn))
    return out.withColumns({"f1": f1, "balanced_accuracy": (F.col("tpr") + 1 - F.col("fpr")) / 2})


def zero_rates(counts: DataFrame) -> DataFrame:
    """The other metric family: tpr, fpr, precision, f1 with 0 where undefined, f1 as the harmonic mean of the two rates."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    zero = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    out = counts.withColumns({"tpr": zero(tp, tp + fn), "fpr": zero(fp, fp + tn), "precision": zero(tp, tp + fp)})
    return out.withColumn("f1", zero(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr")))


def hard_metrics(rows: DataFrame, by: list[str], weight: str | None = None, invalid: str = "failure") -> DataFrame:
    return rates(confusion(rows, by, weight, invalid))


def valid_coverage(rows: DataFrame, by: list[str], pred: str = "pred") -> DataFrame:
    return rows.groupBy(*by).agg((F.count(pred) / F.count(F.lit(1))).alias("coverage"))


def auroc(rows: DataFrame, by: list[str], score: str = "score", truth: str = "truth", weight: str | None = None) -> DataFrame:
    """(by, auroc): weighted Mann-Whitney with ties counted half; null where a class has no weight.

    Rows shrink to distinct scores before anything is ordered, and the running sums are taken over range partitions. A
    NaN score raises; filter null scores first (they raise as well), or use auroc_bounds.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    t = is_attack(F.col(truth))
    s = F.when(F.col(score).isNull() | F.isnan(score), F.raise_error(F.lit("a score is missing")).cast("double")).otherwise(F.col(score).cast("double"))
    by = by or ["_all"]
    base = rows.withColumn("_all", F.lit(0)).select(*by, s.alias("_s"), F.when(t, w).otherwise(0.0).alias("pos"), F.when(t, 0.0).otherwise(w).alias("neg"))
    per_score = base.groupBy(*by, "_s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cum = prefix_sums(per_score, by, "_s", ["neg"])
    area = F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") / 2))
    both = F.sum("pos") * F.sum("neg")
    return cum.groupBy(*by).agg(F.when(both > 0, area / both).alias("auroc")).drop("_all")


def auroc_bounds(rows: DataFrame, by: list[str], score: str = "score", truth: str = "truth", weight: str | None = None) -> DataFrame:
    """(by, n, n_available, coverage, auroc, lower, upper): primary on available scores, bounds with missing ones filled.

    The lower bound gives missing positives 0 and missing negatives 1, the upper bound the reverse. One pass computes all
    three by stacking the variants as one more grouping column.
    """
    t = is_attack(F.col(truth))
    stack = F.array(
        F.struct(F.lit("auroc").alias("v"), F.col(score).cast("double").alias("s")),
        F.struct(F.lit("lower").alias("v"), F.coalesce(F.col(score).cast("double"), F.when(t, 0.0).otherwise(1.0)).alias("s")),
        F.struct(F.lit("upper").alias("v"), F.coalesce(F.col(score).cast("double"), F.when(t, 1.0).otherwise(0.0)).alias("s")),
    )
    keep = [*by, truth] + ([weight] if weight else [])
    long = rows.select(*keep, F.explode(stack).alias("x")).select(*keep, F.col("x.v").alias("variant"), F.col("x.s").alias("_score")).filter("_score is not null")
    wide = auroc(long, [*by, "variant"], "_score", truth, weight).groupBy(*by).pivot("variant", ["auroc", "lower", "upper"]).agg(F.first("auroc"))
    cover = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("n_available"))
    cover = cover.withColumn("coverage", F.col("n_available") / F.col("n"))
    if not by:
        return cover.crossJoin(wide)  # one row each
    return cover.join(wide, by, "left")


def macro_average(metrics: DataFrame, columns: list[str], extra: list[dict] | None = None) -> DataFrame:
    """Unweighted mean of the metrics over systems, with further literal rows where results are known only as numbers."""
    rows = metrics.select(*columns)
    for e in extra or []:
        rows = rows.unionByName(rows.sparkSession.range(1).select(*[F.lit(float(e[c])).alias(c) for c in columns]))
    return rows.agg(F.count(F.lit(1)).alias("n_systems"), *[F.avg(c).alias(c) for c in columns])
