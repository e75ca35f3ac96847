"""Bootstrap by draws and multiplicities: replicates are pure functions of a seed, rows are never copied around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import confusion, rates
from .skew import join_hot_aware, rank_within

#: Ranked units that are broadcast to the draws (counted first); more of them are joined by shuffle.
BROADCAST_UNITS = 200_000


def _draws(units: DataFrame, unit: str, group: str, columns: list[str], replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(draws (rep, group, rank), ranked units (group, rank, unit, columns)).

    Position p of a group draws the unit of rank 1 + hash(seed, rep, group, p) mod size, so a replicate is a pure function
    of the seed. Units must be distinct; a null group is a group.
    """
    named = units.select(unit, F.coalesce(group, F.lit("")).alias(group), *[c for c in columns if c not in (unit, group)])
    ranked = materialize(rank_within(named, group, [unit], "rank"), "ranked")
    sizes = materialize(ranked.groupBy(group).agg(F.count(F.lit(1)).alias("size")), "sizes")
    # a few thousand rows become millions of draws: they are dealt to all cores first, which AQE would not do for their size
    cores = max(units.sparkSession.sparkContext.defaultParallelism, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = join_hot_aware(ranked.select(group, "rank"), sizes, [group], "size").repartition(cores, "rank")
    draws = places.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col(group), F.col("rank").cast("string"))
    to = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("size") + 1
    return draws.select("rep", group, to.alias("rank")), ranked


def resample(units: DataFrame, unit: str, group: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """(rep, columns): one row per draw, with replacement within the unit's group. Lazy: aggregates combine where it is drawn."""
    draws, ranked = _draws(units, unit, group, columns, replicates, seed)
    few = ranked.count() <= BROADCAST_UNITS
    look_up = ranked.select(group, "rank", *[c for c in columns if c != group])
    return draws.join(F.broadcast(look_up) if few else look_up, [group, "rank"]).select("rep", *columns)


def multiplicities(units: DataFrame, unit: str, group: str, replicates: int, seed: int, columns: list[str] | None = None) -> DataFrame:
    """(rep, unit, m, columns of the unit): how often each unit is drawn in each replicate; units not drawn have no row."""
    draws, ranked = _draws(units, unit, group, columns or [], replicates, seed)
    counted = draws.groupBy("rep", group, "rank").agg(F.count(F.lit(1)).alias("m"))
    few = ranked.count() <= BROADCAST_UNITS
    return counted.join(F.broadcast(ranked) if few else ranked, [group, "rank"]).select("rep", unit, "m", *(columns or []))


def cluster_multiplicities(units: DataFrame, cluster: str, cluster_type: str, replicates: int, seed: int) -> DataFrame:
    """(rep, cluster, m): whole clusters drawn within their type. A cluster with two types raises."""
    c = units.groupBy(cluster).agg(F.min(cluster_type).alias("type"), F.max(cluster_type).alias("_t2"))
    checked = F.when(F.col("type") == F.col("_t2"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("more than one type: "), F.col(cluster).cast("string"))))
    return multiplicities(c.select(cluster, checked.alias("type")), cluster, "type", replicates, seed)


def weighted_cells(units: DataFrame, unit: str, group: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """(rep, columns, m): draws per combination of the columns. Replicate 0 is the units themselves, for point estimates."""
    drawn = resample(units, unit, group, columns, replicates, seed).groupBy("rep", *columns).agg(F.count(F.lit(1)).alias("m"))
    whole = units.groupBy(*columns).agg(F.count(F.lit(1)).alias("m")).select(F.lit(0).alias("rep"), *columns, "m")
    return drawn.unionByName(whole)


def cluster_cells(rows: DataFrame, cluster: str, cluster_type: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """weighted_cells where whole clusters are drawn: every row of a cluster counts as often as its cluster was drawn."""
    per = rows.groupBy(cluster, *columns).agg(F.count(F.lit(1)).alias("_n"))
    reps = cluster_multiplicities(rows.select(cluster, cluster_type), cluster, cluster_type, replicates, seed)
    drawn = reps.join(per, cluster).groupBy("rep", *columns).agg(F.sum(F.col("m") * F.col("_n")).alias("m"))
    whole = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("m")).select(F.lit(0).alias("rep"), *columns, "m")
    return drawn.unionByName(whole)


def replicate_values(cells: DataFrame, statistic: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(rep, by, value) of any statistic: a function from weighted rows (rep, columns, m) to (rep, its own by, value)."""
    return materialize(statistic(cells), "replicates")


def f1_by_system(truth: str, systems: dict[str, str], invalid: str = "failure") -> Callable[[DataFrame], DataFrame]:
    """The statistic F1 of several systems on the same cells; systems: name -> column of predictions."""

    def statistic(cells: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(s).alias("system"), F.col(c).alias("pred")) for s, c in systems.items()])
        long = cells.select("rep", F.col(truth).alias("truth"), "m", F.explode(each).alias("x")).select("rep", "truth", "m", "x.*")
        return rates(confusion(long, ["rep", "system"], "m", invalid)).select("rep", "system", F.col("f1").alias("value"))

    return statistic


def replicate_metrics(rows: DataFrame, reps: DataFrame, on: str, by: list[str], weight: str | None = None, invalid: str = "failure") -> DataFrame:
    """Confusion and rates per (rep, by): row weight times multiplicity, summed. Long rows (by, truth, pred, on)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    joined = rows.join(reps, on).withColumn("_m", w * F.col("m"))
    return rates(confusion(joined, ["rep", *by], "_m", invalid))


def percentile_ci(values: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """(by, lo, hi, n_undefined): linear-interpolated percentile interval over the non-null replicates, a few thousand a group."""
    return values.groupBy(*by).agg(
        F.percentile(value, alpha / 2).alias("lo"), F.percentile(value, 1 - alpha / 2).alias("hi"), F.count_if(F.col(value).isNull()).alias("n_undefined")
    )


def intervals(values: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by, point, lo, hi, n_undefined) of replicate_values: the value of replicate 0 beside the interval of the others."""
    at = F.when(F.col("rep") > 0, F.col("value"))
    return values.groupBy(*by).agg(
        F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("point"), F.percentile(at, alpha / 2).alias("lo"), F.percentile(at, 1 - alpha / 2).alias("hi"),
        F.count_if((F.col("rep") > 0) & F.col("value").isNull()).alias("n_undefined"),
    )


def paired_differences(values: DataFrame, system: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(rep, a, b, difference) on shared replicates; null if either side is undefined."""
    names = F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in pairs]))
    per_rep = values.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct(system, value))).alias("v"))  # one entry a system
    return per_rep.select("rep", "v", names.alias("p")).select("rep", "p.a", "p.b", (F.col("v")[F.col("p.a")] - F.col("v")[F.col("p.b")]).alias("difference"))
