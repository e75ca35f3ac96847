"""Deterministic sampling and folds: the same draws whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bind, materialize
from .skew import join_hot_aware, rank_within


def draw_key(seed: int, *parts: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def stratified_sample(pool: DataFrame, stratum: str, unit: str, n: int | dict[str, int], seed: int, strict: bool = False) -> DataFrame:
    """Exactly n units of each stratum (or n[stratum]), without replacement, by rank of a seeded hash.

    Units are distinct within a stratum. A stratum shorter than n is taken whole; with strict it raises instead. Strata
    missing from a dict give nothing. Only hashes are ranked; the rows drawn are fetched by their unit.
    """
    want = F.lit(n) if isinstance(n, int) else F.coalesce(F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(v))])[F.col(stratum)], F.lit(0))
    if strict:
        sizes = pool.groupBy(stratum).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") < want).limit(1).collect()
        if sizes:
            raise ValueError(f"stratum {sizes[0][0]!r} holds only {sizes[0][1]} units")
    most = n if isinstance(n, int) else max(n.values(), default=0)
    thin = pool.select(F.col(stratum).alias("_s"), F.col(unit).alias("_u"), draw_key(seed, unit).alias("_draw"), want.alias("_want"))
    # a rank against a constant: every task keeps its first rows of a stratum before anything is shuffled
    ranked = thin.withColumn("_rank", F.row_number().over(Window.partitionBy("_s").orderBy("_draw", "_u"))).filter(F.col("_rank") <= most)
    drawn = ranked.filter(F.col("_rank") <= F.col("_want")).select("_s", "_u")
    return pool.join(drawn, pool[unit].eqNullSafe(F.col("_u")) & pool[stratum].eqNullSafe(F.col("_s")), "left_semi")


def two_phase_sample(frame: DataFrame, stratum: str, unit: str, n_first: int, n_second: int, seed: int) -> DataFrame:
    """A first draw, then a second from what it left; column phase names the draw. The phases never overlap."""
    first = stratified_sample(frame, stratum, unit, n_first, seed)
    rest = frame.join(first.select(unit), unit, "left_anti")
    second = stratified_sample(rest, stratum, unit, n_second, seed + 1)
    return first.withColumn("phase", F.lit("first")).unionByName(second.withColumn("phase", F.lit("second")))


def permutation(rows: DataFrame, unit: str, seed: int, name: str = "position") -> DataFrame:
    """A fixed random order of the units, from 0."""
    return rank_within(rows.withColumn("_draw", draw_key(seed, unit)), None, ["_draw", unit], name).withColumn(name, F.col(name) - 1).drop("_draw")


def first_in_order(rows: DataFrame, unit: str, seed: int, n: int, name: str = "position") -> DataFrame:
    """The first n units of the permutation with their position, from 0. n rows are all that any task hands on."""
    top = rows.withColumn("_draw", draw_key(seed, unit)).orderBy("_draw", unit).limit(n)
    return top.withColumn(name, (F.row_number().over(Window.orderBy("_draw", unit)) - 1).cast("long")).drop("_draw")


def call_order(rows: DataFrame, unit: str, seed: int, conditions: list[str]) -> DataFrame:
    """Permuted units crossed with the conditions, the conditions of a unit in a row."""
    spread = permutation(rows, unit, seed).select("*", F.posexplode(F.array(*[F.lit(c) for c in conditions])).alias("_c", "condition"))
    return spread.withColumn("call_position", F.col("position") * len(conditions) + F.col("_c")).drop("_c")


def random_folds(rows: DataFrame, unit: str, k: int, seed: int) -> DataFrame:
    """Folds of equal size by permuted position."""
    return permutation(rows, unit, seed).withColumn("fold", (F.col("position") % k).cast("int")).drop("position")


def grouped_folds(rows: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Whole groups in one fold: the groups are permuted, then dealt in turn."""
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    return join_hot_aware(rows, materialize(random_folds(groups, group, k, seed), "dealt"), [group], "_size", null_safe=True).drop("_size")


#: Groups that one greedy task deals.
SHARD_GROUPS = 100_000


def _deal(k: int, n_strata: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy over one shard's groups: long rows (_g, _d, _s, n) -> (_g, fold)."""
    at, first = pd.factorize(pdf["_d"], sort=True)[0], pdf.groupby("_d", sort=True)
    s = pd.factorize(pdf["_s"].map(repr), sort=True)[0]
    v = np.zeros((at.max() + 1, s.max() + 1))
    np.add.at(v, (at, s), pdf["n"].to_numpy(float))
    names = first["_g"].first().reindex(first["_d"].first().to_numpy())
    mean = v.sum(1) / n_strata
    uneven = np.sqrt(np.maximum((v**2).sum(1) / n_strata - mean**2, 0))
    total = np.maximum(v.sum(0), 1)
    sums, sizes, fold = np.zeros((k, v.shape[1])), np.zeros(k), np.zeros(len(v), "int32")
    for i in np.lexsort((np.arange(len(v)), -uneven.round(9))):
        used = np.flatnonzero(v[i])
        part, add = sums[:, used] / total[used], v[i, used] / total[used]
        # variance over the folds, of each stratum that the group has, if the group went to each fold in turn
        mean_after = (part.sum(0) + add) / k
        squares = (part**2).sum(0) + 2 * part * add + add**2
        now = (part**2).sum(0) / k - (part.sum(0) / k) ** 2
        change = (np.sqrt(np.maximum(squares / k - mean_after**2, 0)) - np.sqrt(np.maximum(now, 0))).sum(1)
        best = min(range(k), key=lambda f: (round(change[f], 12), sizes[f]))
        fold[i] = best
        sums[best] += v[i]
        sizes[best] += v[i].sum()
    return pd.DataFrame({"_g": names.to_numpy(), "fold": fold})


def stratified_group_folds(rows: DataFrame, group: str, stratum: str, k: int, seed: int) -> DataFrame:
    """Whole groups in one fold with strata spread evenly: greedy over groups by falling unevenness, ties by seeded hash.

    The greedy pass sees one line per group and stratum (its count). Groups are dealt by hash to as many tasks as
    SHARD_GROUPS asks for, up to which number it is one; each task spreads its own part of every stratum evenly, so their
    sum is even as well, for any number of groups and strata. Null groups and strata are values of their own.
    """
    per = rows.groupBy(F.col(group).alias("_g"), F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    text = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_g").cast("string"), F.lit(""))), 256)
    per = materialize(per.withColumn("_d", F.concat(text, F.when(F.col("_g").isNull(), "n").otherwise("v"))), "groups")
    n_groups, n_strata = per.agg(F.count_distinct("_d"), F.count_distinct(F.coalesce(F.col("_s").cast("string"), F.lit("\0")))).first()
    shards = -(-n_groups // SHARD_GROUPS) or 1
    dealt = per.withColumn("_shard", F.pmod(F.xxhash64("_d"), F.lit(shards)))
    folds = materialize(dealt.groupBy("_shard").applyInPandas(bind(_deal, k, max(n_strata, 1)), f"_g {dict(per.dtypes)['_g']}, fold int"), "folds")
    sizes = per.groupBy("_g").agg(F.sum("n").alias("_n"))
    known = materialize(folds.join(sizes, folds["_g"].eqNullSafe(sizes["_g"])).select(folds["_g"].alias(group), "fold", "_n"), "dealt")
    return join_hot_aware(rows, known, [group], "_n", null_safe=True).drop("_n")
