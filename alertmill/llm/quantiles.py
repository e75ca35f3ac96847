"""Percentiles per group by radix selection over order-preserving integers, and mergeable histograms."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

DIGIT, DIGITS = 16, 4
#: A level's list of followed bins is broadcast up to this many rows (24 bytes each, counted first), else joined by shuffle.
BROADCAST_ROWS = 500_000
_FLIP = np.int64(0x7FFF_FFFF_FFFF_FFFF)


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """Doubles as signed integers in the same order; -0.0 counts as 0.0."""
    b = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(b < 0, b ^ _FLIP, b))


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(k: pd.Series) -> pd.Series:
    b = k.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ _FLIP, b).view(np.float64))


def ordered(c: Column) -> Column:
    """A number as its ordered integer; null and NaN give null."""
    x = c.cast("double")
    ok = x.isNotNull() & ~F.isnan(x)
    return F.when(ok, ordered_bits(F.when(ok, x).otherwise(0.0)))


def exact_percentiles(df: DataFrame, groups: list[str], value: str, permilles: list[int], digits: int = DIGITS) -> DataFrame:
    """select_ranks over a numeric column; nulls and NaN are left out."""
    return select_ranks(df.select(*groups, ordered(F.col(value)).alias("_k")).filter("_k is not null"), groups, "_k", permilles, digits)


def _ids(kind: str, groups: list[str]) -> list[Column]:
    """A group's 16-byte id."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("null")) for g in groups]
    return [F.xxhash64(F.lit(seed), F.lit(kind), *parts).alias(f"_g{seed + 1}") for seed in (0, 1)]


def _roll_up(fine: DataFrame, groups: list[str], scopes: dict[str, list[str]]) -> DataFrame:
    """(ids, _p, _c, _lo, _hi): the histograms of every scope. That of all groups is there already, the others add up."""
    cols = ["_p", "_c", "_lo", "_hi"]
    parts = [fine.select(*_ids(s, gs), *cols) for s, gs in scopes.items() if set(gs) == set(groups)]
    coarse = [F.struct(*_ids(s, gs)) for s, gs in scopes.items() if set(gs) != set(groups)]
    if coarse:
        added = fine.select(F.explode(F.array(*coarse)).alias("_i"), *cols).select("_i.*", *cols).groupBy("_g1", "_g2", "_p")
        parts.append(added.agg(F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))
    return reduce(DataFrame.unionByName, parts)


def select_ranks(
    df: DataFrame, groups: list[str], bits_col: str, permilles: list[int], digits: int = DIGITS, scopes: dict[str, list[str]] | None = None
) -> DataFrame:
    """(scope, groups, permille, n, value, lo, hi): the value of rank max(1, ceil(n * permille / 1000)) in each group.

    Radix selection: every level histograms 16 more bits of the ordered integer form, but only of rows whose bits so far
    hold some target rank, and then follows the digit in which the rank falls. Each bin has its count, least and greatest
    value; a rank that falls on the first or last row of its bin, or in a bin of one distinct value, is answered there.
    Rows are counted once a level, by all the groups; histograms add, so each of the ``scopes`` (name -> some of the
    groups, the others come out null) is rolled up from them, as histograms of days or partitions are. All four digits
    give the exact value (lo = hi = value). With fewer, lo and hi are the ends of what the followed bin holds and value is
    lo; two digits (20 bits of mantissa) bound the relative error by 2**-20. A group without a number has no row; null
    group values are a group. Counts combine before the shuffle: a hot or constant group costs its distinct digits only.
    Without scopes there is one, of all groups, and no column scope.
    """
    of = scopes or {"all": groups}
    rows = df.select(*groups, F.col(bits_col).alias("_k"))
    ids = ["_g1", "_g2"]
    each = F.explode(F.array(*[F.struct(*_ids(s, gs)) for s, gs in of.items()])).alias("_i")
    prefix = lambda d: F.shiftright("_k", 64 - DIGIT * d)
    # at most 65,536 bins in any window
    bins = Window.partitionBy(*ids, "_q").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    targets, done, names = None, [], None
    for d in range(1, digits + 1):
        fine = rows.groupBy(*groups, prefix(d).alias("_p")).agg(F.count(F.lit(1)).alias("_c"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
        fine = materialize(fine, f"digit{d}")
        rolled = _roll_up(fine, groups, of)
        if targets is None:
            masked = lambda s, gs: F.struct(F.lit(s).alias("scope"), *[(F.col(g) if g in gs else F.lit(None).cast(dict(df.dtypes)[g])).alias(g) for g in groups], *_ids(s, gs))
            names = fine.select(F.explode(F.array(*[masked(s, gs) for s, gs in of.items()])).alias("_x")).select("_x.*").distinct()
            # one shuffle, by group, serves the total and the running sum
            all_bins = Window.partitionBy(*ids)
            cum = rolled.withColumn("n", F.sum("_c").over(all_bins)).withColumn("_cum", F.sum("_c").over(all_bins.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
            asked = cum.withColumn("permille", F.explode(F.array(*[F.lit(int(p)) for p in permilles])))
            at = asked.withColumn("_r", F.greatest(F.lit(1), F.floor((F.col("n") * F.col("permille") + 999) / 1000)).cast("long"))
        else:
            cum = rolled.withColumn("_q", F.shiftright("_p", DIGIT)).withColumn("_cum", F.sum("_c").over(bins))
            at = targets.join(cum, [*ids, "_q"])
        hit = at.filter((F.col("_cum") >= F.col("_r")) & (F.col("_cum") - F.col("_c") < F.col("_r")))
        at = hit.withColumn("_r", F.col("_r") - F.col("_cum") + F.col("_c"))
        first, last = (F.col("_lo") == F.col("_hi")) | (F.col("_r") == 1), F.col("_r") == F.col("_c")
        got = at.select(*ids, "permille", "n", "_r", F.col("_p").alias("_q"), "_lo", "_hi", F.when(first, F.col("_lo")).when(last, F.col("_hi")).alias("_v"))
        got = materialize(got, f"hits{d}")
        done.append(got.filter("_v is not null").select(*ids, "permille", "n", F.col("_v").alias("_lo"), F.col("_v").alias("_hi")))
        targets = got.filter("_v is null").select(*ids, "permille", "n", "_r", "_q", "_lo", "_hi")
        if d == digits:
            done.append(targets.select(*ids, "permille", "n", "_lo", "_hi"))
            break
        # the bins of the finest groups that some scope follows
        open_bins = targets.select(*ids, F.col("_q").alias("_p")).distinct()
        follow = fine.select(*groups, "_p", each).select(*groups, "_p", "_i.*").join(open_bins, [*ids, "_p"], "left_semi")
        follow = materialize(follow.select(*_ids("fine", groups), "_p").distinct(), f"follow{d}")
        n_bins = follow.count()
        if not n_bins:
            break
        keyed = rows.select(*groups, "_k", *_ids("fine", groups), prefix(d).alias("_p"))
        rows = materialize(keyed.join(F.broadcast(follow) if n_bins <= BROADCAST_ROWS else follow, [*ids, "_p"], "left_semi").select(*groups, "_k"), f"rows{d}")
        targets = targets.drop("_lo", "_hi")
    lo, hi = from_ordered_bits("_lo"), from_ordered_bits("_hi")
    out = reduce(DataFrame.unionByName, done).join(names, ids)
    return out.select(*(["scope"] if scopes else []), *groups, "permille", "n", lo.alias("value"), lo.alias("lo"), hi.alias("hi"))


def histogram(df: DataFrame, groups: list[str], value: str, mantissa_bits: int = 8) -> DataFrame:
    """bit_histogram over a numeric column; nulls and NaN are left out."""
    return bit_histogram(df.select(*groups, ordered(F.col(value)).alias("_k")).filter("_k is not null"), groups, "_k", mantissa_bits)


def bit_histogram(df: DataFrame, groups: list[str], bits_col: str, mantissa_bits: int = 8) -> DataFrame:
    """The mergeable summary: (groups, bin, c) with bins of relative width 2**-mantissa_bits. At most 2**(12+bits) bins a group."""
    return df.groupBy(*groups, F.shiftright(bits_col, 52 - mantissa_bits).alias("bin")).agg(F.count(F.lit(1)).alias("c"))


def merge_histograms(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Histograms of days or partitions added up to the coarser groups."""
    return parts.groupBy(*groups, "bin").agg(F.sum("c").alias("c"))


def histogram_percentiles(hist: DataFrame, groups: list[str], permilles: list[int], mantissa_bits: int = 8) -> DataFrame:
    """(groups, permille, n, lo, hi): the bin that holds the rank; the exact percentile lies within [lo, hi]."""
    w = Window.partitionBy(*groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("c").over(Window.partitionBy(*groups))
    cum = hist.withColumns({"_cum": F.sum("c").over(w), "n": total}).withColumn("permille", F.explode(F.array(*[F.lit(int(p)) for p in permilles])))
    r = F.greatest(F.lit(1), F.floor((F.col("n") * F.col("permille") + 999) / 1000))
    hit = cum.filter((F.col("_cum") >= r) & (F.col("_cum") - F.col("c") < r))
    shift = 52 - mantissa_bits
    low = F.shiftleft("bin", shift)
    return hit.select(*groups, "permille", "n", from_ordered_bits(low).alias("lo"), from_ordered_bits(low + F.lit((1 << shift) - 1)).alias("hi"))
