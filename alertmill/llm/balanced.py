"""Samples with target category proportions by the cube method on category and margin indicators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_form
from ..session import bind, materialize

#: Candidate records that one flight task holds, and flights merged into one on the level above.
FLIGHT_ROWS, FAN_IN = 50_000, 32
_NEAR = 1e-9


def settle(p: np.ndarray) -> np.ndarray:
    """Probabilities within rounding error of 0 or 1 become 0 or 1."""
    return np.where(p <= _NEAR, 0.0, np.where(p >= 1 - _NEAR, 1.0, p))


def equal_flight(p: np.ndarray, cat: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase where all records of a category have one probability, all categories at once.

    The walk along the null vectors (+1, -1) of a category's indicator ends, from equal probabilities p, at any
    floor(n p) of its n records with 1, one more open with what is left over, the others with 0, each choice equally
    likely: sums are kept and expectations are p. That end is drawn directly.
    """
    order = np.lexsort((rng.random(len(p)), cat))
    c = cat[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, size)
    goal = p[order] * np.repeat(size, size)
    whole = np.floor(goal + _NEAR)
    out = np.empty_like(p)
    out[order] = np.where(rank < whole, 1.0, np.where(rank == whole, settle(goal - whole), 0.0))
    return out


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase for any balancing variables x (records x variables): p walks to 0 or 1 along null vectors of x.

    A window of open records, one more than there are variables, always has a direction that changes no sum of x; a step
    goes as far as one of them is resolved, up or down with the odds that keep every expectation. It ends when the open
    records have no such direction left.
    """
    p = settle(p.copy())
    todo = list(rng.permutation(np.flatnonzero((p > 0) & (p < 1))))
    window: list[int] = []
    while True:
        while todo and len(window) <= x.shape[1]:
            window.append(todo.pop())
        if not window:
            return p
        a = x[window]
        _, s, vt = np.linalg.svd(a.T)
        rank = int((s > 1e-9 * max(1.0, s.max(initial=0.0))).sum())
        if rank >= len(window):
            return p
        u = vt[rank]
        u[np.abs(u) < 1e-12] = 0.0
        q = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.nanmin(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = np.nanmin(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        p[window] = settle(q + (up if rng.random() * (up + down) < down else -down) * u)
        window = [i for i in window if 0 < p[i] < 1]


def landing(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing phase: balancing variables are given up from the last on until all records are resolved.

    The first variable is the plan's total, so that it is given up last: it moves by less than 1.
    """
    for n in range(x.shape[1], 0, -1):
        p = flight(p, x[:, :n], rng)
        if not ((p > 0) & (p < 1)).any():
            return p
    at = np.flatnonzero((p > 0) & (p < 1))
    edges = np.floor(np.concatenate([[0], np.cumsum(p[at])]) + rng.random())
    p[at] = np.diff(edges)
    return p


def margins(s: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
    """Balancing variables of records of one plan: total, indicators of the strata, of the labels, and of the categories."""
    both = pd.factorize(pd.Series(s) + "\x01" + pd.Series(l))[0]
    cols = [np.ones((len(s), 1))]
    for codes in (pd.factorize(s)[0], pd.factorize(l)[0], both):
        cols.append((codes[:, None] == np.arange(codes.max() + 1)).astype(float))
    return np.hstack(cols)


def _fly(seed: int, level: int, last: bool, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["plan", "s", "l", "mix", "unit"], kind="stable").reset_index(drop=True)
    rng = np.random.default_rng([seed, level, int(pdf["bucket"].iloc[0])])
    p = settle(pdf["p"].to_numpy(float))
    cat = pdf.groupby(["plan", "s", "l"], sort=False).ngroup().to_numpy()
    if level == 0:
        p = equal_flight(p, cat, rng)
    else:
        # at most FAN_IN open records of a category come up from the level below
        for idx in pdf.groupby(["plan", "s", "l"], sort=False).indices.values():
            p[idx] = flight(p[idx], np.ones((len(idx), 1)), rng)
    if last:
        for idx in pdf.groupby("plan", sort=False).indices.values():
            idx = idx[(p[idx] > 0) & (p[idx] < 1)]  # at most one record a category
            if len(idx):
                p[idx] = landing(p[idx], margins(pdf["s"].to_numpy()[idx], pdf["l"].to_numpy()[idx]), rng)
    pdf["p"] = p
    return pdf


def categories(frame: DataFrame, unit: str, stratum: str, label: str) -> DataFrame:
    """(unit, s, l): one row per distinct unit and category by plain form; a unit in two categories counts in each."""
    keyed = frame.filter(F.col(unit).isNotNull() & F.col(stratum).isNotNull() & F.col(label).isNotNull())
    return keyed.select(F.col(unit).alias("unit"), plain_form(F.col(stratum)).alias("s"), plain_form(F.col(label)).alias("l")).distinct()


def plan_sizes(frame: DataFrame, targets: DataFrame) -> DataFrame:
    """targets beside: s, l (plain forms), n_frame, n_available, exact, wanted.

    exact is the target's share of the plan's sample; wanted is that, but at least min_rows and at most what there is.
    """
    have = frame.groupBy("s", "l").agg(F.count(F.lit(1)).alias("n_available"))
    size = frame.agg(F.count_distinct("unit").alias("n_frame"))
    t = targets.withColumns({"s": plain_form(F.col("stratum")), "l": plain_form(F.col("label"))})
    t = t.join(have, ["s", "l"], "left").crossJoin(F.broadcast(size))  # size: one row
    t = t.withColumn("n_available", F.coalesce("n_available", F.lit(0).cast("long")))
    t = t.withColumn("exact", F.col("n_frame") * F.col("target_permille") * F.col("frame_permille") / 1_000_000)
    wanted = F.least(F.col("n_available").cast("double"), F.greatest("exact", F.col("min_rows").cast("double")))
    return t.withColumn("wanted", F.coalesce(wanted, F.lit(0.0)))


def candidates(frame: DataFrame, sizes: DataFrame) -> DataFrame:
    """(plan_id, s, l, unit, p): for every plan each unit once, in one of its categories, with its inclusion probability.

    A unit of several categories goes to the one that is asked for the largest part of what it has (ties by name), so that
    it cannot be drawn twice for a plan and scarce categories keep theirs; p is what is wanted over what is left to draw.
    Equal targets that a plan states twice count once, with the larger number.
    """
    wish = sizes.filter("wanted > 0 and plan_id is not null").groupBy("plan_id", "s", "l").agg(F.max("wanted").alias("wanted"), F.max("n_available").alias("_n"))
    per_unit = frame.groupBy("unit").agg(F.count(F.lit(1)).alias("_k"), F.min("s").alias("s"), F.min("l").alias("l"))
    per_unit = materialize(per_unit, "units")
    plain = per_unit.filter("_k = 1").select("unit", "s", "l").join(wish, ["s", "l"]).select("plan_id", "unit", "s", "l")
    # only units of several categories are decided plan by plan
    several = frame.join(per_unit.filter("_k > 1").select("unit"), "unit", "left_semi").join(wish, ["s", "l"])
    asked = several.select("plan_id", "unit", F.struct((F.col("wanted") / F.col("_n")).alias("need"), "s", "l").alias("_c"))
    chosen = asked.groupBy("plan_id", "unit").agg(F.max("_c").alias("_c")).select("plan_id", "unit", "_c.s", "_c.l")
    one = materialize(plain.unionByName(chosen), "candidates")
    left = one.groupBy("plan_id", "s", "l").agg(F.count(F.lit(1)).alias("_left")).join(wish, ["plan_id", "s", "l"])
    per = left.select("plan_id", "s", "l", F.least(F.lit(1.0), F.col("wanted") / F.col("_left")).alias("p"))
    return one.join(per, ["plan_id", "s", "l"]).select("plan_id", "s", "l", "unit", "p")


def cube_sample(drawable: DataFrame, seed: int = 29) -> DataFrame:
    """(plan_id, s, l, unit): the records drawn for every plan from candidates (plan_id, s, l, unit, p).

    Flights run in parallel on records dealt by hash, each leaving at most one open record per plan and category; those
    merge FAN_IN to one, level by level. The top level flies on with the margins as balancing variables (total, strata,
    labels, categories) and lands, giving up categories first and the total last: every category and margin gets its
    wanted number, rounded up or down where that is possible at once.
    """
    sure = drawable.filter(F.col("p") >= 1 - _NEAR).select("plan_id", "s", "l", "unit")
    loose = drawable.filter(F.col("p") < 1 - _NEAR).select(
        F.col("plan_id").alias("plan"), "s", "l", "unit", "p", F.xxhash64(F.lit(seed), "plan_id", "unit").alias("mix")
    )
    loose = materialize(loose, "loose")
    n = -(-loose.count() // FLIGHT_ROWS) or 1
    level_in = loose.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "unit"), F.lit(n)))
    done, level = [sure], 0
    while True:
        schema = ", ".join(f"{c} {t}" for c, t in level_in.dtypes)
        flown = materialize(level_in.groupBy("bucket").applyInPandas(bind(_fly, seed, level, n == 1), schema), f"flight{level}")
        done.append(flown.filter("p = 1").select(F.col("plan").alias("plan_id"), "s", "l", "unit"))
        if n == 1:
            break
        n = -(-n // FAN_IN)
        level_in = flown.filter("p > 0 and p < 1").withColumn("bucket", F.pmod("bucket", F.lit(n)))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def sample_report(frame: DataFrame, targets: DataFrame, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """(sample, report). report: every row of targets with n_available, n_frame, exact, wanted, n_drawable, n_drawn,
    residual, as_wanted and met.

    n_drawable counts the category's units that no other category of the plan draws from. as_wanted checks the sample
    that was drawn: n_drawn is what was wanted, as far as it can be drawn, rounded up or down. A target is met if
    n_drawn is not below its exact share (rounded down), its minimum or, where units are short, below either of them
    already by n_available: a flight that went wrong shows here. Targets with a null stratum or label have no records.
    residual is n_drawn minus the exact share.
    """
    sizes = materialize(plan_sizes(frame, targets), "sizes")
    drawable = materialize(candidates(frame, sizes), "drawable")
    sample = materialize(cube_sample(drawable, seed), "sample")
    count = lambda d, name: d.groupBy("plan_id", "s", "l").agg(F.count(F.lit(1)).alias(name))
    r = sizes
    for d, name in ((drawable, "n_drawable"), (sample, "n_drawn")):
        r = r.join(count(d, name), ["plan_id", "s", "l"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    short = (F.col("n_available") * 1_000_000 < F.col("n_frame") * F.col("target_permille") * F.col("frame_permille")) | (F.col("n_available") < F.col("min_rows"))
    # a target that the plan states twice is drawn once, with the larger number
    best = F.max("wanted").over(Window.partitionBy("plan_id", "s", "l"))
    off = F.col("n_drawn") - F.least(best, F.col("n_drawable").cast("double"))
    r = r.withColumns({"as_wanted": F.abs(off) < 1 - _NEAR, "_short": F.coalesce(short, F.lit(False))})
    too_few = F.col("n_drawn") < F.least(F.floor(F.col("wanted") + _NEAR).cast("double"), F.col("n_drawable").cast("double"))
    return sample, r.withColumns({"met": ~(F.col("_short") | too_few), "residual": F.round(F.col("n_drawn") - F.col("exact"), 6)}).drop("_short")


def margin_residuals(report: DataFrame) -> DataFrame:
    """(plan_id, margin, value, n_drawn, wanted, residual): the plan's total, its strata and its labels."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), v.alias("value")) for m, v in (("total", F.lit(None).cast("string")), ("stratum", F.col("s")), ("label", F.col("l")))])).alias("x")
    once = report.groupBy("plan_id", "s", "l").agg(F.max("n_drawn").alias("n_drawn"), F.max(F.least("wanted", "n_drawable")).alias("wanted"))
    sums = once.select("plan_id", each, "n_drawn", "wanted").groupBy("plan_id", "x.margin", "x.value").agg(F.sum("n_drawn").alias("n_drawn"), F.round(F.sum("wanted"), 6).alias("wanted"))
    return sums.withColumn("residual", F.round(F.col("n_drawn") - F.col("wanted"), 6))
