"""Train / validation / test splits that keep components whole, balanced by parallel annealing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Components that one annealing task holds; it bounds a task's memory whatever the table's size.
SHARD_COMPONENTS = 4096
MOVES_PER_COMPONENT = 40


def anneal(vec: list[dict[int, float]], start: list[int], goal: np.ndarray, seed: int) -> list[int]:
    """Move or exchange whole components; returns the best assignment met.

    vec: per component its rows of each label, start: their splits, goal: splits x labels. The energy is the size
    deviation plus the label deviation; a step looks only at the labels of the components it moves.
    """
    rng = np.random.default_rng(seed)
    k, m = goal.shape[0], len(vec)
    now, off = list(start), [(-row).tolist() for row in goal]
    for v, s in zip(vec, start):
        for label, n in v.items():
            off[s][label] += n
    size = [sum(row) for row in off]
    energy = sum(abs(x) for x in size) + sum(abs(x) for row in off for x in row)
    best, best_energy = list(now), energy
    steps = MOVES_PER_COMPONENT * m
    heat = max(1e-9, energy / 4)
    cool = (0.05 / max(heat, 0.05)) ** (1 / max(steps, 1))
    picks, others, targets, luck = (x.tolist() for x in (rng.integers(m, size=steps), rng.integers(m, size=steps), rng.integers(k, size=steps), rng.random(steps)))
    for i, j, to, u in zip(picks, others, targets, luck):
        heat *= cool
        a = now[i]
        swap = u < 0.5
        b = now[j] if swap else to
        if a == b:
            continue
        change = vec[i]
        if swap:
            change = dict(change)
            for label, n in vec[j].items():
                change[label] = change.get(label, 0.0) - n
        from_, into, moved, delta = off[a], off[b], 0.0, 0.0
        for label, n in change.items():
            x, y = from_[label], into[label]
            delta += abs(x - n) - abs(x) + abs(y + n) - abs(y)
            moved += n
        delta += abs(size[a] - moved) - abs(size[a]) + abs(size[b] + moved) - abs(size[b])
        if delta <= 0 or (u * 2 % 1) < np.exp(-delta / heat):
            for label, n in change.items():
                from_[label] -= n
                into[label] += n
            size[a] -= moved
            size[b] += moved
            now[i] = b
            if swap:
                now[j] = a
            energy += delta
            if energy < best_energy - 1e-9:
                best, best_energy = list(now), energy
    return best


def _shard(seed: int, turn: int, comps: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """One shard of one replica. marks: per label of the shard its rows in all, and how far each split as a whole is off its
    target, of which the shard takes the part that it holds of the label."""
    comps = comps.sort_values("c", kind="stable").reset_index(drop=True)
    marks = marks.sort_values("l").reset_index(drop=True)
    at_label = {label: i for i, label in enumerate(marks["l"].tolist())}
    vec = [{at_label[x["l"]]: float(x["n"]) for x in labels} for labels in comps["labels"]]
    start = comps["at"].tolist()
    off = np.stack([np.asarray(x, float) for x in marks["off"]]).T  # splits x labels
    here = np.zeros_like(off)
    for v, s in zip(vec, start):
        for label, n in v.items():
            here[s, label] += n
    goal = here - off * (here.sum(0) / np.maximum(marks["total"].to_numpy(float), 1))
    rep, shard = int(comps["rep"].iloc[0]), int(comps["shard"].iloc[0])
    comps["at"] = np.asarray(anneal(vec, start, goal, seed * 1_000_003 + rep * 10_007 + shard * 101 + turn), dtype="int32")
    return comps[["c", "labels", "at", "rep"]]


def label_residuals(state: DataFrame, share: list[float]) -> DataFrame:
    """(rep, l, off, total): per replica and label the rows in all, and by how many every split is off its share of them."""
    long = state.select("rep", "at", F.explode("labels").alias("x")).groupBy("rep", "at", F.col("x.l").alias("l")).agg(F.sum("x.n").alias("n"))
    counts = [F.coalesce(F.sum(F.when(F.col("at") == i, F.col("n"))), F.lit(0)) for i in range(len(share))]
    per = long.groupBy("rep", "l").agg(F.sum("n").alias("total"), F.array(*counts).alias("_n"))
    off = F.array(*[F.element_at("_n", i + 1) - F.col("total") * F.lit(s) for i, s in enumerate(share)])
    return per.select("rep", "l", off.alias("off"), "total")


def component_splits(
    rows: DataFrame, component: str, label: str, shares: dict[str, int], seed: int = 17, replicas: int = 4, rounds: int = 2
) -> DataFrame:
    """(component, split): one split per component, proportions ``shares`` (thousandths that sum to 1000).

    Every component starts in a split by its hash. Components are dealt to shards of bounded size; shards of all replicas
    anneal in parallel, each working off its part of the deviation that the replica has as a whole; a second round deals
    anew. The replica with the least deviation is kept; the hashed start itself competes. Labels are any number of
    values, each balanced on its own; null is a label. A component larger than a split's share is placed whole all the
    same: components are never cut. An empty table gives no rows. The result depends on seed, not on partitioning.
    """
    names = list(shares)
    share = [shares[n] / 1000 for n in names]
    value = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")))
    per = rows.groupBy(F.col(component).alias("c"), value.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    # a component's list is as long as it has labels
    comps = per.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("l", "n"))).alias("labels"))
    edges = np.cumsum([shares[n] for n in names])
    draw = F.pmod(F.xxhash64(F.lit(seed), "c"), F.lit(1000))
    first = F.lit(len(names) - 1)
    for i in reversed(range(len(names) - 1)):
        first = F.when(draw < int(edges[i]), i).otherwise(first)
    hashed = materialize(comps.withColumn("at", first.cast("int")), "comps")
    n_shards = max(1, -(-hashed.count() // SHARD_COMPONENTS))
    state = hashed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicas))))  # replica 0 stays as hashed
    schema = ", ".join(f"{c} {t}" for c, t in state.dtypes)
    for turn in range(rounds):
        residuals = materialize(label_residuals(state, share), "residuals")
        dealt = state.filter("rep > 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + turn), "c"), F.lit(n_shards)).cast("int"))
        used = dealt.select("rep", "shard", F.explode("labels.l").alias("l")).distinct().join(residuals, ["rep", "l"])
        used = used.select(F.col("rep").alias("_rep"), F.col("shard").alias("_shard"), "l", "off", "total")
        moved = dealt.groupBy("rep", "shard").cogroup(used.groupBy("_rep", "_shard")).applyInPandas(_bound(seed, turn), schema)
        state = materialize(moved.unionByName(state.filter("rep = 0").select(*moved.columns)), "anneal")
    last = label_residuals(state, share)
    spread = [F.abs(F.sum(F.element_at("off", i + 1))) for i in range(len(names))]
    inside = F.sum(F.aggregate("off", F.lit(0.0), lambda acc, x: acc + F.abs(x)))
    scores = last.groupBy("rep").agg(F.round(sum(spread, inside), 6).alias("s")).collect()  # one row a replica
    keep = min(((r["s"], r["rep"]) for r in scores), default=(0, 0))[1]
    return state.filter(F.col("rep") == keep).select(F.col("c").alias(component), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1).alias("split"))


def _bound(seed: int, turn: int):  # noqa: ANN202
    def run(comps: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        return _shard(seed, turn, comps, marks)

    return run
