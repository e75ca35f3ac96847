"""Containers of fixed capacity filled from source queues by deficit round-robin."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot_aware
from ..session import bind, materialize

#: Containers that one packing task fills at most, and containers in a window of the round-robin.
BUCKET_CONTAINERS, WINDOW = 1024, 16
#: A container of a lower level is closed when no more than this many thousandths of it stay free; of the others the
#: emptiest are unpacked and their items handed up.
SLACK_PERMILLE = 10
#: Partitions merged into one on the level above. Each hands up at most BUCKET_CONTAINERS / FAN_IN containers' worth, so
#: a task of the level above is no larger than one below, whatever the sizes of the items.
FAN_IN = 32


def best_fit(items: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Items (size, payload) by falling size, each into the fullest container that still has room."""
    boxes: list[list] = []
    free: list[tuple[int, int]] = []
    for size, payload in sorted(items, key=lambda x: -x[0]):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, box = free.pop(at)
        else:
            room, box = capacity, len(boxes)
            boxes.append([])
        boxes[box].append((size, payload))
        if room > size:
            insort(free, (room - size, box))
    return boxes


def fill_windows(
    queues: dict[object, list[tuple[int, object]]], shares: dict[object, float], deficits: dict[object, float], capacity: int, last: bool, hand_up: int | None = None
) -> tuple[list[list[tuple[int, object]]], list[tuple[int, object]], dict[object, float]]:
    """(closed containers, items left over, deficits left over).

    Deficit round-robin: each window is shared among the queues that still hold items, in proportion to their shares,
    beside what each is still owed; a queue hands out items while its deficit covers them. Queues without a share wait
    until only such are left, and then share alike. Items of containers that stay too empty return to the window that
    follows. After the last window the emptiest ``hand_up`` containers (default: all that are too empty) are left over,
    the others closed; the last level closes every container.
    """
    closed: list = []
    back: list = []
    owed = defaultdict(float, deficits)
    slack = capacity * SLACK_PERMILLE // 1000
    waiting = sorted((q for q in queues if queues[q]), key=str)
    while waiting:
        window = back
        weight = {q: shares.get(q, 0.0) for q in waiting}
        total = sum(weight.values())
        if total <= 0:
            weight, total = dict.fromkeys(waiting, 1.0), float(len(waiting))
        for q in waiting:
            queue = queues[q]
            owed[q] += weight[q] / total * WINDOW * capacity
            while queue and queue[-1][0] <= owed[q]:
                item = queue.pop()
                owed[q] -= item[0]
                window.append(item)
            if not queue:
                owed[q] = 0.0  # an idle queue saves nothing up
        waiting = [q for q in waiting if queues[q]]
        back = []
        for box in best_fit(window, capacity):
            if capacity - sum(s for s, _ in box) <= slack:
                closed.append(box)
            else:
                back += box
    rest = best_fit(back, capacity)
    if last:
        return closed + rest, [], {}
    rest.sort(key=lambda box: sum(s for s, _ in box))
    keep = len(rest) if hand_up is None else hand_up
    return closed + rest[keep:], [x for box in rest[:keep] for x in box], {q: d for q, d in owed.items() if d}


def _pack(capacity: int, level: int, last: bool, pdf: pd.DataFrame) -> pd.DataFrame:
    bucket = int(pdf["bucket"].iloc[0])
    owed = pdf[pdf["part"] < 0]
    items = pdf[pdf["part"] >= 0].sort_values(["mix", "ord", "part"], kind="stable")
    queues: dict[str, list] = defaultdict(list)
    shares: dict[str, float] = dict(zip(pdf["q"].tolist(), pdf["share"].tolist()))
    for i, (q, n) in enumerate(zip(items["q"].tolist(), items["n"].tolist())):
        queues[q].append((n, i))
    hand_up = max(1, BUCKET_CONTAINERS // FAN_IN)
    closed, left, deficits = fill_windows(queues, shares, owed.groupby("q")["owed"].sum().to_dict(), capacity, last, hand_up)
    order = np.array([i for box in closed for _, i in box] + [i for _, i in left], dtype=np.int64)
    box_of = np.repeat(np.arange(len(closed)), [len(b) for b in closed])
    sizes = items["n"].to_numpy(np.int64)[order[: len(box_of)]]
    slot = np.cumsum(sizes) - sizes
    if len(slot):
        firsts = np.flatnonzero(np.diff(box_of, prepend=-1))
        slot = slot - slot[firsts][box_of]
    out = items.iloc[order].reset_index(drop=True)
    pad = [pd.NA] * (len(order) - len(box_of))
    # nullable integers: as floats, large ids would lose their last bits
    out["container"] = pd.array([*((level << 56) | (bucket << 24) | box_of).tolist(), *pad], dtype="Int64")
    out["slot"] = pd.array([*slot.tolist(), *pad], dtype="Int64")
    if deficits:
        none = pd.array([pd.NA] * len(deficits), dtype="Int64")
        rest = pd.DataFrame({"ord": 0, "mix": 0, "q": list(deficits), "share": [shares.get(q, 0.0) for q in deficits], "part": -1, "start": 0, "n": 0, "owed": list(deficits.values()), "bucket": bucket})
        out = pd.concat([out, rest.assign(container=none, slot=none)], ignore_index=True)
    return out[["ord", "mix", "q", "share", "part", "start", "n", "owed", "bucket", "container", "slot"]]


def source_shares(items: DataFrame, source: str, proportions: dict | None) -> DataFrame:
    """(source, share, n_items): every source's part of a window: its weight in the proportions, or its part of the input's units."""
    per = items.groupBy(source).agg(F.sum(F.col("size")).cast("double").alias("_w"), F.count(F.lit(1)).alias("n_items"))
    if proportions is not None:
        want = F.lit(None).cast("double")
        for k, v in proportions.items():
            want = F.when(F.col(source).eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(want)
        per = per.withColumn("_w", F.coalesce(want, F.lit(0.0)))
    total = per.agg(F.sum("_w").alias("_t"))
    share = F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(0.0)
    return per.crossJoin(F.broadcast(total)).select(source, share.alias("share"), "n_items")  # total: one row


def pack(items: DataFrame, id_col: str, size: str, source: str, capacity: int, proportions: dict | None = None) -> DataFrame:
    """(id_col, part, start, n_units, container_id, slot): every item's place; ids are longs.

    Items larger than the capacity are cut into full containers and a rest, all others stay whole. Every source has a
    queue of its own and keeps its share of every window of WINDOW containers (proportions: source -> weight, by default
    the shares of the input; a source with weight 0 or left out is packed after the others, nothing is dropped), with
    deficits carried from window to window and, with the unplaced items, from partitions to the level above. Once a
    source has run out, the others share its part. Items are dealt to partitions by hash, so one source or key of any
    size spreads evenly. Of the containers that stay too empty a bounded number is emptied and their items go up a level,
    FAN_IN partitions into one, until one task closes the last few. Items of size 0 or null need no room and come out
    with a null container. An empty table gives no rows.
    """
    base = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(source).cast("string").alias("source"))
    base = materialize(base, "items")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shares = materialize(source_shares(base, "source", proportions), "shares")
    shared = join_hot_aware(base.filter("size > 0"), shares, ["source"], "n_items", null_safe=True)
    n_buckets = max(1, round(total / (capacity * BUCKET_CONTAINERS)))
    cut = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)))
    level_in = cut.select(
        F.col("id").alias("ord"), F.xxhash64("id", "part").alias("mix"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("q"), "share", "part",
        (F.col("part").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part").cast("long") * capacity).alias("n"),
        F.lit(0.0).alias("owed"), F.pmod(F.xxhash64(F.lit(11), "id", "part"), F.lit(n_buckets)).alias("bucket"),
    )
    schema = "ord long, mix long, q string, share double, part int, start long, n long, owed double, bucket long, container long, slot long"
    done, level = [], 0
    while True:
        last = n_buckets == 1
        packed = materialize(level_in.groupBy("bucket").applyInPandas(bind(_pack, capacity, level, last), schema), f"pack{level}")
        done.append(packed.filter("container is not null"))
        if last:
            break
        n_buckets = -(-n_buckets // FAN_IN)
        level_in = packed.filter("container is null").drop("container", "slot").withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "bucket"), F.lit(n_buckets)))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    placed = out.select(F.col("ord").alias(id_col), "part", "start", F.col("n").alias("n_units"), F.col("container").alias("container_id"), "slot")
    none = base.filter("size = 0").select(
        F.col("id").alias(id_col), F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_units"),
        F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("slot"),
    )
    return placed.unionByName(none)
