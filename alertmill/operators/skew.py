"""Per-key work that stays balanced when a handful of keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bind, materialize

#: A key is hot when it holds at least this fraction of all rows; there are at most as many hot keys as its inverse.
HOT_FRACTION = 1 / 1024


def join_hot_aware(rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str, total: int | None = None, null_safe: bool = False, hint: str | None = None) -> DataFrame:
    """Inner join of rows with groups (unique on keys, count_col = rows of the key) without a hot reducer.

    Groups with at least HOT_FRACTION of the total rows (by default the sum of count_col) - by that definition no more than
    1/HOT_FRACTION of them - are broadcast; all others go through a shuffled join, in which no key then exceeds
    HOT_FRACTION of the rows. Null keys never match, as in any equi-join, unless null_safe. hint is a join hint for the
    shuffled groups. rows is read twice and groups three times: pass scans or written tables.
    """
    share = groups.agg((F.sum(count_col) * HOT_FRACTION).alias("_t")) if total is None else groups.sparkSession.range(1).select(F.lit(total * HOT_FRACTION).alias("_t"))
    marked = groups.crossJoin(F.broadcast(share))  # share: one row
    is_hot = F.col(count_col) >= F.greatest(F.lit(1.0), F.col("_t"))
    hot, cold = (F.broadcast(marked.filter(is_hot).drop("_t")), marked.filter(~is_hot).drop("_t"))

    def join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        if not null_safe:
            return a.join(b, keys, how)
        renamed = b.withColumnsRenamed({k: f"_{k}_2" for k in keys})
        return a.join(renamed, reduce(lambda x, y: x & y, [a[k].eqNullSafe(renamed[f"_{k}_2"]) for k in keys]), how).drop(*[f"_{k}_2" for k in keys])

    rest = join(join(rows, hot.select(*keys), "left_anti"), cold.hint(hint) if hint else cold)
    return join(rows, hot).unionByName(rest)


def _runs(by: list[str], values: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers sorted batches: _part, _run (keys so far), _pos (1-based within the key), <value>_cum, _edge.

    _edge marks the last row of the partition's first key and the last row of the partition. State of a task is one key,
    its position and its sums, and one batch that is held back until its end is known.
    """
    part = TaskContext.get().partitionId()
    run, pos, sums, last, held = -1, 0, [0] * len(values), None, None

    def out(edge_at_end: bool) -> pa.RecordBatch:
        batch, extra, edge = held
        edge[-1] = edge_at_end
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in extra], pa.array(edge)], [*batch.schema.names, "_part", "_run", "_pos", *[f"{v}_cum" for v in values], "_edge"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in by:
            codes = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = [batch.column(c)[0].as_py() for c in by]
        new[0] = last is None or any(a != b and (a == a or b == b) for a, b in zip(first, last))
        if held is not None:
            yield out(bool(new[0]) and run == 0)
        last = [batch.column(c)[n - 1].as_py() for c in by]
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the key of the batch before goes on
        at = np.arange(n) - np.maximum(begin, 0) + 1 + np.where(begin < 0, pos, 0)
        runs = run + np.cumsum(new)
        cums = []
        for k, v in enumerate(values):
            x = pc.fill_null(batch.column(v), 0).to_numpy(zero_copy_only=False)
            c = np.cumsum(x)
            c = np.where(begin < 0, c + sums[k], c - np.concatenate([[x.dtype.type(0)], c])[np.maximum(begin, 0)])
            cums.append(c.astype(x.dtype))
            sums[k] = c[-1]
        edge = np.zeros(n, bool)
        edge[:-1] = new[1:] & (runs[:-1] == 0)
        run, pos = int(runs[-1]), int(at[-1])
        held = batch, [np.full(n, part, np.int32), runs.astype(np.int64), at.astype(np.int64), *cums], edge
    if held is not None:
        yield out(True)


def number_runs(df: DataFrame, by: list[str]) -> DataFrame:
    """df with _pos: 1-based position within stretches of equal by, in the order in which each partition holds its rows."""
    extra = [("_part", T.IntegerType()), ("_run", T.LongType()), ("_pos", T.LongType()), ("_edge", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in extra]])
    return df.mapInArrow(bind(_runs, by, []), schema).drop("_part", "_run", "_edge")


def _numbered(df: DataFrame, by: list[str], order: list[str], values: list[str], what: str) -> DataFrame:
    """df with _pos (1-based position within by) and <value>_cum (inclusive running sums), for keys of any size.

    One shuffle: rows are range-partitioned by (by, order), numbered inside their partition while they are written, and
    only keys that go on from the partition before get an offset: at most one a partition, so the offsets, and the edges
    that they are summed from, are two rows a partition at most, which bounds the broadcast.
    """
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("_pos", T.LongType())]
    extra += [T.StructField(f"{v}_cum", df.schema[v].dataType) for v in values] + [T.StructField("_edge", T.BooleanType())]
    placed = df.repartitionByRange(*[F.col(c) for c in (*by, *order)]).sortWithinPartitions(*by, *order)
    # written once, so that partition numbers and positions stay fixed whatever is recomputed later
    placed = materialize(placed.mapInArrow(bind(_runs, by, values), T.StructType([*df.schema.fields, *extra])), what)
    sums = {"_pos": "_o__pos"} | {f"{v}_cum": f"_o_{v}" for v in values}
    before = Window.partitionBy(*by).orderBy("_part", "_run").rowsBetween(Window.unboundedPreceding, -1)
    edges = placed.filter("_edge").select("_part", "_run", *[F.sum(c).over(before).alias(o) for c, o in sums.items()])
    offsets = edges.filter("_run = 0 and _o__pos is not null").select(F.col("_part").alias("_p2"), *sums.values())
    out = placed.join(F.broadcast(offsets), (F.col("_part") == F.col("_p2")) & (F.col("_run") == 0), "left")
    return out.withColumns({c: F.col(c) + F.coalesce(o, F.lit(0)) for c, o in sums.items()}).drop("_part", "_run", "_edge", "_p2", *sums.values())


def keyed_chunks(df: DataFrame, key: str, order: list[str], chunk_rows: int = 10_000) -> DataFrame:
    """Number the rows of each key in the given order and cut every key into chunks of equal size.

    Exact offset chunking: rows are range-partitioned by (key, order), so a key of any size spreads over as many
    partitions as it fills; counts of a key per partition, prefix-summed, are the offsets at which each partition's rows
    of the key begin. Adds ``_n`` (1-based position within the key) and ``_chunk``. Null keys form a key of their own.
    order must make rows of a key distinct for a reproducible numbering.
    """
    rows = _numbered(df, [key], order, [], "chunks").withColumnRenamed("_pos", "_n")
    return rows.withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk_rows))


def per_key_profile(
    df: DataFrame, key: str, state: str, time: str, row_id: str, weight: str | None = None, chunk_rows: int = 10_000
) -> DataFrame:
    """Per key: rows, sum of positive weights, first and last time, changes of ``state`` and longest gap in time order.

    Each chunk of at most chunk_rows rows is reduced on its own to a boundary state (first and last value beside its
    sums); the chunk states of a key are merged in order, adding the change and the gap that lie on each boundary.
    Null states are values of their own (null to null is no change). Rows with a null time come first in the order and
    take no part in gaps. An empty table gives an empty result.
    """
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0) if weight else F.lit(1.0)
    thin = df.select(F.col(key).alias("_key"), F.col(state).alias("_s"), F.col(time).alias("_t"), F.col(row_id).alias("_id"), w.alias("_w"))
    rows = keyed_chunks(thin, "_key", ["_t", "_id"], chunk_rows)
    inside = Window.partitionBy("_key", "_chunk").orderBy("_n")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = lambda a, b: (micros(a) - micros(b)) / 1e6
    step = rows.withColumns({
        "_change": F.when(F.row_number().over(inside) == 1, 0).when(F.col("_s").eqNullSafe(F.lag("_s").over(inside)), 0).otherwise(1),
        "_gap": gap(F.col("_t"), F.lag("_t").over(inside)),
    })
    chunk = step.groupBy("_key", "_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum("_change").alias("changes"), F.max("_gap").alias("gap"),
        F.min_by(F.struct("_s", "_t"), "_n").alias("first"), F.max_by(F.struct("_s", "_t"), "_n").alias("last"),
    )
    across = Window.partitionBy("_key").orderBy("_chunk")
    prior = F.lag("last").over(across)
    merged = chunk.withColumns({
        "edge": F.when(prior.isNull() | F.col("first._s").eqNullSafe(prior["_s"]), 0).otherwise(1),
        "edge_gap": gap(F.col("first._t"), prior["_t"]),
    })
    return merged.groupBy(F.col("_key").alias(key)).agg(
        F.sum("n").alias("n_rows"), F.round(F.sum("w"), 6).alias("weight_sum"),
        (F.sum("changes") + F.sum("edge")).alias("n_changes"),
        F.round(F.greatest(F.max("gap"), F.max("edge_gap")), 6).alias("longest_gap_s"),
        F.min_by("first._t", "_chunk").alias("first_at"), F.max_by("last._t", "_chunk").alias("last_at"),
    )


def heavy_keys(df: DataFrame, key: str, row_id: str, permille: int, chunk_rows: int = 10_000) -> DataFrame:
    """Non-null keys that hold at least permille thousandths of all rows (null keys count in the total).

    Each chunk of the numbering is counted on its own, and the chunks' counts are merged: no task sees more than a chunk
    of a key at once.
    """
    rows = keyed_chunks(df.select(F.col(key).alias("_key"), F.col(row_id).alias("_id")), "_key", ["_id"], chunk_rows)
    chunk = rows.groupBy("_key", "_chunk").agg(F.count(F.lit(1)).alias("c"))
    sums = chunk.groupBy("_key").agg(F.sum("c").alias("n_rows"))
    total = sums.agg(F.sum("n_rows").alias("n_total"))
    return (
        sums.crossJoin(F.broadcast(total))  # one row
        .filter(F.col("_key").isNotNull() & (F.col("n_rows") * 1000 >= F.col("n_total") * permille))
        .select(F.col("_key").alias(key), "n_rows")
    )


def prefix_sums(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Running totals ``<value>_cum`` of the values (long or double) in order within by, inclusive. order is unique within by.

    A group that fills many partitions is never gathered in one task, as it would be in a plain window. Null values of by
    are a group; null values count as 0.
    """
    return _numbered(df, by, [order], values, "prefix").drop("_pos")


def rank_within(df: DataFrame, by: str | None, order: list[str], name: str = "rank") -> DataFrame:
    """1-based position within by (of the whole table without it) in the given order, without a task per group."""
    keyed = df.withColumn("_all", F.lit(0)) if by is None else df
    return _numbered(keyed, [by or "_all"], order, [], "ranks").withColumnRenamed("_pos", name).drop("_all")
