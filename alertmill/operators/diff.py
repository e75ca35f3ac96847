"""Differences between two copies of a dataset, by content-defined chunks of key-sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CUT_MASK = 63  # a chunk holds 64 rows on average
#: Digest of a null field; other digests are hashes, which take this value once in 2**64.
_NULL = 0
#: Fixed odd multipliers: one for each of the keys in the rolling hash.
_ROLL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def digest_rows(df: DataFrame, key: str, fields: list[str], newest: list[str] | None = None) -> DataFrame:
    """(k, n, lo, hi): one row per non-null key: its rows, and per field the least and greatest 64-bit digest.

    Several rows with a key are versions of it: where they agree in a field, lo and hi are equal there. With ``newest``
    only the largest row by these columns counts (ties: the largest digests), so lo and hi are the same. The aggregate
    combines before the shuffle, so a key that holds a third of all rows arrives as one row from each task.
    """
    h = [F.when(F.col(f).isNull(), F.lit(_NULL)).otherwise(F.xxhash64(F.lit("v"), F.col(f))) for f in fields]
    some = df.filter(F.col(key).isNotNull())
    n = F.count(F.lit(1)).alias("n")
    if newest:
        thin = some.select(F.col(key).alias("k"), F.struct(*newest, F.array(*h).alias("_h")).alias("_v"))
        return thin.groupBy("k").agg(n, F.max("_v").alias("_v")).select("k", "n", F.col("_v._h").alias("lo"), F.col("_v._h").alias("hi"))
    thin = some.select(F.col(key).alias("k"), *[x.alias(f"h{i}") for i, x in enumerate(h)])
    ends = [f(f"h{i}").alias(f"{p}{i}") for p, f in (("lo", F.min), ("hi", F.max)) for i in range(len(h))]
    per = thin.groupBy("k").agg(n, *ends)
    return per.select("k", "n", *[F.array(*[F.col(f"{p}{i}") for i in range(len(h))]).alias(p) for p in ("lo", "hi")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chunk number c to batches sorted by (b, k): a chunk ends after a row whose rolling hash meets the mask."""
    tail_k, tail_b, chunk = np.zeros(len(_ROLL) - 1, np.uint64), np.full(len(_ROLL) - 1, -1, np.int64), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k = np.concatenate([tail_k, batch.column("kh").to_numpy().view(np.uint64)])
        b = np.concatenate([tail_b, batch.column("b").to_numpy().astype(np.int64)])
        here, back = b[-n:], len(_ROLL) - 1
        roll = np.zeros(n, np.uint64)
        for i, m in enumerate(_ROLL):
            roll += np.where(b[back - i : back - i + n] == here, k[back - i : back - i + n], np.uint64(0)) * np.uint64(m)
        roll ^= roll >> np.uint64(29)
        cut = (roll * np.uint64(_ROLL[0]) >> np.uint64(40)) & np.uint64(CUT_MASK) == 0
        ends = np.cumsum(cut)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk + ends - cut)], [*batch.schema.names, "c"])
        chunk += int(ends[-1])
        tail_k, tail_b = k[-back:], b[-back:]


def _chunks(side: DataFrame, name: str) -> DataFrame:
    """side (k, n, lo, hi) with row hash r, bucket b and chunk c, written once.

    The rows come out of the aggregate hashed by key, and b is the number of their hash partition, so sorting each task's
    rows by (b, k) gives both sides the same order in the same buckets, however AQE merges the partitions: no further
    shuffle. The row hash of a key with several versions depends on the side: such a key must be looked at.
    """
    parts = max(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    r = F.when(F.col("lo") == F.col("hi"), F.xxhash64("k", "lo")).otherwise(F.xxhash64(F.lit(name), "k", "lo", "hi"))
    keyed = side.select("k", "n", "lo", "hi", r.alias("r"), F.xxhash64("k").alias("kh"), F.pmod(F.hash("k"), F.lit(parts)).alias("b"))
    fields = ", ".join(f"`{c}` {t}" for c, t in keyed.dtypes)
    return materialize(keyed.sortWithinPartitions("b", "k").mapInArrow(_cut, f"{fields}, c long"), "diff")


def _fingerprints(rows: DataFrame) -> DataFrame:
    """Per chunk: row count, first key and two sums of independent row hashes (shifted: exact for 2**20 rows a chunk)."""
    return rows.groupBy("b", "c").agg(
        F.count(F.lit(1)).alias("rows"), F.min("kh").alias("first"),
        F.sum(F.shiftright("r", 20)).alias("f1"), F.sum(F.shiftright(F.xxhash64("r", F.lit(7)), 20)).alias("f2"),
    )


def unmatched_rows(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of either side (k, n, lo, hi) that lie in chunks without an equal chunk on the other side."""
    a, b = _chunks(left, "left"), _chunks(right, "right")
    fa, fb = _fingerprints(a), _fingerprints(b)
    same, cols = ["rows", "first", "f1", "f2"], ["k", "n", "lo", "hi"]
    opened = lambda x, y, of: of.join(x.join(y, same, "left_anti").select("b", "c"), ["b", "c"], "left_semi").select(*cols)
    return opened(fa, fb, a), opened(fb, fa, b)


def diff_tables(
    left: DataFrame, right: DataFrame, key: str, fields: list[str], names: tuple[str, str] = ("left", "right"),
    newest_left: list[str] | None = None, newest_right: list[str] | None = None,
) -> DataFrame:
    """(key, kind, field_name, n_rows): every difference between the two sides.

    * ``only_<name>``, field ``row``: the key is missing on the other side;
    * ``differs``: the field has more than one value among all versions of the key on both sides;
    * ``versions_<name>``: the versions of the key on that side do not agree in the field;
    * ``no_key_<name>``, field ``row``, key null: rows without a key, which can be matched with nothing.

    n_rows counts the rows concerned: of the key on the named side, on both sides for ``differs``. Both sides carry the
    same field columns, already in the form in which they are to be compared; null equals only null. Of several rows with
    a key the newest counts where ``newest_<side>`` names columns to order by, else every one is a version. Only digests
    travel: 8 or 16 bytes a field. Chunks of key-sorted rows whose fingerprints stand on both sides are dropped before the
    row-wise join, so copies that mostly agree cost little more than one shuffle of a side. Empty sides are allowed.
    """
    a, b = unmatched_rows(digest_rows(left, key, fields, newest_left), digest_rows(right, key, fields, newest_right))
    side = lambda d, p: d.select("k", *[F.col(c).alias(p + c) for c in ("n", "lo", "hi")])
    both = side(a, "a_").join(side(b, "b_"), "k", "full_outer")
    at = lambda c, i: F.element_at(c, i + 1)

    def case(kind: str, n, which: list | None = None):  # noqa: ANN001, ANN202
        cells = [F.when(w, F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("field_name"), n.alias("n_rows"))) for f, w in zip(fields, which or [])]
        return F.array_compact(F.array(*cells)) if which else F.array(F.struct(F.lit(kind).alias("kind"), F.lit("row").alias("field_name"), n.alias("n_rows")))

    span = range(len(fields))
    many = lambda p: [F.coalesce(at(f"{p}lo", i) != at(f"{p}hi", i), F.lit(False)) for i in span]
    unlike = [F.least(at("a_lo", i), at("b_lo", i)) != F.greatest(at("a_hi", i), at("b_hi", i)) for i in span]
    main = (
        F.when(F.col("b_n").isNull(), case(f"only_{names[0]}", F.col("a_n")))
        .when(F.col("a_n").isNull(), case(f"only_{names[1]}", F.col("b_n")))
        .otherwise(case("differs", F.col("a_n") + F.col("b_n"), unlike))
    )
    versions = [case(f"versions_{x}", F.col(f"{p}n"), many(p)) for x, p in zip(names, ("a_", "b_"))]
    found = both.select(F.col("k").alias(key), F.explode(F.concat(main, *versions)).alias("x")).select(key, "x.*")
    for d, x in ((left, names[0]), (right, names[1])):
        lost = d.filter(F.col(key).isNull()).groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n_rows"))
        found = found.unionByName(lost.select(key, F.lit(f"no_key_{x}").alias("kind"), F.lit("row").alias("field_name"), "n_rows"))
    return found
