"""Records that differ only in form: multiset hashing of normalised fields, then field-by-field verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot_aware
from ..session import materialize

#: Members of one class that one task compares with a replica of the class's first record.
VERIFY_ROWS = 100_000


def fingerprint(fields: list[str]) -> list:
    """Two sums of hashed (name, value) pairs. The sum makes the order of fields irrelevant; null and '' hash apart.

    Each pair's hash is shifted right so far that the sum of all fields stays inside 64 bits.
    """
    room = max(1, len(fields)).bit_length() + 1
    pairs = [(F.lit(f), F.coalesce(F.concat(F.lit("="), F.col(f)), F.lit("null"))) for f in fields]
    total = lambda seed: sum((F.shiftright(F.xxhash64(F.lit(seed), n, v), room) for n, v in pairs), F.lit(0).cast("long"))
    return [total(0).alias("_hi"), total(1).alias("_lo")]


def formal_copies(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(first_id, copy_id): every record whose fields all equal those of a record with a smaller id.

    df holds the fields in the form in which they are compared; null equals only null, '' only ''. Ids are unique. The
    grouping moves 24 bytes a record. Only records in fingerprint groups of two or more are then compared value by value
    with the group's first record; records that fail (equal fingerprints, other values) are grouped by the values
    themselves, so a collision costs time, not truth. Joins hash and never sort. Groups of any size are handled: the hot ones are broadcast as one
    row each, and comparisons of a large group are spread over replicas of its first record.
    """
    key = ["_hi", "_lo"]
    thin = materialize(df.select(F.col(id_col).alias("_id"), *fingerprint(fields)), "copies")
    groups = thin.groupBy(*key).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = materialize(groups, "groups")
    # every build side below holds ids and counts, or one record a group and slot
    tagged = materialize(join_hot_aware(thin, groups, key, "_n", thin.count(), hint="shuffle_hash").select("_id", "_first", "_n"), "tagged")
    values = df.select(F.col(id_col).alias("_id"), F.struct(*fields).alias("_v"))
    full = values.join(tagged.hint("shuffle_hash"), "_id").withColumn("_slots", F.ceil(F.col("_n") / VERIFY_ROWS).cast("int"))
    full = materialize(full, "values")
    firsts = full.filter("_id = _first").select(
        "_first", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)).alias("_slot"), F.col("_v").alias("_fv")
    )
    rest = full.filter("_id <> _first").withColumn("_slot", F.pmod(F.xxhash64("_id"), F.col("_slots")).cast("int"))
    checked = rest.join(firsts.hint("shuffle_hash"), ["_first", "_slot"]).withColumn("_same", F.col("_v").eqNullSafe(F.col("_fv")))
    checked = materialize(checked.select("_id", "_first", "_same", F.when(~F.col("_same"), F.col("_v")).alias("_v")), "checked")
    good = checked.filter("_same").select(F.col("_first").alias("first_id"), F.col("_id").alias("copy_id"))
    failed = checked.filter("not _same").select("_id", "_v")
    if failed.isEmpty():
        return good
    again = materialize(failed.groupBy("_v").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("_n")), "again")
    late = join_hot_aware(failed, again, ["_v"], "_n").filter("_id <> first_id").select("first_id", F.col("_id").alias("copy_id"))
    return good.unionByName(late)


def copy_counts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(first_id, n_copies) for every distinct record, n_copies counting the record itself."""
    links = formal_copies(df, id_col, fields)
    more = links.groupBy("first_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    firsts = df.select(F.col(id_col).alias("first_id")).join(links.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti")
    return firsts.join(more, "first_id", "left").select("first_id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
