"""From deliveries to a sampling frame: rule types, conflict drop, strata, weights, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import content_key, short_uid
from ..schema import ATTACK, CONTENT_FIELDS


def labels_per_rule(alerts: DataFrame) -> DataFrame:
    """(rule_name, n, n_attack, rule_type): mixed if both labels occur in the full table, before any deduplication."""
    a = F.count_if(F.col("label") == ATTACK)
    g = alerts.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"), a.alias("n_attack"))
    return g.withColumn("rule_type", F.when((F.col("n_attack") > 0) & (F.col("n_attack") < F.col("n")), "mixed").otherwise("single"))


def build_frame(alerts: DataFrame, fields: tuple[str, ...] = CONTENT_FIELDS, keep_conflicts: bool = False) -> DataFrame:
    """One row per content key: uid, row_index (least), label, rule_name, rule_type, stratum, n_duplicates.

    Keys delivered with different labels are dropped, or with keep_conflicts returned alone (key, uid, n_duplicates). The
    row with the least row_index decides the rule. Only hashes and short columns are shuffled. rule_name null is a rule
    of its own. Rows without a label take no part. The rule types, a line a rule, are broadcast by AQE while they are small;
    beyond that AQE splits the partitions of a rule that holds many keys.
    """
    keyed = alerts.filter("label is not null").select("row_index", "rule_name", "label", content_key(fields).alias("key"))
    per_key = keyed.groupBy("key").agg(
        F.min("row_index").alias("row_index"), F.min_by("rule_name", "row_index").alias("rule_name"), F.min("label").alias("label"),
        F.max("label").alias("_other"), F.count(F.lit(1)).alias("n_duplicates"),
    )
    if keep_conflicts:
        return per_key.filter("label <> _other").select("key", short_uid(F.col("key")).alias("uid"), "n_duplicates")
    one = per_key.filter("label = _other").drop("_other")
    types = labels_per_rule(alerts.filter("label is not null")).select(F.col("rule_name").alias("_r"), "rule_type")
    typed = one.join(types, one["rule_name"].eqNullSafe(types["_r"])).drop("_r")
    suffix = F.when(F.col("label") == ATTACK, "_attack").otherwise("_non_attack")
    return typed.select("key", short_uid(F.col("key")).alias("uid"), "row_index", "label", "rule_name", "rule_type", F.concat("rule_type", suffix).alias("stratum"), "n_duplicates")


def uid_collisions(frame: DataFrame) -> DataFrame:
    """Uids shared by different keys; a frame with any is unusable."""
    return frame.groupBy("uid").agg(F.count_distinct("key").alias("n_keys")).filter("n_keys > 1")


def refuse_collisions(frame: DataFrame) -> DataFrame:
    """The frame as it is, or an error if two keys share a uid."""
    worst = uid_collisions(frame).limit(5).collect()
    if worst:
        raise ValueError(f"uids of several keys: {[r['uid'] for r in worst]}")
    return frame


def duplicate_stats(alerts: DataFrame, fields: tuple[str, ...] = CONTENT_FIELDS) -> DataFrame:
    """One row: keys that occur more than once, and rows in such groups."""
    g = alerts.groupBy(content_key(fields).alias("key")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return g.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows_in_groups"))


def inverse_probability_weights(frame: DataFrame) -> DataFrame:
    """(stratum, label, n, weight): weight = classes * rows of the stratum / rows of its class."""
    n = frame.groupBy("stratum", "label").agg(F.count(F.lit(1)).alias("n"))
    of_class = F.sum("n").over(Window.partitionBy("label"))  # four rows
    return n.withColumn("weight", 2 * F.col("n") / of_class)


def concentration(rows: DataFrame, rule: str = "rule_name", stratum: str = "stratum") -> DataFrame:
    """(stratum or null for all, n, n_rules, top_rule, top_n, top_percent): ties go to the first rule by name."""
    sets = rows.select(F.col(rule).alias("r"), F.col(stratum).alias("s"))
    g = sets.groupingSets([[F.col("r")], [F.col("s"), F.col("r")]], "s", "r").agg(F.count(F.lit(1)).alias("c"), F.grouping("s").alias("overall"))
    top = g.groupBy("overall", "s").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_rules"), F.max("c").alias("top_n")
    )
    first = g.join(top.select(F.col("overall").alias("o2"), F.col("s").alias("s2"), "top_n"), (F.col("overall") == F.col("o2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("c") == F.col("top_n")))
    names = first.groupBy("overall", "s").agg(F.min("r").alias("top_rule")).select(F.col("overall").alias("o3"), F.col("s").alias("s3"), "top_rule")
    both = top.join(names, (F.col("overall") == F.col("o3")) & F.col("s").eqNullSafe(F.col("s3")))
    return both.select(
        F.when(F.col("overall") == 1, "all").otherwise(F.col("s")).alias("stratum"), "n", "n_rules", "top_rule", "top_n",
        F.round(100.0 * F.col("top_n") / F.col("n"), 1).alias("top_percent"),
    )
