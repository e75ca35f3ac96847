"""Connected components of links between keys, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot_aware
from ..session import materialize


#: Rounds after which something is wrong: they grow with the logarithm of the longest chain.
MOST_ROUNDS = 100


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node reachable over the links, in order of the node values.

    Alternating large-star and small-star rounds until the set of links stops changing; each round is two shuffles of
    the links and rewrites them towards stars, so the rounds grow with the logarithm of the longest chain. The minimum
    of a neighbourhood is a map-side-combined aggregate, joined back with hubs apart, so no neighbourhood is gathered.
    Links with a null end are dropped; a node linked with itself is its own component. No links give no rows.
    """
    raw = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null").distinct()
    raw = materialize(raw, "links")
    nodes = raw.select(F.col("u").alias("node")).union(raw.select("v")).distinct()
    edges = raw.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, mark = materialize(edges, "edges"), None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("m", "u"))
        large = join_hot_aware(both, materialize(least, "least"), ["u"], "_n").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "low")
        small = join_hot_aware(large, low, ["u"], "_n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "small")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("the links have not settled")
    parent = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(parent, nodes["node"] == parent["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
