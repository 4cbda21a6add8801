"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_least(edges: DataFrame, total: int, shared: bool = False) -> DataFrame:
    """(u, v, m): m is the smallest v of each u; with `shared` only of those that have several v. Nodes with a hundredth of the `total` rows or more are looked up in a constant, all others joined."""
    of_node = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), *([F.max("v").alias("_most")] if shared else []))
    of_node = of_node.where("m <> _most").drop("_most") if shared else of_node
    hubs = of_node.where(F.col("n") * 100 >= total).collect()  # a hundred at most
    if not hubs:
        return edges.join(of_node.select("u", "m"), "u")
    least = F.create_map(*[F.lit(bytes(x) if isinstance(x, bytearray) else x) for r in hubs for x in (r.u, r.m)])
    marked = edges.withColumn("m", F.try_element_at(least, F.col("u")))
    return marked.where("m is not null").unionByName(marked.where("m is null").drop("m").join(of_node.where(F.col("n") * 100 < total).select("u", "m"), "u"))


def components(edges: DataFrame, tables, name: str) -> DataFrame:
    """(id, root) for every node of the edges (u, v): root is the smallest node that can be reached. tables: what writes and drops the rounds' tables.

    A hub costs one row per neighbour and round, never a pair of neighbours, and no task holds all of a hub's rows. Ends when a round changes nothing, after about the
    logarithm of the longest path.
    """
    now = tables.write(edges.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        state = now.selectExpr("count(*)", "bit_xor(xxhash64(u, v))").first()
        if state == seen or not state[0]:
            return now.selectExpr("u as id", "v as root").union(now.selectExpr("v as id", "v as root").distinct())
        seen, k = state, k + 1
        both = now.union(now.select("v", "u").toDF("u", "v"))
        large = with_least(both, 2 * state[0]).selectExpr("v", "least(u, m) as m", "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        large = tables.write(large, f"{name}-large{k}")
        small = with_least(large, state[0]).select("u", "v", "m")
        small = small.where("v <> m").selectExpr("v as u", "m as v").union(small.where("v = m").selectExpr("u", "m as v")).distinct()
        now = tables.write(small, f"{name}-{k}")
        tables.drop(f"{name}-{k - 1}")
        tables.drop(f"{name}-large{k}")
