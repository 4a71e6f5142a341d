"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the component, for every node of the edges (a, b).

    Each round every remaining vertex hooks onto its smallest neighbour if that is smaller than itself, chains of hooks are followed to
    their end by pointer doubling, and the edges are rewritten to the ends. A vertex that is no local minimum disappears, so the number of
    rounds grows with the logarithm of the vertices. Minima are combined before the shuffle, and the joins put whole edges next to a
    table that is unique on the key, so a vertex with very many edges can be split between tasks.
    """
    left = materialize(edges.select("a", "b").where("a <> b").distinct())
    names = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    names = materialize(names)
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("v"), F.least("a", "to").alias("to")))
        while True:
            ahead = hook.select(F.col("v").alias("to"), F.col("to").alias("then"))
            jumped = materialize(hook.join(ahead, "to").select("v", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")))
            hook = jumped.select("v", "to")
            if jumped.where("moved").isEmpty():
                break
        names = materialize(names.join(hook, names["component"] == hook["v"], "left").select("node", F.coalesce("to", "component").alias("component")))
        a_to = hook.select(F.col("v").alias("a"), F.col("to").alias("a_to"))
        b_to = hook.select(F.col("v").alias("b"), F.col("to").alias("b_to"))
        left = materialize(left.join(a_to, "a").join(b_to, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    return names
