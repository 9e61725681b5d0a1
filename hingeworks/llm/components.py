"""Connected components of a links table, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hingeworks.llm.tables import written

SALTS = 16


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, component)``: the smallest id that each linked id reaches.

    ``links`` has ``(a, b)``; direction, repeats and loops do not matter. Each round
    a node takes the smallest label among itself, its neighbours and its label's own
    label, so the number of rounds grows with the logarithm of the longest path. Rows
    are grouped by node with sums on the map side; a hub's links are only ever
    minimised, never gathered. The members of a large component ask for one label
    together: only labels that have a smaller one are sent, once for every salt. Each
    round is written to the shared folder, so a lost executor repeats one round at most.
    """
    both = links.where("a is not null and b is not null and a != b")
    edges = written(
        both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near"))
        # The label's owner hears of the smaller label too.
        told = labels.join(near, "id").select(
            F.col("component").alias("id"), F.least("near", "component").alias("near"))
        used = labels.select(F.col("component").alias("id")).distinct()
        hops = labels.join(used, "id").where("component < id").select(
            F.col("id").alias("component"), F.col("component").alias("near"),
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        shortcut = labels.withColumn("salt", salt).join(hops, ["component", "salt"]).select("id", "near")
        best = near.union(told).union(shortcut).groupBy("id").agg(F.min("near").alias("near"))
        nexts = written(labels.join(best, "id", "left").select(
            "id", F.col("component").alias("old"),
            F.least("component", F.coalesce("near", "component")).alias("component")), "labels")
        labels = nexts.select("id", "component")
        if nexts.where("old != component").isEmpty():
            break
    if nodes is None:
        return labels
    return nodes.select("id").join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))
