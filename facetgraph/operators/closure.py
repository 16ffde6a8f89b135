"""Transitive closure over references (follow, rfollow), safe on cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def closure(edges: DataFrame, seeds: DataFrame, exclude_initial: bool = False, leaves_only: bool = False, everywhere: bool = False) -> DataFrame:
    """edges(src, dst), seeds(start) -> distinct (start, node, depth) reachable, depth being the least number of edges.

    Each round joins the nodes found last with the edges and drops nodes already seen. everywhere: most nodes are seeds; the
    edges' powers of two are joined instead, all that is found with 2, 4, 8, .. steps more, so that long chains take few
    rounds. Rounds are written to the shared folder, so lineage stays short, and go on until nothing new is found."""
    edges = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    front = seeds.select("start", F.col("start").alias("node")).where("start is not null").distinct().withColumn("depth", F.lit(0))
    seen = front = stored(front)
    steps, power, rounds = 1, edges, 0
    while True:
        rounds += 1
        last = seen if everywhere else front
        new = last.select("start", F.col("node").alias("src"), "depth").join(power, "src").groupBy("start", F.col("dst").alias("node")).agg((F.min("depth") + steps).alias("depth"))
        front = stored(new.join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front)) if everywhere else seen.unionByName(front)
        if everywhere:
            steps *= 2
            power = stored(power.join(power.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct())
        elif rounds % 8 == 0:
            seen = stored(seen)
    out = seen
    if leaves_only:
        out = out.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    if exclude_initial:
        out = out.where("depth > 0")
    return out.select("start", "node", "depth")
