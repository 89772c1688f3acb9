"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.sources.tables import drop, written

#: Neighbours from which, for a graph with hubs, a node's least one is sent to all tasks, so that no task reads all that hangs on the node.
HUB = 20_000


def _with_least(rows: DataFrame, hubs: bool, read: list[DataFrame] | None = None) -> DataFrame:
    """rows (u, v) with m, the least of u and all its v; read gets the scratch tables that are read for it.

    Hubs have HUB rows or more each, so they are few: with hubs they are broadcast, and their rows stay where they are.
    """
    low = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), *([F.count("*").alias("_n")] if hubs else []))
    if not hubs:
        return rows.join(low, "u")
    low = written(low)
    if read is not None:
        read.append(low)
    marked = rows.join(F.broadcast(low.where(F.col("_n") >= HUB).select("u", F.col("m").alias("_hub"))), "u", "left")
    rest = marked.where("_hub IS NULL").select("u", "v").join(low.where(F.col("_n") < HUB).select("u", "m"), "u")
    return rest.unionByName(marked.where("_hub IS NOT NULL").select("u", "v", F.col("_hub").alias("m")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, hubs: bool = False) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Self-loops and repeated edges are allowed, edges with a null end are ignored, no edges give no rows.
    Every round is a shuffle by node with map-side partial minima, so a hub costs one row a neighbour and
    no neighbourhood is ever gathered in one task; with hubs the rows of a node with very many neighbours aren't joined in
    one task either. Rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = written(pairs.where("u = v").select("u"))
    before = None
    for _ in range(max_rounds):
        apart = pairs.where("u <> v")
        both = apart.union(apart.select("v", "u"))
        # large star: every larger neighbour of u is linked with the smallest node around u
        spent = [pairs]
        large = written(_with_least(both, hubs, spent).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        for table in spent:
            drop(table)
        # small star: u and its smaller neighbours are linked with the smallest of them
        spent = [large]
        pairs = written(_with_least(large, hubs, spent).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        for table in spent:
            drop(table)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).union(loops.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
