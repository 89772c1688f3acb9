"""Paths between pairs of vertices and expansion from seeds by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.graph import HUB
from lodegraph.operators.ranking import best_of
from lodegraph.sources.tables import written

#: What a neighbour's importance is multiplied by when it joins the queue.
BOOST = 1.5


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to")))).alias("x")).select("x.*").where("at <> to").distinct()


def between(edges: DataFrame, pairs: DataFrame, depth: int = 4, most: int = 5) -> DataFrame:
    """(a, b, path, hops, place): the most shortest simple undirected paths of at most depth hops between each pair (a, b).

    Half of a path is walked from either end and halves are joined where they meet, so walks never exceed half the depth.
    """
    links = written(_undirected(edges))

    def walks(ends: DataFrame, steps: int) -> list[DataFrame]:
        out = [written(ends.select(F.array("end").alias("path")).distinct())]
        for _ in range(steps):
            grown = out[-1].join(links, F.element_at("path", -1) == F.col("at")).where(~F.array_contains("path", F.col("to")))
            out.append(written(grown.select(F.concat("path", F.array("to")).alias("path"))))
        return out

    ahead = walks(pairs.select(F.col("a").alias("end")), -(-depth // 2))
    back = walks(pairs.select(F.col("b").alias("end")), depth // 2)
    found = None
    for hops in range(1, depth + 1):
        one, two = ahead[-(-hops // 2)], back[hops // 2]
        left = one.select(F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("m"), F.col("path").alias("p"))
        right = two.select(F.element_at("path", 1).alias("b"), F.element_at("path", -1).alias("m"), F.reverse(F.slice("path", 1, F.size("path") - 1)).alias("q"))
        met = left.join(pairs.distinct(), "a").join(right, ["m", "b"]).where(~F.arrays_overlap("p", "q")).select("a", "b", F.concat("p", "q").alias("path"), F.lit(hops).alias("hops"))
        found = met if found is None else found.unionByName(met)
    w = Window.partitionBy("a", "b").orderBy("hops", F.array_join("path", ">"))
    return found.where("a <> b").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def parts(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) of all vertices on paths, and (src, dst) of their steps, each once."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    return paths.select(F.explode("path").alias("id")).distinct(), paths.where(F.size("path") > 1).select(F.explode(steps).alias("s")).select("s.*").distinct()


def neighbours(edges: DataFrame, most: int = 20) -> DataFrame:
    """(id, way, neighbour, type, confidence, place): of every vertex, the most surest edges out and in.

    Edge ends are shuffled once, by vertex; those of the few vertices with over HUB edges one way are dealt to many tasks first.
    """
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("way"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("way"), F.col("src").alias("neighbour")))
    rows, group, order = edges.select(F.explode(ends).alias("x"), "type", "confidence").select("x.*", "type", "confidence"), ["id", "way"], [F.desc("confidence"), F.col("neighbour"), F.col("type")]
    hubs = F.broadcast(written(rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > HUB).select(*group)))
    once = lambda some: some.groupBy(*group, "neighbour", "type").agg(F.max("confidence").alias("confidence"))
    rest = once(rows.join(hubs, group, "left_anti").repartition(*group)).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most)
    return rest.unionByName(best_of(once(rows.join(hubs, group, "left_semi")), group, most, order, F.struct("neighbour", "type")))


def expanded(edges: DataFrame, importance: DataFrame, seeds: DataFrame, most: int = 10, depth: int = 2, weights: dict[str, float] | None = None) -> DataFrame:
    """(seed, id, hops, priority, place): best-first expansion from each seed (id) until it has most vertices.

    In every step each seed's vertex of highest priority, ties by id, is expanded; unseen neighbours join with their
    importance times BOOST times 0.5 + the weight of the edge's type (0.5 if unknown). importance (id, importance), 0.5 if missing. Seeds run side by
    side, a step is two joins for all of them, and there are at most `most` steps.
    """
    kinds = weights or {}
    weight = F.coalesce(*[F.when(F.col("type") == k, F.lit(float(v))) for k, v in kinds.items()], F.lit(0.5))
    links = edges.select(F.explode(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to")))).alias("x"), weight.alias("w")).select("x.*", "w")
    links = links.where("at <> to").groupBy("at", "to").agg(F.max("w").alias("w")).join(importance.select(F.col("id").alias("to"), "importance"), "to", "left")
    links = written(links.select("at", "to", (F.coalesce("importance", F.lit(0.5)) * BOOST * (0.5 + F.col("w"))).alias("p")))
    state = written(seeds.select(F.col("id").alias("seed"), "id").distinct().select("seed", "id", F.lit(0).alias("hops"), F.lit(1e9).alias("priority"), F.lit(1).alias("place"), F.lit(False).alias("done")))
    for _ in range(most):
        size = state.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") < most)
        open_ = state.where(~F.col("done") & (F.col("hops") < depth)).join(size, "seed")
        top = open_.groupBy("seed").agg(F.max_by(F.struct("id", "hops", "n"), F.struct("priority", -F.xxhash64("id"))).alias("t")).select("seed", F.col("t.id").alias("at"), "t.hops", "t.n")
        top = written(top)
        if not top.take(1):
            break
        fresh = top.join(links, "at").select("seed", F.col("to").alias("id"), (F.col("hops") + 1).alias("hops"), F.col("p").alias("priority"), "n").join(state.select("seed", "id"), ["seed", "id"], "left_anti")
        fresh = fresh.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("priority"), "id")) + F.col("n")).where(F.col("k") <= most)
        closed = state.join(top.select("seed", F.col("at").alias("id"), F.lit(True).alias("_now")), ["seed", "id"], "left").select("seed", "id", "hops", "priority", "place", (F.col("done") | F.col("_now").isNotNull()).alias("done"))
        state = written(closed.unionByName(fresh.select("seed", "id", "hops", "priority", F.col("k").alias("place"), F.lit(False).alias("done"))))
    return state.drop("done")
