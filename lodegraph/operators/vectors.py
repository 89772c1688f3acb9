"""Vector search: exact nearest neighbours of stated queries, rank fusion and coherence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that a pass over the vectors takes at once; the rest follow in further passes.
QUERY_BLOCK = 4_096
#: Vectors and queries that are scored at once: with them, a task's matrices grow neither with its rows nor with the queries.
ITEM_BLOCK, SCORE_BLOCK = 512, 256


def cosine(one: Column, other: Column) -> Column:
    """Cosine of two arrays; 0 for null, unequal length or zero norm."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(one, one) * dot(other, other))
    return F.when((F.size(one) == F.size(other)) & (norm > 0), dot(one, other) / norm).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", least: float = -1.0, other: str | None = None) -> DataFrame:
    """(query, item, score, position): the k most similar vectors of each query, itself left out, ties by item.

    other names a column in which an item must differ from its query (a null differs from all others, not from a null).
    Queries go to the tasks in blocks of QUERY_BLOCK, each task keeps k of each query over all its rows, and one small shuffle merges them.
    """
    total = queries.count()
    parts = max(1, -(-total // QUERY_BLOCK))
    found = []
    for part in range(parts):
        group = (F.xxhash64(other) if other else F.lit(0).cast("long")).alias("_group")
        block = queries.where(F.pmod(F.xxhash64(ident), F.lit(parts)) == part).select(ident, vector, group).toArrow()
        ids = np.array(block.column(ident), dtype=np.int64)
        matrix = _unit(block.column(vector).combine_chunks()) if len(ids) else np.zeros((0, 1))
        groups = np.array(block.column("_group"), dtype=np.int64)

        def search(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix, groups=groups) -> Iterator[pa.RecordBatch]:
            blocks = [slice(low, low + SCORE_BLOCK) for low in range(0, len(ids), SCORE_BLOCK)]
            best = [np.zeros((len(ids[b]), 0)) for b in blocks]
            kept = [np.zeros((len(ids[b]), 0), dtype=np.int64) for b in blocks]
            for whole in batches:
                for low in range(0, whole.num_rows if len(ids) else 0, ITEM_BLOCK):
                    batch = whole.slice(low, ITEM_BLOCK)
                    items, unit = np.array(batch.column(ident), dtype=np.int64), _unit(batch.column(vector)).T
                    theirs = np.array(batch.column("_group"), dtype=np.int64) if other else None
                    for i, b in enumerate(blocks):
                        scores = matrix[b] @ unit
                        scores[ids[b, None] == items[None, :]] = -2.0
                        if other:
                            scores[groups[b, None] == theirs[None, :]] = -2.0
                        scores, named = np.hstack([best[i], scores]), np.hstack([kept[i], np.broadcast_to(items, scores.shape)])
                        order = np.lexsort((named, -scores), axis=1)[:, :k]
                        best[i], kept[i] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(named, order, axis=1)
            for i, b in enumerate(blocks):
                ok = best[i].ravel() > max(-1.5, least - 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[b], best[i].shape[1])[ok]), pa.array(kept[i].ravel()[ok]), pa.array(best[i].ravel()[ok])], names=["query", "item", "score"])

        found.append(vectors.select(ident, vector, group).mapInArrow(search, "query long, item long, score double"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return every.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def _unit(lists: pa.Array) -> np.ndarray:
    flat = np.array(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(norm > 0, norm, 1.0)


def fuse(one: DataFrame, other: DataFrame, weights: tuple[float, float] = (0.7, 0.3), offset: int = 60) -> DataFrame:
    """(query, item, score): weighted reciprocal rank fusion of two rankings (query, item, position)."""
    a = one.select("query", "item", (weights[0] / (offset + F.col("position"))).alias("s"))
    b = other.select("query", "item", (weights[1] / (offset + F.col("position"))).alias("s"))
    return a.unionByName(b).groupBy("query", "item").agg(F.sum("s").alias("score"))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, centroid): mean of each place over a group's vectors, added up before the shuffle."""
    places = vectors.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centroid"))


def coherence(vectors: DataFrame, group: str, vector: str = "embedding", weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """(group, n, centroid, pairwise, variance, score): how much a group's vectors belong together.

    centroid is the mean cosine with the mean vector, pairwise that of all pairs, variance exp(-10 times the variance of
    the distances from the mean). The sum of n unit vectors has square n + n (n - 1) times the mean cosine of its pairs,
    so no pair is formed. A group of one vector scores 1.
    """
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.select(group, F.posexplode(F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))).alias("at", "u"))
    sums = unit.groupBy(group, "at").agg(F.sum("u").alias("u")).groupBy(group).agg(F.sum(F.col("u") * F.col("u")).alias("square"))
    near = vectors.join(centroids(vectors, group, vector), group).select(group, cosine(F.col(vector), F.col("centroid")).alias("s"))
    each = near.groupBy(group).agg(F.count("*").alias("n"), F.avg("s").alias("centroid"), F.var_pop(1 - F.col("s")).alias("v")).join(sums, group)
    pairwise = F.when(F.col("n") > 1, (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    each = each.select(group, "n", "centroid", pairwise.alias("pairwise"), F.exp(-10 * F.col("v")).alias("variance"))
    total = F.col("centroid") * weights[0] + F.col("pairwise") * weights[1] + F.col("variance") * weights[2]
    return each.withColumn("score", F.when(F.col("n") > 1, total).otherwise(1.0))
