"""An inverted-file index of vectors: cells around fitted centres, a search of the nearest cells, and of others where bounds ask for it.

Cells are fitted on a bounded sample, every row is put into one and the rows are written sorted by cell, with filter
columns beside them. A search reads the cells that its queries probe alone. The angle between a query and a cell's
centre, less the cell's widest angle, bounds what the cell can hold, so `search` can go on to the cells whose bound
beats the k-th score found and no others: results are then those of a scan, whatever the probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodegraph.operators.vectors import _unit
from lodegraph.sources.tables import written

#: Rows that centres are fitted on, and cells, at most.
SAMPLE, MOST_CELLS = 50_000, 4_096
#: Queries that a pass takes at once; the rest follow in further passes.
QUERY_BLOCK = 4_096


@dataclass
class Index:
    """Where the rows are (path/rows), and the unit centre, widest angle and row count of each cell."""

    path: str
    ident: str
    vector: str
    centres: np.ndarray
    widest: np.ndarray
    counts: np.ndarray
    spark: SparkSession

    def rows(self, where: Column | None = None, cells: np.ndarray | None = None) -> DataFrame:
        """The rows of some cells and under a filter, both of which reach the scan."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if cells is not None and len(cells) < len(self.centres):
            rows = rows.where(F.col("cell").isin([int(c) for c in cells]))
        return rows if where is None else rows.where(where)

    def share(self, cells: np.ndarray) -> float:
        """The part of all rows that is in some cells."""
        return float(self.counts[cells].sum() / max(1, self.counts.sum()))


def _fitted(points: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centres by Lloyd's rounds on unit vectors; a centre without points takes one that is far from its own."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), size=cells, replace=False)]
    for _ in range(rounds):
        near = points @ centres.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = points[np.argsort(best, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def build(vectors: DataFrame, path: str, ident: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE, rounds: int = 8, seed: int = 7) -> Index:
    """Write an index of vectors (ident long, vector of one length, filter columns) under path. Null vectors are left out.

    cells: by default the square root of the number of rows, MOST_CELLS at most; what the driver holds is cells times
    the length of a vector, and the sample. Repeated rows are rows each.
    """
    spark = vectors.sparkSession
    have = vectors.where(F.col(vector).isNotNull()).select(ident, vector, *keep)
    n = have.count()
    drawn = have.select(vector).where(F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))).toArrow()
    points = _unit(drawn.column(vector).combine_chunks()) if drawn.num_rows else np.zeros((0, 1))
    centres = _fitted(points, max(1, min(len(points), cells or min(MOST_CELLS, int(n**0.5)))), rounds, seed) if len(points) else np.zeros((1, 1))
    names = [ident, vector, *keep]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _unit(batch.column(vector)) @ centres.T if len(points) else np.zeros((batch.num_rows, 1))
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*names, "cell", "angle"])

    fields = StructType([*have.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    dealt = have.mapInArrow(placed, fields).repartitionByRange("cell", ident).sortWithinPartitions("cell", ident)
    dealt.write.option("parquet.block.size", 4 << 20).mode("overwrite").parquet(f"{path}/rows")
    told = {r.cell: r for r in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()}
    made = [(i, [float(x) for x in centres[i]], told[i].widest if i in told else 0.0, told[i].n if i in told else 0) for i in range(len(centres))]
    spark.createDataFrame(made, "cell int, centre array<double>, widest double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return load(spark, path, ident, vector)


def load(spark: SparkSession, path: str, ident: str = "vec_id", vector: str = "embedding") -> Index:
    """The index under path."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return Index(path, ident, vector, np.array([r.centre for r in cells]), np.array([r.widest for r in cells]), np.array([r.n for r in cells]), spark)


def _coded(frame: DataFrame, ident: str, vector: str, same: str | None, without: str | None, *more: str) -> DataFrame:
    """The columns that a search works on: hashes of what has to be the same, and of what must not be held."""
    equal = F.xxhash64(same) if same else F.lit(0).cast("long")
    if without is None:
        held = F.array().cast("array<long>")
    elif frame.schema[without].dataType.typeName() == "array":
        held = F.transform(F.coalesce(without, F.array()), lambda d: F.xxhash64(d))
    else:
        held = F.array(F.xxhash64(without))
    return frame.select(F.col(ident).alias("i"), F.col(vector).alias("v"), equal.alias("same"), held.alias("held"), *more)


def _searching(ids: np.ndarray, matrix: np.ndarray, same: np.ndarray, held: list[set], asks: np.ndarray, k: int):
    """The function that keeps the k best of each query in a batch of rows (i, v, same, held, cell); asks says which query wants which cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, cells = np.array(batch.column("i"), dtype=np.int64), np.array(batch.column("cell"))
            units, kinds = _unit(batch.column("v")), np.array(batch.column("same"), dtype=np.int64)
            lists = batch.column("held")
            owner = np.repeat(np.arange(len(items)), np.array(lists.value_lengths()))
            flat = np.array(lists.flatten(), dtype=np.int64)
            for cell in np.unique(cells):
                rows, wanted = np.flatnonzero(cells == cell), np.flatnonzero(asks[:, cell])
                if not len(wanted):
                    continue
                scores = matrix[wanted] @ units[rows].T
                scores[(ids[wanted][:, None] == items[rows][None]) | (same[wanted][:, None] != kinds[rows][None])] = -2.0
                for at, q in enumerate(wanted):
                    if held[q] and len(flat):
                        bad = np.zeros(len(items), dtype=bool)
                        bad[owner[np.isin(flat, list(held[q]))]] = True
                        scores[at, bad[rows]] = -2.0
                top = min(k, len(rows))
                best = np.lexsort((np.broadcast_to(items[rows], scores.shape), -scores), axis=1)[:, :top]
                picked = np.take_along_axis(scores, best, axis=1).ravel()
                ok = picked > -1.5
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[wanted], top)[ok]), pa.array(items[rows][best].ravel()[ok]), pa.array(picked[ok])], names=["query", "item", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, complete: bool = True, same: str | None = None, without: str | None = None, where: Column | None = None, log: list | None = None) -> DataFrame:
    """(query, item, score, position): the k rows of the index most similar to each query, itself left out, ties by item.

    queries has the index's ident and vector columns and those named by same and without. same: a column that has to be
    equal (null equals null); without: one whose value a row must not have or, where it is an array, hold any of. where
    filters rows. complete: also search the cells that may hold a better row; without it, those probed alone. log gets
    the share of rows in the cells read, for each pass.
    """
    total = queries.count()
    parts, found = max(1, -(-total // QUERY_BLOCK)), None
    for part in range(parts):
        block = _coded(queries.where(F.pmod(F.xxhash64(index.ident), F.lit(parts)) == part), index.ident, index.vector, same, without).toArrow()
        if not block.num_rows:
            continue
        ids, matrix = np.array(block.column("i"), dtype=np.int64), _unit(block.column("v").combine_chunks())
        kinds, held = np.array(block.column("same"), dtype=np.int64), [set(x) for x in block.column("held").to_pylist()]
        near = matrix @ index.centres.T
        asks = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(asks, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)

        def read(asks=asks, ids=ids, matrix=matrix, kinds=kinds, held=held) -> DataFrame:
            cells = np.flatnonzero(asks.any(axis=0))
            if log is not None:
                log.append(index.share(cells))
            coded = _coded(index.rows(where, cells), index.ident, index.vector, same, without, "cell")
            return coded.mapInArrow(_searching(ids, matrix, kinds, held, asks, k), "query long, item long, score double")

        first = written(_best(read(), k))
        if complete:
            kth = np.full(len(ids), -2.0)
            at = {int(i): j for j, i in enumerate(ids)}
            for r in first.groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).toLocalIterator():  # a row for each query of the block
                kth[at[r["query"]]] = r.s
            bound = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - index.widest[None]))
            more = (bound >= kth[:, None] - 1e-9) & ~asks & (index.counts > 0)[None]
            if more.any():
                first = _best(first.drop("position").unionByName(read(asks=more)), k)
        found = first if found is None else found.unionByName(first)
    return found if found is not None else queries.sparkSession.createDataFrame([], "query long, item long, score double, position int")
