"""Vector codes by a dual-tree Lloyd iteration.

Vectors become integers and are cut into parts; every part position has a codebook of its own. A task lays a tree over
each position's parts of a block of vectors once, with the box, the sum and the count of every node; the blocks are
written. In each round a small tree over the entries is laid against them: bounds on the distance between two nodes'
boxes rule entry nodes out, a node of parts with one entry left is assigned whole by its cached sum, and only the parts
of leaves that stay uncertain are measured one by one. All bounds and distances are integers, so nothing depends on
rounding or on how rows were dealt into blocks.

Only sums for each entry come to the driver: PARTS x ENTRIES x the width of a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.sources.tables import scratch_path, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that share a tree, and parts in a leaf at most.
BLOCK, LEAF = 8_192, 16
#: Components must stay below this after scaling, so that squared distances and sums fit into 64 bits.
LARGEST = 1 << 24

_BLOCK_SCHEMA = "ids array<long>, labels array<string>, points binary, places binary"
_CODE_SCHEMA = "vec_id long, label string, code string, error long"


class Tree:
    """A balanced tree over rows: node i of level l holds rows bounds[l][i] to bounds[l][i + 1] of points, which are in tree order."""

    def __init__(self, points: np.ndarray, leaf: int, places: np.ndarray | None = None):
        m = len(points)
        self.depth = 0
        while m >> (self.depth + 1) >= 1 and -(-m // (1 << self.depth)) > leaf:
            self.depth += 1
        self.bounds = [(np.arange((1 << level) + 1, dtype=np.int64) * m) >> level for level in range(self.depth + 1)]
        if places is None:
            places = np.arange(m)
            for level in range(self.depth):
                places = places[self._by_widest(points[places], self.bounds[level])]
            points = points[places]
        self.points, self.places = points, places
        self.low, self.high, self.sums = [[np.empty(0)] * (self.depth + 1) for _ in range(3)]
        at = self.bounds[self.depth][:-1]
        self.low[-1], self.high[-1], self.sums[-1] = np.minimum.reduceat(points, at), np.maximum.reduceat(points, at), np.add.reduceat(points, at)
        for level in reversed(range(self.depth)):
            self.low[level] = np.minimum(self.low[level + 1][::2], self.low[level + 1][1::2])
            self.high[level] = np.maximum(self.high[level + 1][::2], self.high[level + 1][1::2])
            self.sums[level] = self.sums[level + 1][::2] + self.sums[level + 1][1::2]

    @staticmethod
    def _by_widest(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """An order that sorts the rows of each node by its widest component."""
        wide = np.maximum.reduceat(points, bounds[:-1]) - np.minimum.reduceat(points, bounds[:-1])
        node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return np.lexsort((points[np.arange(len(points)), wide.argmax(axis=1)[node]], node))


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each row in tree order, sums and counts of each entry, rows assigned by whole nodes): nearest, ties to the lower index."""
    entries, lows, highs, grow = _entry_levels(book)
    single = len(lows) - 1
    codes = np.zeros(len(tree.points), dtype=np.int64)
    sums, counts = np.zeros_like(book), np.zeros(len(book), dtype=np.int64)
    nodes, level, whole = np.zeros(1, dtype=np.int64), 0, 0
    alive = np.ones((1, 1), dtype=bool)  # of the nodes, against the entry tree's nodes at its level
    while len(nodes):
        low, high = tree.low[level][nodes][:, None], tree.high[level][nodes][:, None]
        step = min(level, single)
        apart = np.maximum(0, np.maximum(low - highs[step], lows[step] - high))
        across = np.maximum(high - lows[step], highs[step] - low)
        least, most = (apart * apart).sum(axis=2), (across * across).sum(axis=2)
        alive &= least <= np.where(alive, most, np.iinfo(np.int64).max).min(axis=1)[:, None]
        if step == single:  # single entries: the one nearest to the middle may rule out others on all of the box
            mine, original = entries.points, entries.places
            middle = ((low + high - 2 * mine) ** 2).sum(axis=2)
            best = np.where(alive, middle, np.iinfo(np.int64).max).argmin(axis=1)
            toward = mine[None] - mine[best][:, None]
            reach = 2 * np.maximum(toward * low, toward * high).sum(axis=2)
            norms = (mine * mine).sum(axis=1)
            room = norms[None] - norms[best][:, None]
            beaten = (reach < room) | ((reach == room) & (original[None] > original[best][:, None]))
            beaten[np.arange(len(nodes)), best] = False
            alive &= ~beaten
            done = alive.sum(axis=1) == 1
            if done.any():
                entry, starts = original[alive[done].argmax(axis=1)], tree.bounds[level]
                sizes = starts[nodes[done] + 1] - starts[nodes[done]]
                np.add.at(sums, entry, tree.sums[level][nodes[done]])
                np.add.at(counts, entry, sizes)
                codes[_ranges(starts[nodes[done]], sizes)] = np.repeat(entry, sizes)
                whole += int(sizes.sum())
                nodes, alive = nodes[~done], alive[~done]
        if level == tree.depth:
            break
        nodes = (nodes[:, None] * 2 + np.arange(2)).ravel()
        alive = np.repeat(alive, 2, axis=0)
        level += 1
        if level <= single:
            alive = np.repeat(alive, grow[step], axis=1)
    if len(nodes):
        for more in grow[min(level, single) :]:  # fewer levels of parts than of entries
            alive = np.repeat(alive, more, axis=1)
        column = np.argsort(entries.places)
        starts = tree.bounds[tree.depth]
        sizes = starts[nodes + 1] - starts[nodes]
        rows, owner = _ranges(starts[nodes], sizes), np.repeat(np.arange(len(nodes)), sizes)
        nearest, found = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), dtype=np.int64)
        for k in range(len(book)):
            asked = alive[owner, column[k]]
            if asked.any():
                far = ((tree.points[rows[asked]] - book[k]) ** 2).sum(axis=1)
                better = far < nearest[asked]
                at = np.flatnonzero(asked)[better]
                nearest[at], found[at] = far[better], k
        codes[rows] = found
        np.add.at(sums, found, tree.points[rows])
        np.add.at(counts, found, 1)
    return codes, sums, counts, whole


def _entry_levels(book: np.ndarray) -> tuple[Tree, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The tree over entries, least and greatest components of its nodes by level down to single entries, and how many nodes each has below it."""
    tree = Tree(book, 1)
    bounds, lows, highs = list(tree.bounds), list(tree.low), list(tree.high)
    if len(bounds[-1]) <= len(book):
        bounds, lows, highs = [*bounds, np.arange(len(book) + 1)], [*lows, tree.points], [*highs, tree.points]
    return tree, lows, highs, [np.diff(np.searchsorted(below, above)) for above, below in zip(bounds, bounds[1:])]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, sizes of them, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _block(ids: list, labels: list, rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row of the block table: vectors, and for each position the parts in tree order with their places."""
    points, places = [], []
    for part in np.split(rows, parts, axis=1):
        tree = Tree(part, LEAF)
        points.append(tree.points.astype("<i4").tobytes())
        places.append(tree.places.astype("<i4").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([b"".join(points)], pa.binary()), pa.array([b"".join(places)], pa.binary())], names=["ids", "labels", "points", "places"]
    )


def _blocks_of(width: int, parts: int):
    """The function that makes blocks of vectors (vec_id, label, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = [], [], []
        for batch in batches:
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * float(SCALE)).astype(np.int64)
            dense = np.zeros((batch.num_rows, width), dtype=np.int64)
            dense[np.repeat(np.arange(batch.num_rows), sizes), _ranges(np.zeros_like(sizes), sizes)] = values
            own_ids, own_labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            for low in range(0, batch.num_rows, BLOCK):
                ids, labels = ids + own_ids[low : low + BLOCK], labels + own_labels[low : low + BLOCK]
                rows.append(dense[low : low + BLOCK])
                if len(ids) >= BLOCK:
                    yield _block(ids, labels, np.concatenate(rows), parts)
                    ids, labels, rows = [], [], []
        if ids:
            yield _block(ids, labels, np.concatenate(rows), parts)

    return run


def _trees(batch: pa.RecordBatch, row: int, width: int, parts: int) -> Iterator[Tree]:
    m = len(batch.column("ids")[row])
    points = np.frombuffer(batch.column("points")[row].as_buffer(), dtype="<i4").reshape(parts, m, width // parts)
    places = np.frombuffer(batch.column("places")[row].as_buffer(), dtype="<i4").reshape(parts, m)
    for part in range(parts):
        yield Tree(points[part].astype(np.int64), LEAF, places[part].astype(np.int64))


def _summed(books: np.ndarray, width: int):
    """The function that gives (part, entry, at, total, n) of the blocks of a task."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for part, tree in enumerate(_trees(batch, row, width, parts)):
                    _, s, c, _ = assigned(tree, books[part])
                    sums[part] += s
                    counts[part] += c
        part, entry, at = np.indices(sums.shape, dtype=np.int32)
        used = np.broadcast_to(counts[:, :, None] > 0, sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (part, entry, at, sums, np.broadcast_to(counts[:, :, None], sums.shape))], names=["part", "entry", "at", "total", "n"])

    return run


def _coded(books: np.ndarray, width: int):
    """The function that gives each vector of the blocks its code and error."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                codes, errors = np.zeros((len(ids), parts), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for part, tree in enumerate(_trees(batch, row, width, parts)):
                    own = assigned(tree, books[part])[0]
                    codes[tree.places, part] = own
                    errors[tree.places] += ((tree.points - books[part][own]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label string, code, error) of vectors (vec_id, label, embedding), and the codebooks (parts, entries, width of a part).

    Vectors that are null or hold a null or non-finite component are dropped. Shorter vectors are filled up with zeros
    to the longest, and all to a multiple of parts. With fewer vectors than entries, each is an entry. The first entries
    are those of the least vec_ids, null ones last and equal ones by their components. Components of 4,096 and more raise.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits tell at most 256 entries")
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("embedding")).where(F.col("embedding").isNotNull() & fine)
    n, longest, largest = kept.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if (largest or 0) * SCALE >= LARGEST or n * LARGEST >= 1 << 62:
        raise ValueError(f"components must be below {LARGEST / SCALE:.0f}, found {largest}")
    width = max(parts, -(-(longest or 0) // parts) * parts)
    if not n:
        return vectors.sparkSession.createDataFrame([], _CODE_SCHEMA), np.zeros((parts, 0, width // parts), dtype=np.int64)
    path = scratch_path(vectors.sparkSession)
    kept.mapInArrow(_blocks_of(width, parts), _BLOCK_SCHEMA).write.option("parquet.block.size", 16 << 20).parquet(path)
    blocks = vectors.sparkSession.read.schema(_BLOCK_SCHEMA).parquet(path)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = np.zeros((len(first), width), dtype=np.int64)
    for i, r in enumerate(first):
        start[i, : len(r.embedding)] = np.floor(np.array(r.embedding, dtype=np.float64) * SCALE).astype(np.int64)
    books = np.stack(np.split(start, parts, axis=1))
    for _ in range(rounds):
        sums = blocks.mapInArrow(_summed(books, width), "part int, entry int, at int, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():  # parts * entries * width of a part
            books[r.part, r.entry, r.at] = r.total // r.n
    return blocks.mapInArrow(_coded(books, width), _CODE_SCHEMA), books


def op11_codes(spark, sf_dir: str, vectors: DataFrame | None = None) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of embeddings; cases as in compressed.

    Repeated and null vec_ids are rows of their own. Null labels are one label. Further columns are left out. No
    vectors give no rows.
    """
    coded, books = compressed(table(spark, sf_dir, "embeddings") if vectors is None else vectors)
    coded = written(coded)
    told = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    labels = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def _round(r: int) -> str:
    """SQL of round r: the nearest entries a{r} under the codebooks c{r}, and the next codebooks."""
    return f"""d{r} AS (SELECT k, part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c USING (part, at_) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT k, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM d{r} GROUP BY ALL),
s{r} AS (SELECT part, entry, at_, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (k, part) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, entry, at_, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{r} LEFT JOIN s{r} USING (part, entry, at_))"""


#: The same rounds by joins of all parts with all entries.
ORACLE = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT k, i // (w // {PARTS}) AS part, i % (w // {PARTS}) AS at_, floor({SCALE} * e[i + 1]::DOUBLE)::BIGINT AS v FROM (SELECT k, e, len(e) AS w, unnest(range(len(e))) AS i FROM kept)),
c0 AS (SELECT part, k AS entry, at_, v FROM x WHERE k < {ENTRIES}),
{", ".join(_round(r) for r in range(ROUNDS + 1))},
coded AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, at_)) FROM c{ROUNDS}) AS codebooks_sha256 FROM kept JOIN coded USING (k)"""
