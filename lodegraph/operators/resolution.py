"""Entities that are one: upserts by name, links between near vectors, canonical ids and merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import names as N
from lodegraph.operators.components import connected_components
from lodegraph.sources.tables import written

#: Vectors in a block that near_pairs compares with another, how many of one meet the other at once, and pairs that are summed at once.
BUCKET, SLICE, PAIRS = 4_096, 512, 1 << 16

# fixed values: similarities from which an entity is the same, is merged, is linked as the same, is linked as similar
EXACT, MERGE, SAME_AS, SIMILAR_TO = 0.98, 0.92, 0.85, 0.75


def action(similarity: Column, ladder: tuple[float, ...] = (EXACT, MERGE, SAME_AS, SIMILAR_TO)) -> Column:
    """What becomes of an entity by its best candidate's similarity: matched, merged, linked_same, linked_similar or created."""
    s = F.coalesce(similarity, F.lit(0.0))
    return F.when(s >= ladder[0], "matched").when(s >= ladder[1], "merged").when(s >= ladder[2], "linked_same").when(s >= ladder[3], "linked_similar").otherwise("created")


def in_document(entities: DataFrame) -> DataFrame:
    """One entity for each document and normalised name: the surest mention, with how many there were (doc, name, confidence)."""
    keyed = entities.withColumn("key", N.entity_key(F.col("name")))
    w = Window.partitionBy("doc", "key").orderBy(F.desc("confidence"), "name")
    return keyed.withColumns({"mentions": F.count("*").over(Window.partitionBy("doc", "key")), "_k": F.row_number().over(w)}).where("_k = 1").drop("_k")


def upserted(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(key, name, type, confidence, description) after incoming entities were laid over base by normalised name.

    The surer of two keeps its name, type and confidence, the one in base on ties; a description only fills a missing one.
    Both have name, type, confidence and description, and one row a key.
    """
    cols = ("name", "type", "confidence", "description")
    a = base.select(N.entity_key(F.col("name")).alias("key"), F.struct(*cols).alias("a"))
    b = incoming.select(N.entity_key(F.col("name")).alias("key"), F.struct(*cols).alias("b"))
    surer = F.when(F.col("a").isNull() | (F.col("b.confidence") > F.col("a.confidence")), F.col("b")).otherwise(F.col("a"))
    return a.join(b, "key", "full_outer").select("key", surer["name"].alias("name"), surer["type"].alias("type"), surer["confidence"].alias("confidence"), F.coalesce("a.description", "b.description").alias("description"))


def by_name(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """wanted (name) with the id found by normalised name, else by the name as it stands; null where there is none, the least of several."""
    normal = entities.groupBy(N.entity_key(F.col("name")).alias("_key")).agg(F.min("id").alias("_normal"))
    plain = entities.groupBy(F.col("name").alias("_plain")).agg(F.min("id").alias("_raw"))
    found = wanted.withColumn("_key", N.entity_key(F.col("name"))).join(normal, "_key", "left").join(plain, F.col("name") == F.col("_plain"), "left")
    return found.select(*wanted.columns, F.coalesce("_normal", "_raw").alias("id"))


def edges_by_name(named: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst, type, confidence): edges between names (from, to, type, confidence) as edges between all entities so called, the surest of equals."""
    keys = entities.select("id", N.entity_key(F.col("name")).alias("_key"))
    a = named.select(N.entity_key(F.col("from")).alias("_f"), N.entity_key(F.col("to")).alias("_t"), N.relation_type(F.col("type")).alias("type"), "confidence")
    a = a.groupBy("_f", "_t", "type").agg(F.max("confidence").alias("confidence"))  # once for all entities of the names, not for each edge
    both = a.join(keys.select(F.col("id").alias("src"), F.col("_key").alias("_f")), "_f").join(keys.select(F.col("id").alias("dst"), F.col("_key").alias("_t")), "_t")
    return both.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def find_edges(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """wanted (src, dst, type) with found: the edge as asked, else the other way round, else one of another type; null for none."""
    e = edges.select("src", "dst", "type").distinct()
    ahead = e.withColumn("_a", F.lit(True))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.lit(True).alias("_b"))
    other = e.select("src", "dst", F.lit(True).alias("_o")).distinct()
    got = wanted.join(ahead, ["src", "dst", "type"], "left").join(back, ["src", "dst", "type"], "left").join(other, ["src", "dst"], "left")
    return got.select(*wanted.columns, F.when(F.col("_a"), "exact").when(F.col("_b"), "reversed").when(F.col("_o"), "other_type").alias("found"))


def canonical(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, canonical): the least id that each id (id) reaches over links (a, b); itself without any."""
    classes = connected_components(links).select(F.col("node").alias("id"), "component")
    return ids.select("id").distinct().join(classes, "id", "left").select("id", F.coalesce("component", "id").alias("canonical"))


def merged(entities: DataFrame) -> DataFrame:
    """One row for each canonical: longest description, documents and aliases as sets, mean confidence, mentions added up.

    entities: canonical, id, name, description, doc, confidence, mentions. The name is that of the canonical entity.
    """
    longest = F.max_by("description", F.struct(F.length("description"), F.col("id")))
    return entities.groupBy("canonical").agg(
        F.min_by("name", "id").alias("name"), longest.alias("description"), F.array_sort(F.collect_set("doc")).alias("docs"), F.array_sort(F.collect_set("name")).alias("aliases"),
        F.avg("confidence").alias("confidence"), F.sum("mentions").alias("mentions"),
    )


def related(links: DataFrame, similar: bool = False, most: int = 20) -> DataFrame:
    """(id, other, type, place): what each entity is linked with either way as SAME_AS, with similar also as SIMILAR_TO, the surest first."""
    kept = links.where(F.col("type").isin("SAME_AS", "SIMILAR_TO") if similar else F.col("type") == "SAME_AS")
    both = kept.select("src", "dst", "type", "confidence").unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence"))
    once = both.groupBy(F.col("src").alias("id"), F.col("dst").alias("other"), "type").agg(F.max("confidence").alias("confidence"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("id", "type").orderBy(F.desc("confidence"), "other"))).where(F.col("place") <= most)


def near_pairs(vectors: DataFrame, least: float, bits: int, bands: int, ident: str = "vec_id", vector: str = "embedding", group: str | None = None, seed: int = 5) -> DataFrame:
    """(a, b, similarity), a < b: pairs of vectors at least so similar that agree in a band of signs of random projections.

    Those of one group are left out. A pair at angle t agrees in a band with chance 1 - (1 - (1 - t / pi) ** bits) ** bands, so
    choose bits near log2 of the number of vectors and bands for the recall wanted. Vectors of different length have nothing
    in common. Blocks of BUCKET vectors of a length are multiplied with each other, so that a pair is no row before it is
    found: what is shuffled is each vector once for each block. Where bands are as wide as few buckets this is less than
    the pairs of its buckets; work still grows with the square of the vectors.
    """
    types = dict(vectors.dtypes)
    kept = vectors.where(F.col(ident).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())).select(
        F.col(ident).alias("id"), (F.col(group) if group else F.lit(None)).cast("string").alias("g"), F.col(vector).alias("v"), F.size(vector).alias("size")
    )
    blocks = written(kept.groupBy("size").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks")))
    rows = kept.join(F.broadcast(blocks), "size").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("own", "k"), "high": F.greatest("own", "k")})

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size, low, high = (table[c][0].as_py() for c in ("size", "low", "high"))
        planes = np.random.default_rng([seed, size]).standard_normal((size, bands * bits))
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        keys = ((flat @ planes > 0).reshape(len(flat), bands, bits) @ (1 << np.arange(bits))).astype(np.int64)
        norms = _in_order(flat, flat)
        unit = flat / np.sqrt(np.where(norms > 0, norms, 1.0))[:, None]
        groups = pc.fill_null(table["g"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        place = pc.rank(table["id"].combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)
        own = table["own"].to_numpy()
        ones, others = np.flatnonzero(own == low), np.flatnonzero(own == high)
        found = []
        for begin in range(0, len(ones), SLICE):
            mine = ones[begin : begin + SLICE]
            # what rounding of a product could hide is kept for the sum in order
            i, j = np.nonzero(~(unit[mine] @ unit[others].T < least - 1e-9))
            i, j = mine[i], others[j]
            ahead = place[i] < place[j] if low == high else place[i] != place[j]
            if group:
                ahead &= (groups[i] != groups[j]) & (groups[i] >= 0) & (groups[j] >= 0)
            i, j = i[ahead], j[ahead]
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                agree = (keys[x] == keys[y]).any(axis=1)
                x, y = x[agree], y[agree]
                norm = np.sqrt(norms[x] * norms[y])
                similarity = np.where(norm == 0, 0.0, _in_order(flat[x], flat[y]) / np.where(norm == 0, 1.0, norm))
                enough = ~(similarity < least)
                x, y = x[enough], y[enough]
                turned = place[x] > place[y]
                found.append((np.where(turned, y, x), np.where(turned, x, y), similarity[enough]))
        a, b, similarity = (np.concatenate([np.zeros(0, t), *[f[c] for f in found]]) for c, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
        ids = table["id"].combine_chunks()
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "similarity": pa.array(similarity)})

    return rows.select("id", "g", "v", "size", "own", "low", "high").groupBy("size", "low", "high").applyInArrow(compare, f"a {types[ident]}, b {types[ident]}, similarity double")


def _in_order(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Products of rows, added from the first component to the last as cosine adds them."""
    total = np.zeros(len(one))
    for d in range(one.shape[1]):
        total += one[:, d] * other[:, d]
    return total
