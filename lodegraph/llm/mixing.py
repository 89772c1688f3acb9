"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are hashed into blocks. A source's target in words becomes an exact quota of blocks: whole
passes over the source, then the first blocks of a permutation, the last of them cut between two documents. The quotas
of all sources are divided among the output shards by a binary tree: at each node the blocks that the left half gets
are drawn from a multivariate hypergeometric law, so each shard is a simple random draw without replacement. A shard
then owns disjoint stretches of every source's permutation, and a hash orders the documents inside it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm._rows import hidden
from lodegraph.sources.tables import written

#: Blocks of all sources together, about; a hot source has more blocks, not larger ones.
BLOCKS = 4_096
#: Rows of the plan, one for each source and block, that are broadcast; a larger plan is joined by a shuffle.
MOST_SENT = 200_000


def words(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight, each stopped at most times its size, the excess shared again by weight."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]} if weight else set()
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight if weight else 0.0
            break
        for i in sorted(over):
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """quotas dealt among shards: an array of shards x sources whose columns sum to quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def deal(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1 or not counts.sum():
            out[first] = counts
            return
        middle = (first + last) // 2
        draws = int(counts.sum()) * (middle - first) // (last - first)
        left = rng.multivariate_hypergeometric(counts, draws, method="marginals")
        deal(left, first, middle)
        deal(counts - left, middle, last)

    deal(np.array(quotas, dtype=np.int64), 0, shards)
    return out


def _sent(spark, rows: list[tuple], schema: str) -> DataFrame:
    plan = spark.createDataFrame(rows, schema)
    return F.broadcast(plan) if len(rows) <= MOST_SENT else plan


def mix(docs: DataFrame, ident: str, source: str, size: str, weights: list[float], share: float = 1.5, most: float = 2.0, shards: int = 40, seed: int = 29) -> DataFrame:
    """docs with source_size, target, copies, taken (copies times size) and placements: array of (shard, place).

    Sources are taken by code point, null last, and weights repeat over them. The mix takes share times all sizes; a
    source is given most times its size at most, so a document is taken floor(most) times at most. Sources of size 0
    have target 0, and documents of size 0 travel with their block. Equal seeds give equal mixes. Rows that repeat an
    id fall in one block and are told apart by size alone; null ids are spread over the blocks by their size and further
    columns. No documents give no rows. docs is read twice; the driver plans with a row for each source and block.
    """
    spark = docs.sparkSession
    totals = [tuple(r) for r in docs.groupBy(source).agg(F.sum(size), F.count("*")).collect()]  # a row a source
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1] or 0) for r in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(totals))], share * sum(sizes), most)
    per_block = max(1, sum(sizes) // BLOCKS)
    blocks = [max(1, min(s // per_block, r[2])) for s, r in zip(sizes, totals, strict=True)]
    plan = _sent(spark, [(r[0], i, s, t, b) for i, (r, s, t, b) in enumerate(zip(totals, sizes, targets, blocks, strict=True))], f"_source {dict(docs.dtypes)[source]}, _s int, source_size long, target double, _blocks int")
    told = docs.join(plan, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    key = F.when(F.col(ident).isNotNull(), F.xxhash64(F.lit(seed), F.col(ident).cast("string"))).otherwise(F.xxhash64(F.lit(seed), *[c for c in docs.columns if c != ident]))
    told = told.withColumn("_h", key).withColumn("_block", F.pmod("_h", "_blocks").cast("int"))
    # the permutation of each source's blocks, and the words before each block in it; BLOCKS rows or so
    sums = written(told.groupBy("_s", "_block", "target", "source_size").agg(F.sum(size).alias("_words")))
    order = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed + 1), "_s", "_block"), "_block")
    sums = sums.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_before", F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sums = sums.withColumn("_passes", passes).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_passes") * F.col("source_size") - F.col("_before")))
    sums = written(sums, 1)
    quotas = [0] * len(totals)
    present = {}
    for r in sums.groupBy("_s").agg(F.count("*").alias("n"), F.first("_passes").alias("p"), F.sum((F.col("_rest") > 0).cast("int")).alias("extra")).collect():
        quotas[r._s], present[r._s] = r.n * r.p + r.extra, r.n
    dealt = split_quotas(quotas, shards, seed)
    ends = _sent(spark, [(i, [int(x) for x in np.cumsum(dealt[:, i])], present.get(i, 1)) for i in range(len(totals))], "_s int, _ends array<long>, _present int")
    sums = sums.select("_s", "_block", "_rank", "_passes", "_rest", "_words").join(ends, "_s")
    told = told.join(F.broadcast(sums) if sum(blocks) <= MOST_SENT else sums, ["_s", "_block"])
    # only in the block that the quota cuts do documents need an order
    cut = (F.col("_rest") > 0) & (F.col("_rest") < F.col("_words"))
    inside = Window.partitionBy("_s", "_block").orderBy("_h", ident, size).rowsBetween(Window.unboundedPreceding, 0)
    # a document goes with the quota if that brings the words taken closer to it
    in_cut = told.where(cut).withColumn("_more", (F.sum(size).over(inside) - F.col(size) / 2 <= F.col("_rest")).cast("int"))
    told = told.where(~cut).withColumn("_more", (F.col("_rest") > 0).cast("int")).unionByName(in_cut)
    copies = F.when(F.col("source_size") > 0, F.col("_passes") + F.col("_more")).otherwise(F.lit(0))
    told = told.withColumn("copies", F.least(copies, F.lit(int(most))).cast("int"))

    def placement(copy: Column) -> Column:
        at = copy.cast("long") * F.col("_present") + F.col("_rank")
        return F.struct(
            F.least(F.size(F.filter("_ends", lambda end: end <= at)), F.lit(shards - 1)).alias("shard"),
            F.xxhash64(F.lit(seed + 2), F.col("_h"), copy).alias("place"),
        )

    told = told.withColumn("placements", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), placement)).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>")))
    told = told.withColumn("taken", (F.col("copies") * F.col(size)).cast("long"))
    return told.drop("_s", "_h", "_block", "_blocks", "_rank", "_passes", "_rest", "_words", "_ends", "_present", "_more")


def op3_mixing(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """The mix of all documents at weights 5, 2, 1 over 150 % of their words, with each document's placements.

    Null texts have no words; null sources are one source, last; null ids are dealt to blocks by their size; repeated rows
    are taken alike unless the quota ends between them; ties in the order inside a block are such rows alone; further
    columns are ignored; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")))
    mixed = mix(sized, "doc_id", "source", "size", [5.0, 2.0, 1.0])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "placements")


def mixed_copies(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it, laid out shard by shard in the order that the splitting tree dealt.

    Rows are written in stretches of a shard's order, each a partition, so their files hold the mix as it is to be read.
    Nulls, ties and repeated rows count as in op3_mixing, an empty table gives no rows, columns may have any name.
    """
    plain, name = hidden(docs)
    sized = plain.select("*", F.col(name["doc_id"]).cast("long").alias("_doc"), F.col(name["source"]).cast("string").alias("_source_name"), words(F.col(name["text"]).cast("string")).alias("_size"))
    mixed = mix(sized, "_doc", "_source_name", "_size", [5.0, 2.0, 1.0]).select(*plain.columns, F.explode("placements").alias("_at"))
    # places are hashes, so equal parts of their range hold about as many rows: no sampling is needed for a stretch
    parts = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 40))
    stretch = F.least(F.floor((F.col("_at.place") / float(2**64) + 0.5) * parts), F.lit(parts - 1)).cast("int")
    dealt = mixed.withColumn("_part", stretch).repartition(40 * parts, "_at.shard", "_part").sortWithinPartitions("_at.shard", "_part", "_at.place")
    return dealt.select(*plain.columns).toDF(*docs.columns)
