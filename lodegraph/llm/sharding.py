"""Sharding by sampled splitters.

Records are ordered by a key, a size-weighted sample of keys gives quantile boundaries, and every record goes to the
range between two boundaries. Ranges that turn out overfull are subdivided by a sample drawn inside them. Exact totals
of the ranges then place every record on a running sum of sizes, which is cut into shards. Records that are large
beside a shard, of which there can only be few, are dealt first, each to the shard with the least so far, and the cuts
give each shard of the rest what it lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.sources.tables import written

#: Rows that a range should hold; ranges are the groups that one task sorts.
ROWS_PER_RANGE = 20_000
#: Ranges at least and at most; the boundaries travel in the plan, so their number is bounded.
MIN_RANGES, MAX_RANGES = 160, 16_384
#: Sampled keys for each range.
OVERSAMPLE = 24
#: Rounds that subdivide overfull ranges.
MAX_ROUNDS = 3
#: A record is large if it takes more than this part of a shard, so there are fewer than LARGE times the shards of them.
LARGE = 64

_KEYS = ("k1", "k2", "k3")


def _drawn(keys: DataFrame, sample: int, total: int, seed: int) -> list[tuple]:
    """About sample keys, each drawn with a chance that grows with its weight, of total altogether."""
    u = (F.xxhash64(F.lit(seed), *_KEYS).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = keys.where(-F.log(u) / F.col("weight") < sample / max(total, 1)).select(*_KEYS)
    return sorted(tuple(r) for r in drawn.collect())


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def range_of(bounds: list[tuple], *keys: Column) -> Column:
    """How many boundaries are at most the keys, by binary search in an array that the plan carries."""
    if not bounds:
        return F.lit(0)
    names = _KEYS[: len(keys)]
    spark_bounds = F.arrays_zip(*[F.array(*[F.lit(b[i]) for b in bounds]).cast("array<long>").alias(k) for i, k in enumerate(names)])
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    me = F.struct(*[c.alias(k) for c, k in zip(keys, names, strict=True)])

    def step(at: Column, width: Column) -> Column:
        fits = (at + width) <= F.lit(len(bounds))
        return F.when(fits & (F.get(spark_bounds, at + width - 1) <= me), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _lacking(large: list[int], total: int, shards: int) -> tuple[list[int], list[float]]:
    """The shard of each large size, and what every shard lacks of an equal share of total beside them."""
    sums = [0] * shards
    where = [0] * len(large)
    for i in sorted(range(len(large)), key=lambda i: -large[i]):
        where[i] = min(range(shards), key=lambda s: (sums[s], s))
        sums[where[i]] += large[i]
    rest, open_ = float(total - sum(large)), set(range(shards))
    while True:  # a shard that has more than its share already lacks nothing, and the others share the rest
        share = (rest + sum(sums[s] for s in open_)) / len(open_)
        over = {s for s in open_ if sums[s] > share}
        if not over or over == open_:
            return where, [max(0.0, share - sums[s]) if s in open_ else 0.0 for s in range(shards)]
        open_ -= over


def shard(records: DataFrame, k1: str, k2: str, size: str, shards: int = 40, law: str = "bytes", seed: int = 17) -> DataFrame:
    """records with shard int (0 to shards - 1) and slot long (gapless from 0 inside each shard).

    k1 and k2 are long columns that order the records, nulls first as the least value; put a hash of the text first and
    copies stay next to each other, with the id second a hot group is still cut. law "bytes": sums of size are equal but
    for a part in LARGE, unless a record alone is more than a shard; "rows": counts are at most one apart. Records that
    agree in k1, k2 and size are interchangeable, and are cut like others. Sizes below 1 or null count 1. No records
    give no rows.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law}")
    low = F.lit(-(2**63)).cast("long")
    weight = F.lit(1).cast("long") if law == "rows" else F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(1)), F.lit(1).cast("long"))
    # _k3 tells equal records apart; it is written, so that it stays
    rows = written(records.withColumns({"_k1": F.coalesce(F.col(k1).cast("long"), low), "_k2": F.coalesce(F.col(k2).cast("long"), low), "_k3": F.xxhash64(F.monotonically_increasing_id()), "_w": weight}))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("_w"), F.lit(0))).first()
    is_large = F.col("_w") * F.lit(LARGE * shards) > F.lit(total) if law == "bytes" else F.lit(False)
    large = sorted(tuple(r) for r in rows.where(is_large).select("_k1", "_k2", "_k3", "_w").collect()) if law == "bytes" else []  # fewer than LARGE * shards
    where, lacking = _lacking([r[3] for r in large], total, shards)
    small, total = rows.where(~is_large), total - sum(r[3] for r in large)
    keys = small.select(*[F.col(f"_{k}").alias(k) for k in _KEYS], F.col("_w").alias("weight"))
    parts = min(MAX_RANGES, max(MIN_RANGES, -(-n // ROWS_PER_RANGE)))
    bounds = sorted(set(_quantiles(_drawn(keys, parts * OVERSAMPLE, total, seed), parts)))
    for again in range(1, MAX_ROUNDS + 1):
        ranged = keys.withColumn("range", range_of(bounds, *map(F.col, _KEYS)))
        totals = {r.range: (r.n, r.w) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
        full = [r for r, (rn, w) in totals.items() if rn > max(2 * n / parts, 64) or w > 2 * total / parts and rn > 1]
        if not full or len(bounds) + 4 * len(full) > MAX_RANGES:
            break
        more = _drawn(ranged.where(F.col("range").isin(full)), len(full) * OVERSAMPLE * 4, sum(totals[r][1] for r in full), seed + again)
        bounds = sorted({*bounds, *_quantiles(more, 4 * len(full))})
    placed = small.withColumn("_range", range_of(bounds, *[F.col(f"_{k}") for k in _KEYS]))
    sums = placed.groupBy("_range").agg(F.sum("_w").alias("rw")).collect()
    before, at_w = {}, 0
    for r in sorted(sums, key=lambda r: r._range):
        before[r._range], at_w = at_w, at_w + r.rw
    offset = F.create_map(*[F.lit(x) for r, w in before.items() for x in (r, w)]) if before else F.create_map(F.lit(0), F.lit(0))
    order = ("_k1", "_k2", size, "_k3")
    placed = placed.withColumn("_end", F.sum("_w").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("_end") - F.col("_w") + F.element_at(offset, F.col("_range")).cast("long")
    # "bytes": a record goes where its middle falls; "rows": the running count decides
    if law == "bytes":
        cuts, at = [], 0.0
        for lack in lacking[:-1]:
            at += lack
            cuts.append(at)
        of = sum(((start * 2 + F.col("_w") >= F.lit(2 * cut)).cast("int") for cut in cuts), F.lit(0))
    else:
        of = F.least(F.floor(start.cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int"), F.lit(shards - 1))
    placed = placed.withColumn("shard", of)
    pieces = sorted((r.shard, r._range, r.n) for r in placed.groupBy("shard", "_range").agg(F.count("*").alias("n")).collect())
    firsts, held = [], [0] * shards
    for s, r, count in pieces:
        firsts.append((s * 2**32 + r, held[s]))
        held[s] += count
    first = F.create_map(*[F.lit(x) for pair in firsts for x in pair]) if firsts else F.create_map(F.lit(0), F.lit(0))
    here = Window.partitionBy("_range", "shard").orderBy(*order)
    slot = F.row_number().over(here) - 1 + F.element_at(first, F.col("shard").cast("long") * F.lit(2**32) + F.col("_range"))
    placed = placed.withColumn("slot", slot.cast("long"))
    dealt = []
    for key, s in zip(large, where, strict=True):
        dealt.append((key[2], s, held[s]))
        held[s] += 1
    out = [*records.columns, "shard", "slot"]
    dealt = records.sparkSession.createDataFrame(dealt, "_k3 long, shard int, slot long")
    return placed.select(*out).unionByName(rows.where(is_large).join(F.broadcast(dealt), "_k3").select(*out))  # LARGE * shards bound it


def op2_sharding(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """All documents in shards 0 to 39 under law bytes.

    Null texts have size 16 and the CRC of the empty text; repeated rows each get a slot of their own; null ids come
    first in their text's range, ties are interchangeable; further columns are ignored; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    )
    placed = shard(records, "text_hash", "doc_id", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
