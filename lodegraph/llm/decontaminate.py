"""Benchmark decontamination by SimHash of item-sized windows.

A passage leaks when a window of a document that is as long as a benchmark item is near to the item. Windows are
fingerprinted by SimHash and looked up in a multi-index: a fingerprint is cut into RADIUS + 1 blocks, so that any two
within RADIUS bits agree in a block, and blocks are joined by equality. Exact weighted-shingle similarity of window and
item then decides. Windows are cut at every start where shingles of items of that length, whatever their order, are so
many that the similarity can be reached; a window with fewer can't be similar enough to any.

All of it is DataFrame functions. The documents are read twice: for the places of the items' shingles, and for the words
of the windows; of the second read only texts that have such windows are split into words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm._rows import hidden
from lodegraph.sources.tables import written

#: Words of a shingle, and the least weighted Jaccard similarity of a leak.
WORDS, SIMILARITY = 5, 0.75
#: Bits in which the fingerprints of a leak and its item may differ; a changed word in a short item changes about 8.
RADIUS = 13
#: Shingles of the benchmark that are broadcast at once; a larger benchmark is searched in blocks of this size. Other
#: tables are broadcast up to as many rows, and joined by a shuffle beyond.
MOST_SHINGLES = 1_000_000

_SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Hashes of the lower-cased words in order; null has none."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != F.lit("")), lambda w: F.xxhash64(w))


def grams(of: Column, k: int) -> Column:
    """Hashes of all runs of k words in order; none if there are fewer."""
    return F.when(F.size(of) >= k, F.transform(F.sequence(F.lit(0), F.size(of) - k), lambda i: F.xxhash64(*[F.get(of, i + j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))


def shingles(of: Column) -> Column:
    """Hashes of the runs of WORDS words; fewer words make one shingle, no words none."""
    few = F.coalesce(*[F.when(F.size(of) == k, grams(of, k)) for k in range(1, WORDS)], F.array().cast("array<long>"))
    return F.when(F.size(of) >= WORDS, grams(of, WORDS)).otherwise(few)


def simhash(of: Column) -> Column:
    """64-bit SimHash of words, each weighted by its count: bit b is set if most of the word hashes have it."""

    def bit(so_far: Column, b: Column) -> Column:
        votes = F.aggregate(of, F.lit(0), lambda n, h: n + (F.getbit(h, b).cast("int") * 2 - 1))
        return F.when(votes > 0, so_far.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(so_far)

    # up to 255 words, every eighth bit is counted at once, in the eight bytes of a long
    eighth = lambda i: F.aggregate(of, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(0x0101010101010101)))

    def eight(so_far: Column, s: Column) -> Column:
        count = lambda j: F.call_function("shiftrightunsigned", s["counts"], j * 8).bitwiseAND(F.lit(255))
        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), so_far, lambda x, j: F.when(count(j) * 2 > F.size(of), x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j * 8 + s["i"]))).otherwise(x))

    few = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("i"), eighth(i).alias("counts"))), F.lit(0).cast("long"), eight)
    return F.when(F.size(of) < 256, few).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit))


def blocks(fingerprint: Column) -> Column:
    """(number, value) of the RADIUS + 1 blocks that a fingerprint is cut into."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("number"), F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value")) for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))])


def similarity(one: Column, other: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists, the weight of a shingle being how often it occurs."""
    times = lambda of, s: F.size(F.filter(of, lambda x: x == s))
    once = lambda of: F.size(F.array_distinct(of)) == F.size(of)
    both = F.aggregate(F.array_intersect(one, other), F.lit(0), lambda n, s: n + F.least(times(one, s), times(other, s)))
    both = F.when(once(one) | once(other), F.size(F.array_intersect(one, other))).otherwise(both)
    return F.when(F.size(one) + F.size(other) > 0, both / (F.size(one) + F.size(other) - both)).otherwise(F.lit(0.0))


def _sent(frame: DataFrame) -> DataFrame:
    """A written table, to be broadcast unless it has too many rows."""
    return F.broadcast(frame) if frame.count() <= MOST_SHINGLES else frame


def _runs(hits: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, low, high): runs of the starts, ends included, of windows that have enough hits.

    hits has the places pos of items' shingles, n_words of these items, and of all shingles that long in the text n_grams.
    Of n shingles in the item and w in the window, similarity s asks for (n + w) s / (1 + s) in both.
    """
    own = hits.groupBy("doc_id", "text_hash", "n_words").agg(F.sort_array(F.collect_set("pos")).alias("places"), F.max("n_grams").alias("n_grams"))
    n = F.greatest(F.col("n_words") - WORDS + 1, F.lit(1))
    own = own.withColumn("wide", F.least(n, F.col("n_grams"))).withColumn("need", F.ceil((n + F.col("wide")) * SIMILARITY / (1 + SIMILARITY) - 1e-9).cast("int"))
    own = own.where(F.size("places") >= F.col("need")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("places") - F.col("need"))))
    # with hit i as its first, a window starts after the hit before and reaches the last hit that it needs
    low = F.greatest(F.coalesce(F.get("places", F.col("i") - 1), F.lit(-1)) + 1, F.get("places", F.col("i") + F.col("need") - 1) - F.col("wide") + 1)
    high = F.least(F.get("places", F.col("i")), F.col("n_grams") - F.col("wide"))
    return own.select("doc_id", "text_hash", "n_words", low.alias("low"), high.alias("high")).where("low <= high")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, hamming, start_word, n_words, item_copies): the best window of each item in each text.

    docs has doc_id and text, benchmark item_id and text. Items with equal words are one, named by their least id, with
    item_copies of them. Items without words leak nowhere; items of fewer than WORDS words leak where all their words
    occur in order. Null texts are empty. text_hash tells rows apart that share an id or have none. A passage that
    repeats in a text counts once, at its most similar and then first place.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("item_copies"))
    items = written(items.select("item_id", "item_copies", "words", F.size("words").alias("n_words"), shingles(F.col("words")).alias("shingles"), simhash(F.col("words")).alias("fingerprint")))
    about = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n"), F.sort_array(F.collect_set(F.least("n_words", F.lit(WORDS)))).alias("sizes")).first()
    parts = max(1, -(-about.n // MOST_SHINGLES))
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    hits = []
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part) if parts > 1 else items
        for k in about.sizes or [WORDS]:
            places = own.where(F.least("n_words", F.lit(WORDS)) == k).select("n_words", F.explode("shingles").alias("gram")).distinct()
            # the hashes are a column before they are exploded, which keeps the generator and the join in one codegen stage; the
            # outer form keeps Catalyst from inferring a filter that would compute them again below
            spread = split.withColumn("grams", grams(F.col("words"), k)).select("doc_id", "text_hash", F.size("grams").alias("n_grams"), F.posexplode_outer("grams").alias("pos", "gram"))
            hits.append(spread.join(F.broadcast(places), "gram").select("doc_id", "text_hash", "n_words", "n_grams", "pos"))  # MOST_SHINGLES bounds it
    runs = written(_runs(reduce(DataFrame.union, hits)))
    runs = _sent(runs.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"}))
    whole = docs.withColumn("text_hash", F.xxhash64("text")).join(runs, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    whole = whole.withColumn("words", words(F.col("text"))).select("doc_id", "text_hash", "n_words", "words", F.explode(F.sequence("low", "high")).alias("start_word"))
    windows = whole.select("doc_id", "text_hash", "n_words", "start_word", F.explode(F.array(F.slice("words", F.col("start_word") + 1, F.col("n_words")))).alias("window"))
    windows = written(windows.withColumn("mark", simhash(F.col("window"))))
    cut = windows.select("n_words", "mark").distinct().withColumn("block", F.explode(blocks(F.col("mark")))).select("n_words", "mark", "block.number", "block.value")
    index = items.withColumn("block", F.explode(blocks(F.col("fingerprint")))).select("item_id", "n_words", "fingerprint", "block.number", "block.value")
    near = cut.join(index, ["n_words", "number", "value"]).withColumn("hamming", F.bit_count(F.col("mark").bitwiseXOR(F.col("fingerprint")))).where(F.col("hamming") <= RADIUS)
    # each pair where the first block in which it agrees is, so that it is verified once
    agree = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    differ = F.col("mark").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(F.shiftrightunsigned(differ, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) == 0, F.lit(i)) for i, (low, high) in enumerate(zip(agree, agree[1:], strict=False))])
    near = _sent(written(near.where(F.col("number") == first).select("n_words", "mark", "item_id", "hamming")))
    known = items.select("item_id", "item_copies", F.col("shingles"))
    near = windows.join(near, ["n_words", "mark"]).join(F.broadcast(known) if parts == 1 else known, "item_id")
    near = near.withColumn("own", F.explode(F.array(shingles(F.col("window"))))).withColumn("similarity", similarity(F.col("own"), F.col("shingles"))).where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "hamming", "n_words", "item_copies")).alias("b")
    return near.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "b.similarity", F.col("b.hamming").cast("int").alias("hamming"), (-F.col("b.s")).alias("start_word"), "b.n_words", "b.item_copies")


def _typed(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def op4_decontamination(spark, sf_dir: str, docs: DataFrame | None = None, benchmark: DataFrame | None = None) -> DataFrame:
    """The benchmark items that leak into documents: one row for each contaminated document and item.

    Documents without leaks give no row, so empty tables give none; rows that repeat a document count as one; a null
    doc_id stays null.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet") if benchmark is None else benchmark
    return find_leaks(_typed(docs), benchmark).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "hamming", "start_word", "n_words", "item_copies")


def without_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark item leaks into, in the columns of docs.

    Rows are told apart by id and text: copies under other ids are judged alike, repeated rows go together. Null and empty
    texts and an empty benchmark have no leaks, an empty table gives no rows, columns may have any name.
    """
    plain, name = hidden(docs)
    ident, text = F.col(name["doc_id"]).cast("long"), F.col(name["text"]).cast("string")
    leaks = find_leaks(plain.select(ident.alias("doc_id"), text.alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = written(leaks.select(F.col("doc_id").alias("_leak"), F.col("text_hash").alias("_hash")).distinct())
    return plain.join(leaks, ident.eqNullSafe(F.col("_leak")) & (F.xxhash64(text) == F.col("_hash")), "left_anti").toDF(*docs.columns)
