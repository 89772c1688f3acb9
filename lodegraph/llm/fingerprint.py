"""Order-independent document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors, each
lane modulo a power of two. Sums do not depend on order, equal multisets have equal sums, and adding or taking away a
paragraph adds or subtracts one vector (`combined`). The vector has two parts: 16 lanes modulo 2**32 from SHA-256 of
the paragraph, for equality, and counters modulo 2**20 of the hash bits of its phrases, for likeness: of the m phrases
of a document, lane j counts those whose j-th bit is set, so 2 * count - m is a random projection of the multiset of
phrases, and the cosine between two such vectors estimates the cosine between the multisets. Phrases end at punctuation
and at some of the spaces, which the last letter of the word before decides, so a text needs no punctuation and a word
that is added or taken away changes one phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.sharding import range_of

#: Lanes of the equality part and their modulus.
WIDE, WIDE_BITS = 16, 32
#: Counters of the likeness part: three in each of 20 longs for each seed, 20 bits apart.
SEEDS, STRIDE, PACKED = (1, 2), 20, 3
_ONES = sum(1 << (STRIDE * i) for i in range(PACKED))
_FULL = (1 << (STRIDE * PACKED)) - 1
#: Where phrases end: at punctuation, and at a space after d, e, l, o, 0, 4, 8 or a letter beyond ASCII, so that prose without punctuation has phrases of some three words.
ENDS = "[.,;:!?|\\n\u3001\u3002\uff0c\uff01\uff1f]+\\s*|\\x20(?<=[deloDELO048]\\x20|[^\\x00-\\x7f]\\x20)"
#: Rows that a bucket of neighbouring ids should hold, buckets at most (their bounds travel in the plan), sampled rows for each.
ROWS_PER_BUCKET, MAX_BUCKETS, OVERSAMPLE = 2_000, 16_384, 20


def _masked(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask))


def paragraphs(text: Column) -> Column:
    """Lines with something in them, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(p)), lambda p: p != F.lit(""))


def vector(text: Column) -> Column:
    """The fingerprint of a text as array<long>: WIDE lanes, then the packed counters of each seed, then the phrase count."""
    lines = paragraphs(text)
    phrases = F.filter(F.split(F.coalesce(text, F.lit("")), ENDS), lambda p: p != F.lit(""))
    digests = F.transform(lines, lambda p: F.sha2(p, 256))
    zeros = F.array_repeat(F.lit(0).cast("long"), WIDE)
    lanes = F.array(*[F.lit(i) for i in range(WIDE)])
    wide = F.aggregate(digests, zeros, lambda acc, d: F.zip_with(acc, lanes, lambda v, i: _masked(v + _masked(F.xxhash64(d, i), (1 << WIDE_BITS) - 1), (1 << WIDE_BITS) - 1)))
    shifts = F.array(*[F.lit(i) for i in range(STRIDE)])

    def hashes(seed: int) -> Column:
        return F.transform(phrases, lambda p: F.xxhash64(p, F.lit(seed)))

    counters = [
        F.aggregate(hashes(seed), F.array_repeat(F.lit(0).cast("long"), STRIDE), lambda acc, h: F.zip_with(acc, shifts, lambda v, i: _masked(v + _masked(F.call_function("shiftright", h, i), _ONES), _FULL)))
        for seed in SEEDS
    ]
    return F.concat(wide, *counters, F.array(F.size(phrases).cast("long")))


def combined(one: Column, other: Column, sign: int = 1) -> Column:
    """The fingerprint of two documents' paragraphs together, or with sign -1 of the first without the second's."""
    n = WIDE + STRIDE * len(SEEDS)
    wide = F.zip_with(F.slice(one, 1, WIDE), F.slice(other, 1, WIDE), lambda a, b: _masked(a + b * sign + F.lit(1 << WIDE_BITS), (1 << WIDE_BITS) - 1))
    rest = F.zip_with(F.slice(one, WIDE + 1, n - WIDE), F.slice(other, WIDE + 1, n - WIDE), lambda a, b: _masked(a + b * sign, _FULL))
    return F.concat(wide, rest, F.array(F.get(one, F.lit(n)) + F.get(other, F.lit(n)) * sign))


def projection(fingerprint: Column) -> Column:
    """The likeness counters as signed sums, one for each hash bit; sums are modulo 2**20, between -2**19 and 2**19."""
    n = STRIDE * len(SEEDS)
    count = F.get(fingerprint, F.lit(WIDE + n))
    packed = F.slice(fingerprint, WIDE + 1, n)
    lane = lambda v, i: _masked(F.shiftright(v, STRIDE * i) * 2 - count + F.lit(1 << (STRIDE - 1)), (1 << STRIDE) - 1) - F.lit(1 << (STRIDE - 1))
    return F.flatten(F.transform(packed, lambda v: F.array(*[lane(v, i).cast("double") for i in range(PACKED)])))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the estimated cosine, at least 0; with and without phrases 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    # each vector once in a struct, so that its lanes are not computed again for every product
    pair = F.transform(F.array(F.struct(projection(one).alias("a"), projection(other).alias("b"))), lambda p: F.struct(dot(p["a"], p["b"]).alias("ab"), dot(p["a"], p["a"]).alias("aa"), dot(p["b"], p["b"]).alias("bb")))
    cosine = F.get(F.transform(pair, lambda d: F.when((d["aa"] > 0) & (d["bb"] > 0), d["ab"] / F.sqrt(d["aa"] * d["bb"])).otherwise(F.lit(0.0))), F.lit(0))
    return F.when(one == other, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def as_string(fingerprint: Column) -> Column:
    """Fixed-width lower-case hex of all lanes: 8 digits for a wide lane, 15 for three counters, 8 for the count."""
    n = STRIDE * len(SEEDS)
    wide = F.transform(F.slice(fingerprint, 1, WIDE), lambda v: F.lpad(F.hex(v), 8, "0"))
    rest = F.transform(F.slice(fingerprint, WIDE + 1, n), lambda v: F.lpad(F.hex(v), 15, "0"))
    return F.lower(F.array_join(F.concat(wide, rest, F.array(F.lpad(F.hex(F.get(fingerprint, F.lit(WIDE + n))), 8, "0"))), ""))


def with_next(docs: DataFrame, ident: str, columns: list[str], seed: int = 23) -> DataFrame:
    """docs with next_<column> for each of columns: those of the row that follows by ident, the first row following the last.

    Ties in ident are ordered by a hash of the first of columns, then by it; null ids come last, and a single row follows
    itself. Rows go to buckets of neighbours whose bounds are rows of a sample, and rows equal to a bound also go to the
    bucket before it, so one shuffle brings each row and its successor together. Ids that repeat are cut by the hash; only
    rows that are equal in id and text stay together.
    """
    keys = [F.col(ident).isNull().cast("long").alias("k1"), F.coalesce(F.col(ident), F.lit(0)).cast("long").alias("k2"), F.xxhash64(columns[0]).alias("k3")]
    placed = docs.select(*keys)
    n, least = placed.agg(F.count("*"), F.min(F.struct("k1", "k2", "k3"))).first()
    parts = max(1, min(MAX_BUCKETS, n // ROWS_PER_BUCKET))
    chance = parts * OVERSAMPLE / max(n, 1)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "k3"), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30)))
    sample = sorted(tuple(r) for r in placed.where(drawn).distinct().collect()) if parts > 1 else []  # about OVERSAMPLE rows a bucket
    bounds = sorted({tuple(least), *(sample[len(sample) * i // parts] for i in range(1, parts) if sample)}) if n else []
    k = [F.col(c) for c in ("_k1", "_k2", "_k3")]
    rows = docs.withColumns({f"_k{i + 1}": c for i, c in enumerate(keys)}).withColumn("_b", range_of(bounds, *k) if bounds else F.lit(1))
    # the first bound is the least row, so all rows are in bucket 1 or later
    last = max(1, len(bounds))
    at = lambda i: F.get(F.array(*[F.lit(b[i]).cast("long") for b in bounds]), F.col("_b") - 1)
    at_bound = (k[0] == at(0)) & (k[1] == at(1)) & (k[2] == at(2)) if bounds else F.lit(True)
    before = F.when(F.col("_b") == 1, F.lit(last)).otherwise(F.col("_b") - 1)
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy"))
    rows = rows.withColumn("_to", F.explode(F.when(at_bound, F.array(own, F.struct(before.alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(own))))
    rows = rows.select(*docs.columns, *k, F.col("_to.b").alias("_b"), F.col("_to.copy").alias("_copy"))
    order = Window.partitionBy("_b").orderBy("_copy", *k, columns[0])
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("_copy")).drop("_b", "_copy", "_k1", "_k2", "_k3")


def op7_fingerprint(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Null texts are empty; an empty text has the all-zero fingerprint, which is 1 alike to itself and 0 to any other with
    phrases. Repeated rows are rows of their own, ordered by a hash of the text where ids tie; null ids come last. Further
    columns are ignored. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    plain = plain.withColumn("own", vector(F.col("text")))
    pairs = with_next(plain, "doc_id", ["text", "own"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    made = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    # a generator keeps Catalyst from computing the vector once for each use
    changed = F.explode(F.array(vector(F.col("edited"))))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", changed.alias("changed"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
