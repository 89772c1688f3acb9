"""Names that are alike: within an edit distance, by segments that must be equal, and by containment, by rare n-grams.

Neither compares all names with all names: two strings within k edits agree in one of k + 1 segments of the one, near
its place in the other; a string that contains another holds its rarest n-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.sources.tables import written

#: Letters of the n-grams by which containment is searched; shorter names are their own n-gram.
GRAM = 3


def normalized(name: Column) -> Column:
    """name without a leading article, single spaces, each word with a capital and small letters after it."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, "(?i)^(the|a|an)\\s+", ""), "\\s+", " "))
    return F.array_join(F.transform(F.split(bare, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")


def _segments(text: Column, edits: int) -> Column:
    """The edits + 1 segments of a string as (length, number, segment); the last ones are longer by one where they differ."""
    n = F.length(text)
    size = F.floor(n / (edits + 1)).cast("int")
    longer = n % (edits + 1)
    out = []
    for j in range(edits + 1):
        shift = F.greatest(F.lit(0), longer - (edits + 1 - j))  # longer segments before this one
        width = size + F.when(F.lit(j) >= F.lit(edits + 1) - longer, 1).otherwise(0)
        out.append(F.struct(n.alias("n"), F.lit(j).alias("j"), F.substring(text, size * j + shift + 1, width).alias("segment")))
    return F.array(*out)


def _probes(text: Column, edits: int) -> Column:
    """The substrings of a string that may equal segment j of a string of n letters within the distance, as (n, j, segment).

    Segment j begins at p. As few as j edits stand before it where it is the first that is equal, and as few as the
    rest after it where it is the last, so its place in the other string lies within both of those shifts.
    """
    lengths = F.sequence(F.greatest(F.lit(1), F.length(text) - edits), F.length(text) + edits)

    def of_length(n: Column) -> Column:
        size, longer, delta = F.floor(n / (edits + 1)).cast("int"), n % (edits + 1), F.length(text) - n

        def of_segment(j: int) -> Column:
            p = size * j + F.greatest(F.lit(0), longer - (edits + 1 - j))
            width = size + F.when(F.lit(j) >= F.lit(edits + 1) - longer, 1).otherwise(0)
            low = F.greatest(F.lit(0), p - j, p + delta - (edits - j))
            high = F.least(F.length(text) - width, p + j, p + delta + (edits - j))
            starts = F.when((high >= low) & (width > 0), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda s: F.struct(n.alias("n"), F.lit(j).alias("j"), F.substring(text, s + 1, width).alias("segment")))

        return F.concat(*[of_segment(j) for j in range(edits + 1)])

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def near_names(names: DataFrame, known: DataFrame, edits: int = 3) -> DataFrame:
    """(name, match, distance): every distinct name of known within an edit distance of each distinct one of names, case aside.

    A name is no match of itself in the same spelling. Names of at most edits letters have empty segments, so they
    are joined by the pair of lengths instead: all of them are within that distance of each other. Null names are left out.
    """
    left = written(names.where("name IS NOT NULL").select("name", F.lower("name").alias("a")).distinct())
    right = written(known.where("name IS NOT NULL").select(F.col("name").alias("match"), F.lower("name").alias("b")).distinct())
    keys = ["n", "j", "segment"]
    segments = right.where(F.length("b") > edits).select("b", F.explode(_segments(F.col("b"), edits)).alias("s")).select("b", "s.*").distinct()
    probes = left.where(F.length("a") > 0).select("a", F.explode(_probes(F.col("a"), edits)).alias("s")).select("a", "s.*").distinct()
    found = probes.join(segments, keys).select("a", "b").distinct()
    lengths = lambda c, most: F.explode(F.sequence(F.greatest(F.lit(0), F.length(c) - edits), F.least(F.lit(most), F.length(c) + edits)))
    short = right.where(F.length("b") <= edits).select("b", F.length("b").alias("n")).distinct()
    asked = left.where(F.length("a") <= 2 * edits).select("a", lengths("a", edits).alias("n")).distinct()
    pairs = found.unionByName(asked.join(short, "n").select("a", "b").distinct())
    near = pairs.withColumn("distance", F.levenshtein("a", "b", edits)).where("distance >= 0")
    return near.join(left, "a").join(right, "b").where("name <> match").select("name", "match", "distance")


def nearest_names(names: DataFrame, known: DataFrame, edits: int = 3, most: int = 3) -> DataFrame:
    """(name, match, distance, place): the nearest matches of each name, ties by the match."""
    w = Window.partitionBy("name").orderBy("distance", "match")
    return near_names(names, known, edits).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(name, part): every distinct name with each distinct part that it contains, case aside; equal ones as well.

    A part is looked up by its n-gram that fewest names hold, which is the only key it is sent to; names are sent to
    those n-grams alone that some part is looked up by. Parts of one or two letters are n-grams themselves. Empty and
    null ones are left out.
    """
    whole = written(names.where("name IS NOT NULL").select(F.lower("name").alias("a")).where("a <> ''").distinct())
    own = written(parts.where("name IS NOT NULL").select(F.lower("name").alias("b")).where("b <> ''").distinct())
    size = F.least(F.length("b"), F.lit(GRAM))
    grams = None
    for n in range(1, GRAM + 1):
        made = whole.where(F.length("a") >= n).select("a", F.explode(_grams(F.col("a"), n)).alias("gram"))
        grams = made if grams is None else grams.unionByName(made)
    wanted = written(own.select("b", F.explode(F.transform(F.sequence(F.lit(1), F.length("b") - size + 1), lambda i: F.substring("b", i, size))).alias("gram")).distinct())
    held = grams.join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rare = written(wanted.join(counts, "gram", "left").groupBy("b").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("b", F.col("r.gram").alias("gram")))
    found = held.join(rare, "gram").where(F.col("a").contains(F.col("b"))).select("a", "b").distinct()
    spelt = lambda frame, key, out: frame.where("name IS NOT NULL").select(F.lower("name").alias(key), F.col("name").alias(out)).distinct()
    return found.join(spelt(names, "a", "name"), "a").join(spelt(parts, "b", "part"), "b").select("name", "part")


def resolved_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, resolved, how): the known name that each name stands for, or else its normal form.

    In this order: the same spelling, the normal form's spelling, the normal form case aside (the least such), and else
    the normal form itself, with how = contained where it contains a known name or one contains it, new otherwise.
    """
    asked = written(names.where("name IS NOT NULL").select("name").distinct().withColumn("normal", normalized(F.col("name"))))
    have = known.where("name IS NOT NULL").select("name").distinct()
    lower = have.groupBy(F.lower("name").alias("_low")).agg(F.min("name").alias("_other"))
    exact = have.select(F.col("name").alias("name"), F.lit(True).alias("_exact"))
    formed = have.select(F.col("name").alias("normal"), F.lit(True).alias("_formed"))
    found = asked.join(exact, "name", "left").join(formed, "normal", "left").join(lower, F.lower("normal") == F.col("_low"), "left")
    normals = asked.select(F.col("normal").alias("name"))
    touched = containing(normals, have).select(F.col("name").alias("normal")).union(containing(have, normals).select(F.col("part").alias("normal"))).distinct().withColumn("_touched", F.lit(True))
    found = found.join(touched, "normal", "left")
    how = F.when(F.col("_exact"), "exact").when(F.col("_formed"), "normal").when(F.col("_other").isNotNull(), "case").when(F.col("_touched"), "contained").otherwise("new")
    to = F.when(F.col("_exact"), F.col("name")).when(F.col("_formed"), F.col("normal")).otherwise(F.coalesce("_other", "normal"))
    return found.select("name", to.alias("resolved"), how.alias("how"))


def merged_entities(new: DataFrame, known: DataFrame) -> DataFrame:
    """(name, confidence, description, merged): known entities with the new ones of the same name, case aside, and the others added.

    Confidence is the greatest. Descriptions that differ from the known one follow it in order of place, joined by
    "; "; each once. new has place, which orders it; the first spelling of a name stays.
    """
    every = known.select("name", "confidence", "description", F.lit(-1).cast("long").alias("place")).unionByName(new.select("name", "confidence", "description", F.col("place").cast("long")))
    first = F.min(F.struct("place", "name"))
    told = F.array_sort(F.collect_list(F.when(F.col("description").isNotNull() & (F.col("description") != ""), F.struct("place", "description"))))
    grouped = every.groupBy(F.lower("name").alias("_key")).agg(first.alias("f"), F.max("confidence").alias("confidence"), told.alias("d"), (F.count("*") > 1).alias("merged"))
    return grouped.select(F.col("f.name").alias("name"), "confidence", F.array_join(F.array_distinct(F.transform("d", lambda x: x.description)), "; ").alias("description"), "merged")
