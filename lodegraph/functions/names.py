"""Scalar functions on names, versions and word sets, all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_key(name: Column) -> Column:
    """Lower case, trimmed, white space collapsed, curly quotes and long dashes as plain ones."""
    return F.translate(F.trim(F.regexp_replace(F.lower(name), "[ \\t\\n\\r]+", " ")), "\u2018\u2019\u201c\u201d\u2013\u2014", "''\"\"--")


def bare_name(name: Column) -> Column:
    """entity_key without a leading article and without characters other than letters, digits, _ and spaces."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(entity_key(name), "^(the|a|an) ", ""), "[^a-z0-9_ ]", ""))
    # most names have nothing to take away, which one test tells sooner than three replacements do
    return F.when(F.lower(name).rlike("\\A(?!(?:the|a|an) )[a-z0-9_]+(?: [a-z0-9_]+)*\\z"), F.lower(name)).otherwise(bare)


# fixed values: what relations are called beside their names
SYNONYMS = {
    "MANAGES": "manages supervises oversees leads directs", "REPORTS_TO": "reports_to reports works_for", "PERFORMS": "performs executes does completes", "USES": "uses utilizes employs",
    "REQUIRES": "requires needs depends_on", "CONTAINS": "contains includes has", "PART_OF": "part_of belongs_to member_of", "FOLLOWED_BY": "followed_by after", "PRECEDES": "precedes before",
    "TRIGGERS": "triggers causes initiates", "PRODUCES": "produces creates generates outputs", "INPUTS": "inputs receives consumes",
}


def relation_type(kind: Column) -> Column:
    """The relation that a text names by itself or by a synonym; others in upper case with white space as _; null is RELATED_TO."""
    key = F.regexp_replace(F.lower(F.trim(kind)), "[ \\t\\n\\r-]+", "_")
    known = [F.when(key.isin(*names.split()), F.lit(relation)) for relation, names in SYNONYMS.items()]
    return F.coalesce(*known, F.regexp_replace(F.upper(F.trim(kind)), "[ \\t\\n\\r-]+", "_"), F.lit("RELATED_TO"))


def title_name(name: Column) -> Column:
    """Without a leading article, white space collapsed, every word with a capital."""
    return F.initcap(F.regexp_replace(F.trim(F.regexp_replace(name, "[ \\t\\n\\r]+", " ")), "(?i)^(the|a|an) ", ""))


def search_key(text: Column) -> Column:
    """A key for a search index: lower case, white space as _, only a-z 0-9 _ - =, no _ twice or at an end, 100 characters at most."""
    key = F.regexp_replace(F.regexp_replace(F.lower(text), "\\s+", "_"), "[^a-z0-9_=-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(key, "_+", "_"), "^_+|_+$", ""), 1, 100)


def pair_key(one: Column, other: Column) -> Column:
    """One key for a pair in either order."""
    return F.concat_ws("|", F.least(one, other), F.greatest(one, other))


def json_payload(text: Column) -> Column:
    """The JSON in a text, without a code fence around it."""
    return F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1), F.lit("")), text), "^\\s+|\\s+$", "")


def percent_change(before: Column, now: Column) -> Column:
    """A change as text with a sign and one decimal; n/a from nothing."""
    change = (now - before) / F.abs(before) * 100
    return F.when(F.coalesce(before, F.lit(0.0)) == 0, "n/a").otherwise(F.concat(F.when(change > 0, "+").otherwise(""), F.format_number(change, 1), F.lit("%")))


def similarity(one: Column, other: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty names."""
    longer = F.greatest(F.length(one), F.length(other))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(one, other) / longer)


_SEMVER = "^(\\d+)\\.(\\d+)\\.(\\d+)(?:-([0-9A-Za-z-]+(?:\\.[0-9A-Za-z-]+)*))?(?:\\+([0-9A-Za-z-]+(?:\\.[0-9A-Za-z-]+)*))?$"


def semver(version: Column) -> Column:
    """struct(major, minor, patch, pre, build, valid); zeros and empty texts where the text isn't major.minor.patch[-pre][+build]."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(version, _SEMVER, i), F.lit("")).cast("int"), F.lit(0))
    text = lambda i: F.coalesce(F.regexp_extract(version, _SEMVER, i), F.lit(""))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), text(4).alias("pre"), text(5).alias("build"), F.coalesce(version.rlike(_SEMVER), F.lit(False)).alias("valid"))


def compare_versions(one: Column, other: Column) -> Column:
    """-1, 0 or 1: numbers first, a release after its pre-releases, those by their parts, numbers before words, builds ignored."""
    a, b = semver(one), semver(other)
    numbers = lambda v: F.struct(v["major"], v["minor"], v["patch"])
    number = lambda x: F.nullif(F.regexp_extract(x, "^\\d+", 0), F.lit("")).cast("int")
    sign = lambda x, y: F.when(x > y, 1).when(x < y, -1).otherwise(0)

    def part(x: Column, y: Column) -> Column:
        n, m = number(x), number(y)
        both = F.when(n.isNotNull() & m.isNotNull(), sign(n, m)).when(n.isNotNull(), -1).when(m.isNotNull(), 1).otherwise(sign(x, y))
        return F.when(x.isNull(), -1).when(y.isNull(), 1).otherwise(both)

    parts = F.zip_with(F.split(a["pre"], "\\."), F.split(b["pre"], "\\."), part)
    pre = F.when((a["pre"] == "") & (b["pre"] == ""), 0).when(b["pre"] == "", -1).when(a["pre"] == "", 1).otherwise(F.coalesce(F.get(F.filter(parts, lambda p: p != 0), F.lit(0)), F.lit(0)))
    return F.when(numbers(a) != numbers(b), sign(numbers(a), numbers(b))).otherwise(pre)


def compatible(version: Column, required: Column) -> Column:
    """Whether a version may stand in for a required one: valid both, the same major (and minor, below 1.0), and not older."""
    v, r = semver(version), semver(required)
    return v["valid"] & r["valid"] & (v["major"] == r["major"]) & ((r["major"] > 0) | (v["minor"] == r["minor"])) & (compare_versions(version, required) >= 0)


def words(text: Column) -> Column:
    """Lower-cased words between spaces; null has none."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\r]+", " "), " "), lambda w: w != F.lit(""))


def ngrams(of: Column, n: int = 3) -> Column:
    """Distinct runs of n words; none if there are fewer."""
    return F.when(F.size(of) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(of) - n), lambda i: F.concat_ws(" ", *[F.get(of, i + j) for j in range(n)])))).otherwise(F.array().cast("array<string>"))


def jaccard(one: Column, other: Column) -> Column:
    """Intersection over union of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(one, other))
    return F.when(union > 0, F.size(F.array_intersect(one, other)) / union).otherwise(F.lit(0.0))
