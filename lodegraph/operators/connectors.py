"""Listings of files and pages: paths, filters, permissions, sections and tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: media types by extension
MEDIA = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html",
    "json": "application/json", "csv": "text/csv", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of a file's name, in lower case; empty for none."""
    return F.lower(F.regexp_extract(file_name(path), "\\.([^.]+)$", 1))


def media_type(path: Column) -> Column:
    own = extension(path)
    return F.coalesce(*[F.when(own == e, F.lit(m)) for e, m in MEDIA.items()], F.lit("application/octet-stream"))


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path begins with a pattern, or matches one that has * for anything."""
    tests = F.lit(False)
    for p in patterns:
        tests = tests | (path.rlike("^" + ".*".join(re.escape(x) for x in p.split("*")) + "$") if "*" in p else path.startswith(p))
    return tests


def included(path: Column, extensions: tuple[str, ...] = (), without: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> Column:
    """Whether a file is to be taken: its extension is listed (if any are), no excluded folder is in its path, and some included one (if any are)."""
    ok = extension(path).isin([e.lower().lstrip(".") for e in extensions]) if extensions else F.lit(True)
    for folder in without:
        ok = ok & ~F.lower(path).contains(folder.lower())
    if within:
        some = F.lit(False)
        for folder in within:
            some = some | F.lower(path).contains(folder.lower())
        ok = ok & some
    return ok


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (), most_bytes: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, extension, media, bytes, modified) of the files below a folder, whose contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    path = F.col("path")
    kept = files.where(included(path, extensions, without))
    kept = kept if most_bytes is None else kept.where(F.col("length") <= most_bytes)
    return kept.select("path", file_name(path).alias("name"), extension(path).alias("extension"), media_type(path).alias("media"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def acl_entries(acl: Column) -> Column:
    """Entries of a POSIX ACL text as array of struct(scope, kind, who, read, write, execute); malformed ones are left out."""
    parts = F.transform(F.split(F.coalesce(acl, F.lit("")), ","), lambda e: F.struct(e.startswith("default:").alias("d"), F.split(F.regexp_replace(F.trim(e), "^default:", ""), ":").alias("p")))
    right = lambda p, i, c: F.substring(F.get(p, F.lit(2)), i, 1) == c
    made = F.transform(F.filter(parts, lambda x: F.size(x["p"]) >= 3), lambda x: F.struct(
        F.when(x["d"], "default").otherwise("access").alias("scope"), F.get(x["p"], F.lit(0)).alias("kind"), F.get(x["p"], F.lit(1)).alias("who"),
        right(x["p"], 1, "r").alias("read"), right(x["p"], 2, "w").alias("write"), right(x["p"], 3, "x").alias("execute")))
    return made


def allowed_groups(acl: Column, owner: Column, group: Column) -> Column:
    """Who may read by an ACL: public for others, user: and group: names, owner and owning group for unnamed entries; masks don't count."""
    reads = F.filter(acl_entries(acl), lambda e: e["read"] & (e["scope"] == "access") & (e["kind"] != "mask"))
    name = lambda e: F.when(e["kind"] == "other", F.lit("public")).when(e["who"] != "", F.concat(e["kind"], F.lit(":"), e["who"])).when(e["kind"] == "user", F.concat(F.lit("user:"), owner)).when(e["kind"] == "group", F.concat(F.lit("group:"), group))
    return F.array_sort(F.array_distinct(F.filter(F.transform(reads, name), lambda x: x.isNotNull())))


def acl_stats(rows: DataFrame, acl: str, groups: str) -> DataFrame:
    """One row: rows with and without an ACL, distinct groups, and rows that are public."""
    return rows.agg(F.count_if(F.col(acl).isNotNull()).alias("with_acl"), F.count_if(F.col(acl).isNull()).alias("without"), F.count_if(F.array_contains(groups, "public")).alias("public")).join(
        rows.select(F.explode(groups).alias("g")).agg(F.countDistinct("g").alias("groups")))


def permission_groups(permissions: Column, inherited: bool = True, roles: tuple[str, ...] = ()) -> Column:
    """Who shared permissions (array of struct(inherited, roles, user, group, scope)) let in: groups, user: mails, organization and anonymous links."""
    kept = F.filter(permissions, lambda p: (F.lit(inherited) | ~F.coalesce(p["inherited"], F.lit(False))) & (F.arrays_overlap(p["roles"], F.array(*[F.lit(r) for r in roles])) if roles else F.lit(True)))
    each = F.flatten(F.transform(kept, lambda p: F.array(p["group"], F.when(p["user"].isNotNull(), F.concat(F.lit("user:"), p["user"])), F.when(p["scope"].isin("organization", "anonymous"), p["scope"]))))
    return F.array_sort(F.array_distinct(F.filter(each, lambda x: x.isNotNull())))


def sections(blocks: DataFrame, ident: str, place: str, heading: Column, text: Column) -> DataFrame:
    """(ident, section, title, body): blocks of a document under the heading before them; what comes first is the Introduction."""
    w = Window.partitionBy(ident).orderBy(place)
    rows = blocks.select(ident, place, heading.alias("_h"), text.alias("_t")).withColumn("section", F.sum(F.col("_h").cast("int")).over(w))
    title = F.coalesce(F.max(F.when(F.col("_h"), F.col("_t"))), F.lit("Introduction"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct(place, "_t")))), lambda b: b["_t"]), "\n")
    return rows.groupBy(ident, "section").agg(title.alias("title"), body.alias("body"))


def table_text(cells: DataFrame, ident: str) -> DataFrame:
    """(ident, markdown): cells (ident, row, column, content) as a table, a line for each row and one under the first."""
    lines = cells.groupBy(ident, "row").agg(F.array_sort(F.collect_list(F.struct("column", "content"))).alias("c"))
    lines = lines.select(ident, "row", F.size("c").alias("n"), F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: F.coalesce(x["content"], F.lit(""))), " | "), F.lit(" |")).alias("line"))
    every = lines.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("row", "line", "n"))).alias("l"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.get("l", F.lit(0))["n"]))
    text = F.transform(F.col("l"), lambda x, i: F.when(i == 0, F.concat(x["line"], F.lit("\n"), rule)).otherwise(x["line"]))
    return every.select(ident, F.array_join(text, "\n").alias("markdown"))


def mentions(chunks: DataFrame, entities: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, name, mentions): how often each entity's name (name, one word) stands in a document's chunks as a word, case aside.

    Words are counted inside a chunk's row and joined with the names, so nothing is compared all with all.
    """
    words = chunks.select(doc, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))).alias("_w")).groupBy(doc, "_w").agg(F.count("*").alias("n"))
    return words.join(entities.select("name", F.lower("name").alias("_w")).distinct(), "_w").groupBy(doc, "name").agg(F.sum("n").alias("mentions"))
