"""What a model is given for a query: entities, relations, passages and communities of its part of the graph, as sections of one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.ranking import best_of

# fixed values: lines of a section at most, the titles, and the importance from which an entity is told apart
MOST_ENTITIES, MOST_RELATIONS, MOST_COMMUNITIES = 10, 30, 3
TITLES = ("Relevant Entities", "Relationships", "Source Documents", "Knowledge Community Insights")
KEY, IMPORTANT = 0.7, 0.5


def entity_lines(entities: DataFrame, most: int = MOST_ENTITIES) -> DataFrame:
    """(query, place, line) of entities (query, name, type, description, importance): the most important first, ties by name.

    A missing importance is 0; parts that are missing or empty are left out of a line.
    """
    value = F.coalesce("importance", F.lit(0.0))
    best = best_of(entities.withColumn("importance", value), ["query"], most, [F.desc("importance"), F.col("name")], F.col("name"))
    mark = F.when(F.col("importance") > KEY, "[Key Entity]").when(F.col("importance") > IMPORTANT, "[Important]")
    kind, told = F.when(F.length("type") > 0, F.concat(F.lit("("), "type", F.lit(")"))), F.when(F.length("description") > 0, F.concat(F.lit(": "), "description"))
    return best.select("query", "place", F.concat_ws(" ", F.concat(F.lit("**"), "name", F.lit("**")), kind, mark, told).alias("line"))


def relation_lines(relations: DataFrame, most: int = MOST_RELATIONS) -> DataFrame:
    """(query, place, line) of relations (query, place, src, type, dst): the first by place."""
    best = best_of(relations.withColumnRenamed("place", "_at"), ["query"], most, [F.col("_at"), F.col("src"), F.col("dst"), F.col("type")], F.struct("src", "dst", "type"))
    return best.select("query", "place", F.concat(F.lit("- "), "src", F.lit(" --["), "type", F.lit("]--> "), "dst").alias("line"))


def passage_lines(passages: DataFrame) -> DataFrame:
    """(query, place, line) of passages (query, place, source, page, content), which keep their places; a missing source is Unknown."""
    page = F.when(F.col("page") > 0, F.concat(F.lit(" (Page "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("### Source "), F.col("place").cast("string"), F.lit(": "), F.coalesce("source", F.lit("Unknown")), page)
    return passages.select("query", "place", F.concat(head, F.lit("\n"), F.coalesce("content", F.lit(""))).alias("line"))


def community_lines(communities: DataFrame, keys: DataFrame, entities: DataFrame, most: int = MOST_COMMUNITIES) -> DataFrame:
    """(query, place, line) of communities (community, title, size, summary) whose key entities a query has, most of them first.

    keys: (community, name). Relevance is the share of a community's key entities among the query's entities (query,
    name), case aside; ties go by community. Communities without any are left out.
    """
    own = keys.select("community", F.lower("name").alias("_name")).distinct()
    size = own.groupBy("community").agg(F.count("*").alias("_keys"))
    asked = entities.select("query", F.lower("name").alias("_name")).distinct()
    share = asked.join(own, "_name").groupBy("query", "community").agg(F.count("*").alias("_hit")).join(size, "community")
    scored = share.select("query", "community", (F.col("_hit") / F.col("_keys")).alias("relevance"))
    best = best_of(scored, ["query"], most, [F.desc("relevance"), F.col("community")], F.col("community"))
    count = F.coalesce(F.col("size").cast("string"), F.lit("N/A"))
    line = F.concat(F.lit("### "), F.coalesce("title", F.lit("Knowledge Community")), F.lit(" ("), count, F.lit(" entities)\n"), F.coalesce("summary", F.lit("")))
    return best.join(communities, "community").select("query", "place", line.alias("line"))


def assembled(sections: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(query, context): sections (title, lines, what joins them) in order, those without lines left out.

    Lines (query, place, line) are few for each query, as the functions above keep them.
    """
    every = None
    for i, (title, lines, joint) in enumerate(sections):
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x.line), joint)
        own = lines.groupBy("query").agg(F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"## {title}\n"), text).alias("t")).alias("s"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.t), "\n\n").alias("context"))


def graph_context(entities: DataFrame, relations: DataFrame, passages: DataFrame, communities: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(query, context) of all four sections; without communities, of three."""
    sections = [(TITLES[0], entity_lines(entities), "\n"), (TITLES[1], relation_lines(relations), "\n"), (TITLES[2], passage_lines(passages), "\n\n")]
    if communities is not None and keys is not None:
        sections.append((TITLES[3], community_lines(communities, keys, entities), "\n\n"))
    return assembled(sections)
