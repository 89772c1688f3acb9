"""Types and relations of an ontology as small tables: closure, suggestions, constraints on edges, replacement chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.fuzzy import near_names
from lodegraph.sources.tables import written

# fixed values: classes and the class above each
PARENTS = {
    "BusinessFlowEntity": "Entity", "OrganizationalEntity": "Entity", "TechnicalEntity": "Entity", "ArtifactEntity": "Entity", "GovernanceEntity": "Entity", "MeasurementEntity": "Entity",
    "Process": "BusinessFlowEntity", "Task": "BusinessFlowEntity", "Activity": "BusinessFlowEntity", "Decision": "BusinessFlowEntity",
    "Role": "OrganizationalEntity", "Department": "OrganizationalEntity", "Stakeholder": "OrganizationalEntity",
    "System": "TechnicalEntity", "Application": "TechnicalEntity", "Database": "TechnicalEntity",
    "Document": "ArtifactEntity", "Form": "ArtifactEntity", "Template": "ArtifactEntity",
    "Policy": "GovernanceEntity", "Regulation": "GovernanceEntity", "Standard": "GovernanceEntity",
    "Metric": "MeasurementEntity", "KPI": "MeasurementEntity",
}
# fixed values: relations, the classes that they lead from and to
RELATIONS = {
    "PRECEDES": ("BusinessFlowEntity", "BusinessFlowEntity"), "FOLLOWS": ("BusinessFlowEntity", "BusinessFlowEntity"), "FOLLOWED_BY": ("BusinessFlowEntity", "BusinessFlowEntity"),
    "TRIGGERS": ("Entity", "BusinessFlowEntity"), "OWNS": ("OrganizationalEntity", "Entity"), "EXECUTES": ("OrganizationalEntity", "BusinessFlowEntity"),
    "APPROVES": ("OrganizationalEntity", "Entity"), "REVIEWS": ("OrganizationalEntity", "Entity"), "REPORTS_TO": ("OrganizationalEntity", "OrganizationalEntity"),
    "MANAGES": ("OrganizationalEntity", "Entity"), "PERFORMS": ("OrganizationalEntity", "BusinessFlowEntity"), "USES": ("Entity", "TechnicalEntity"),
    "INTEGRATES_WITH": ("TechnicalEntity", "TechnicalEntity"), "INPUTS": ("Entity", "Entity"), "PRODUCES": ("Entity", "Entity"), "DEPENDS_ON": ("Entity", "Entity"),
    "REQUIRES": ("Entity", "Entity"), "CONTAINS": ("Entity", "Entity"), "PART_OF": ("Entity", "Entity"), "GOVERNS": ("GovernanceEntity", "Entity"),
    "REGULATES": ("Regulation", "Entity"), "MEASURES": ("MeasurementEntity", "Entity"), "TRACKS": ("Entity", "MeasurementEntity"), "SAME_AS": ("Entity", "Entity"), "SIMILAR_TO": ("Entity", "Entity"),
}
# fixed values: what a violation leaves of an edge's confidence
PENALTIES = {"DOMAIN_VIOLATION": 0.85, "RANGE_VIOLATION": 0.85, "UNKNOWN_RELATIONSHIP_TYPE": 0.7, "UNKNOWN_ENTITY_TYPE": 0.9}
#: Generations that a chain or a tree may have.
MOST_DEPTH = 50


def classes(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    """(type, parent): the ontology's classes and those that a user adds."""
    return spark.createDataFrame(list((PARENTS | (more or {})).items()), "type string, parent string")


def relations(spark: SparkSession, more: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(relation, domain, range), with those that a user adds."""
    return spark.createDataFrame([(k, *v) for k, v in (RELATIONS | (more or {})).items()], "relation string, domain string, range string")


def closure(parents: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(type, ancestor, depth): every type with itself at depth 0 and all above it; a cycle ends where it closes."""
    known = parents.select("type").union(parents.select("parent")).distinct()
    level = found = known.select("type", F.col("type").alias("ancestor"), F.lit(0).alias("depth"))
    up = parents.select(F.col("type").alias("ancestor"), "parent")
    for d in range(1, depth + 1):
        level = level.join(up, "ancestor").select("type", F.col("parent").alias("ancestor"), F.lit(d).alias("depth"))
        level = level.join(found, ["type", "ancestor"], "left_anti")
        if not level.take(1):
            break
        found = found.unionByName(level)
    return found


def subtypes(closed: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(root, type, depth, leaf): every class with itself and all below it, by how far, and whether a class has none below.

    closed is what closure gives; of (type) names the roots wanted, all by default. A class on a cycle is no leaf.
    """
    below = closed.where("depth = 1").select(F.col("ancestor").alias("type")).distinct().withColumn("_inner", F.lit(True))
    rows = closed.select(F.col("ancestor").alias("root"), "type", "depth")
    rows = rows if of is None else rows.join(of.select(F.col("type").alias("root")).distinct(), "root", "left_semi")
    return rows.join(below, "type", "left").select("root", "type", "depth", F.col("_inner").isNull().alias("leaf"))


def tree(parents: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(type, tree): the classes without a parent, and all below each as nested text, type(child, child(...)), children by name.

    Built from the leaves up, a level a round: a class takes its children's text once each of them has one. Classes on
    a cycle get none.
    """
    links = written(parents.select("type", "parent").distinct())
    every = links.select("type").union(links.select("parent")).distinct()
    counts = links.groupBy(F.col("parent").alias("type")).agg(F.count("*").alias("n"))
    told = written(every.join(counts, "type", "left_anti").select("type", F.col("type").alias("tree")))
    for _ in range(depth):
        up = links.join(told, "type").groupBy(F.col("parent").alias("type")).agg(F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "tree"))), lambda x: x.tree), ", ").alias("inner"))
        fresh = up.join(counts, "type").where("k = n").join(told.select("type"), "type", "left_anti").select("type", F.concat("type", F.lit("("), "inner", F.lit(")")).alias("tree"))
        fresh = written(fresh)
        if not fresh.take(1):
            break
        told = told.unionByName(fresh)
    return told.join(links.select("type").distinct(), "type", "left_anti")


def ends_of(relation_table: DataFrame, inverses: DataFrame | None = None) -> DataFrame:
    """(relation, domain, range, inverse): the look-up of what relations lead from and to, with the inverse where one is known (relation, inverse)."""
    rows = relation_table.select("relation", "domain", "range")
    return rows.withColumn("inverse", F.lit(None).cast("string")) if inverses is None else rows.join(inverses.select("relation", "inverse"), "relation", "left")


def suggestions(names: DataFrame, known: DataFrame, distance: int = 3) -> DataFrame:
    """(name, suggestion, distance): known types within an edit distance of each unknown name, nearest first in place."""
    near = near_names(names, known.select(F.col("type").alias("name")), distance)
    same = names.select("name").distinct().join(known.select(F.col("type").alias("name")).distinct(), "name")  # a known name suggests itself
    return near.select("name", F.col("match").alias("suggestion"), "distance").unionByName(same.select("name", F.col("name").alias("suggestion"), F.lit(0).alias("distance")))


def validated(edges: DataFrame, types: DataFrame, relation_table: DataFrame, closed: DataFrame) -> DataFrame:
    """edges (src, dst, type, confidence) with warnings (array of codes), valid, and adjusted: confidence after the penalties.

    types: (id, type). A constraint holds where the end's type is the class or below it. The relations and the closure are
    small tables, which Spark broadcasts by their size; types of ends are joined.
    """
    is_a = closed.select(F.col("type"), F.col("ancestor"))
    near = edges.join(types.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src", "left").join(types.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    near = near.join(relation_table, F.col("type") == F.col("relation"), "left")
    for end, bound in (("src", "domain"), ("dst", "range")):
        ok = is_a.select(F.col("type").alias(f"{end}_type"), F.col("ancestor").alias(bound), F.lit(True).alias(f"{end}_ok"))
        known = is_a.select(F.col("type").alias(f"{end}_type"), F.lit(True).alias(f"{end}_known")).distinct()
        near = near.join(ok, [f"{end}_type", bound], "left").join(known, f"{end}_type", "left")
    unknown = F.col("relation").isNull()
    tests = {
        "UNKNOWN_RELATIONSHIP_TYPE": unknown, "DOMAIN_VIOLATION": ~unknown & F.col("src_known").isNotNull() & F.col("src_ok").isNull(), "RANGE_VIOLATION": ~unknown & F.col("dst_known").isNotNull() & F.col("dst_ok").isNull(),
        "UNKNOWN_ENTITY_TYPE": F.col("src_known").isNull() | F.col("dst_known").isNull(),
    }
    warnings = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]), lambda w: w.isNotNull())
    both = tests["DOMAIN_VIOLATION"] & tests["RANGE_VIOLATION"]
    kept: Column = F.lit(1.0)
    for code, test in tests.items():
        left = F.when(both, F.lit(0.7) if code == "DOMAIN_VIOLATION" else F.lit(1.0)).otherwise(F.lit(PENALTIES[code])) if code.endswith("VIOLATION") else F.lit(PENALTIES[code])
        kept = kept * F.when(test, left).otherwise(F.lit(1.0))
    return near.select(*edges.columns, "src_type", "dst_type", warnings.alias("warnings"), (F.size(warnings) == 0).alias("valid"), (F.col("confidence") * kept).alias("adjusted"))


def replacement_chains(replaced: DataFrame, depth: int = 5) -> DataFrame:
    """(type, final, steps, cyclic): replacements of each type (type, replacement) followed at most depth times; a cycle ends its chain."""
    chain = replaced.select("type", F.array("type", "replacement").alias("path"), F.lit(False).alias("cyclic"))
    step = replaced.select(F.col("type").alias("_at"), F.col("replacement").alias("_next"))
    for _ in range(depth - 1):
        chain = chain.join(step, F.element_at("path", -1) == F.col("_at"), "left")
        seen = F.array_contains("path", F.col("_next"))
        grown = F.when(F.col("_next").isNotNull() & ~seen & ~F.col("cyclic"), F.concat("path", F.array("_next"))).otherwise(F.col("path"))
        chain = chain.select("type", grown.alias("path"), (F.col("cyclic") | F.coalesce(seen, F.lit(False))).alias("cyclic"))
    return chain.select("type", F.element_at("path", -1).alias("final"), (F.size("path") - 1).alias("steps"), "cyclic")


def local_name(uri: Column) -> Column:
    """What follows the last #, / or : of a URI."""
    return F.regexp_extract(uri, "([^#/:]*)$", 1)
