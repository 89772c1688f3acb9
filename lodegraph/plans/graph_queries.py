"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import graph as G
from lodegraph.operators.components import connected_components as components
from lodegraph.plans.registry import query
from lodegraph.plans.views import GRAPH, edges, vertices

#: Edge types along which impact spreads.
SPREADS = ["DEPENDS_ON", "REQUIRES", "USES", "INPUTS", "PART_OF"]


@query(f"{GRAPH}, n AS (SELECT unnest([src, dst]) AS id FROM e) SELECT id, count(*) AS degree FROM n GROUP BY id ORDER BY degree DESC, id LIMIT 10")
def degree_topk(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(10)


@query(f"{GRAPH} SELECT type, count(*) AS vertices FROM v GROUP BY type")
def label_counts(spark, sf_dir):
    return vertices(spark, sf_dir).groupBy("type").agg(F.count("*").alias("vertices"))


@query(f"{GRAPH} SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, round(avg(confidence), 6) AS mean_confidence FROM e GROUP BY type")
def graph_stats(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"{GRAPH}, n AS (SELECT src AS id FROM e WHERE type <> 'DEPENDS_ON' UNION SELECT dst FROM e WHERE type <> 'DEPENDS_ON') SELECT id, type FROM v WHERE id NOT IN (SELECT id FROM n)")
def isolated_nodes(spark, sf_dir):
    return G.isolated(vertices(spark, sf_dir), edges(spark, sf_dir).where("type <> 'DEPENDS_ON'")).select("id", "type")


@query(
    f"""{GRAPH}, c AS (SELECT count(*) AS connected FROM v WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)), n AS (SELECT count(*) AS n FROM v), m AS (SELECT count(*) AS e FROM e)
    SELECT n, e, connected, n - connected AS isolated, round(2.0::DOUBLE * e / (n::DOUBLE * (n - 1)), 9) AS density, round(2.0::DOUBLE * e / n, 6) AS avg_degree FROM n, m, c"""
)
def graph_metrics(spark, sf_dir):
    got = G.graph_metrics(vertices(spark, sf_dir), edges(spark, sf_dir))
    return got.withColumns({"density": F.round("density", 9), "avg_degree": F.round("avg_degree", 6)})


@query(f"{GRAPH}, s AS (SELECT id FROM v WHERE type IN ('region', 'nation', 'supplier')) SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def subgraph_edges(spark, sf_dir):
    kept = vertices(spark, sf_dir).where(F.col("type").isin("region", "nation", "supplier")).select("id")
    return G.induced(edges(spark, sf_dir), kept).select("src", "dst", "type")


@query(f"{GRAPH} SELECT dst AS id, 'in' AS way, src AS neighbour, type FROM e UNION SELECT src, 'out', dst, type FROM e")
def neighbors_outin(spark, sf_dir):
    e = edges(spark, sf_dir)
    incoming = e.select(F.col("dst").alias("id"), F.lit("in").alias("way"), F.col("src").alias("neighbour"), "type")
    outgoing = e.select(F.col("src").alias("id"), F.lit("out").alias("way"), F.col("dst").alias("neighbour"), "type")
    return incoming.union(outgoing).distinct()


@query(f"{GRAPH} SELECT src, type, dst, round(max(confidence), 6) AS confidence, count(*) AS copies FROM e GROUP BY src, type, dst")
def edges_dedup_maxconf(spark, sf_dir):
    return G.best_edges(edges(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""{GRAPH}, l AS (SELECT DISTINCT src, dst FROM e WHERE type = 'PART_OF'), r(seed, id, hops) AS (
    SELECT id, id, 0 FROM v WHERE type = 'region' UNION ALL SELECT r.seed, l.src, r.hops + 1 FROM r JOIN l ON l.dst = r.id WHERE r.hops < 2)
    SELECT seed, id, min(hops) AS hops FROM r WHERE hops > 0 GROUP BY seed, id"""
)
def type_closure(spark, sf_dir):
    """Everything below each region in the containment tree."""
    return G.reach(edges(spark, sf_dir), vertices(spark, sf_dir).where("type = 'region'").select("id"), 2, ["PART_OF"], reverse=True)


_SEED = "type = 'orders'"
_DOWN = f"""{GRAPH}, l AS (SELECT DISTINCT src, dst FROM e), r(seed, id, hops) AS (
    SELECT id, id, 0 FROM v WHERE {_SEED} UNION SELECT r.seed, l.dst, r.hops + 1 FROM r JOIN l ON l.src = r.id WHERE r.hops < 5),
    d AS (SELECT seed, id, min(hops) AS hops FROM r GROUP BY seed, id HAVING min(hops) > 0)"""


@query(f"{_DOWN} SELECT seed, hops, count(*) AS reached, round(sum(least(1.0, 0.6 * pow(0.7, hops) + 0.4 * 0.5)), 6) AS score FROM d GROUP BY 1, 2")
def impact_downstream(spark, sf_dir):
    """What every order depends on, by hops, and the score that comes with it."""
    got = G.reach_counts(edges(spark, sf_dir), vertices(spark, sf_dir).where(_SEED).select("id"), 5, SPREADS)
    return got.select("seed", "hops", "reached", F.round(F.col("reached") * G.impact_score(F.col("hops"), F.lit(0.5)), 6).alias("score"))


@query(
    f"""{GRAPH}, l AS (SELECT DISTINCT src, dst FROM e), r(seed, id, hops) AS (
    SELECT id, id, 0 FROM v WHERE type = 'supplier' UNION SELECT r.seed, l.src, r.hops + 1 FROM r JOIN l ON l.dst = r.id WHERE r.hops < 2),
    d AS (SELECT seed, id, min(hops) AS hops FROM r GROUP BY seed, id HAVING min(hops) > 0)
    SELECT seed, hops, count(*) AS reached FROM d GROUP BY seed, hops"""
)
def impact_upstream(spark, sf_dir):
    return G.reach_counts(edges(spark, sf_dir), vertices(spark, sf_dir).where("type = 'supplier'").select("id"), 2, SPREADS, reverse=True)


@query(
    f"""{_DOWN}, a AS (SELECT seed, count(*) FILTER (hops = 1) AS direct, count(*) FILTER (hops > 1) AS indirect,
    count(*) FILTER (0.6 * pow(0.7, hops) + 0.4 * 0.9 > 0.7) AS critical, count(*) AS affected FROM d GROUP BY seed)
    SELECT seed, direct, indirect, critical, CASE WHEN critical > 5 OR affected > 50 THEN 'critical' WHEN critical > 2 OR affected > 20 THEN 'high'
    WHEN critical > 0 OR affected > 5 THEN 'medium' ELSE 'low' END AS risk FROM a"""
)
def removal_simulation(spark, sf_dir):
    got = G.reach_counts(edges(spark, sf_dir), vertices(spark, sf_dir).where(_SEED).select("id"), 5, SPREADS)
    total = lambda kept: F.sum(F.when(kept, F.col("reached")).otherwise(0))
    critical = G.impact_score(F.col("hops"), F.lit(0.9)) > 0.7
    got = got.groupBy("seed").agg(total(F.col("hops") == 1).alias("direct"), total(F.col("hops") > 1).alias("indirect"), total(critical).alias("critical"), F.sum("reached").alias("affected"))
    return got.select("seed", "direct", "indirect", "critical", G.risk_level(F.col("affected"), F.col("critical")).alias("risk"))


@query(
    f"""{GRAPH}, b AS (SELECT src, dst FROM e WHERE type = 'PART_OF' UNION SELECT dst, src FROM e WHERE type = 'PART_OF'), p1 AS (SELECT src AS a, dst AS b FROM b WHERE src LIKE 'r:%'),
    p2 AS (SELECT p1.a, p1.b, b.dst AS c FROM p1 JOIN b ON b.src = p1.b WHERE b.dst <> p1.a) SELECT a || '>' || b || '>' || c AS path FROM p2"""
)
def paths_exact_depth(spark, sf_dir):
    e = edges(spark, sf_dir).where("type = 'PART_OF'")
    return G.paths(e, vertices(spark, sf_dir).where("type = 'region'").select("id"), 2).select(F.array_join("path", ">").alias("path"))


@query(
    f"""{GRAPH}, x AS (SELECT e.src, e.dst FROM e WHERE type = 'PART_OF'), own AS (SELECT x.src AS id, CASE WHEN x.dst LIKE 'r:%' THEN x.dst ELSE y.dst END AS community FROM x LEFT JOIN x y ON y.src = x.dst
    UNION SELECT id, id FROM v WHERE type = 'region'), j AS (SELECT a.community AS ca, b.community AS cb FROM x JOIN own a ON a.id = x.src JOIN own b ON b.id = x.dst), m AS (SELECT count(*)::DOUBLE AS m FROM j),
    d AS (SELECT c, count(*)::DOUBLE AS d FROM (SELECT ca AS c FROM j UNION ALL SELECT cb FROM j) GROUP BY c), l AS (SELECT ca AS c, count(*)::DOUBLE AS l FROM j WHERE ca = cb GROUP BY ca)
    SELECT round(sum(coalesce(l.l, 0) / m - pow(d.d / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN l USING (c), m"""
)
def region_modularity(spark, sf_dir):
    """Modularity of the containment edges with a vertex's region as its community."""
    e = edges(spark, sf_dir).where("type = 'PART_OF'")
    up = e.select(F.col("src").alias("dst"), F.col("dst").alias("up"))
    own = e.join(up, "dst", "left").select(F.col("src").alias("id"), F.when(F.col("dst").startswith("r:"), F.col("dst")).otherwise(F.col("up")).alias("community"))
    own = own.union(vertices(spark, sf_dir).where("type = 'region'").select("id", F.col("id").alias("community"))).distinct()
    return G.modularity(e, own).select(F.round("modularity", 6).alias("modularity"))


@query(
    f"""{GRAPH}, x AS (SELECT src, dst FROM e WHERE type = 'PART_OF'), own AS (SELECT x.src AS id, CASE WHEN x.dst LIKE 'r:%' THEN x.dst ELSE y.dst END AS region FROM x LEFT JOIN x y ON y.src = x.dst
    UNION SELECT DISTINCT dst, dst FROM x WHERE dst LIKE 'r:%') SELECT id, min(id) OVER (PARTITION BY region) AS component FROM own"""
)
def connected_components(spark, sf_dir):
    """Components of the containment edges: one for each region."""
    found = components(edges(spark, sf_dir).where("type = 'PART_OF'"), "src", "dst", hubs=True)
    return found.select(F.col("node").alias("id"), "component")


_RANK = "o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), x AS (SELECT e.src, e.dst, 1.0::DOUBLE / o.n AS share FROM e JOIN o USING (src)), k AS (SELECT count(*)::DOUBLE AS k FROM v), r0 AS (SELECT id, 1 / k AS rank FROM v, k)" + "".join(
    f", r{i} AS (SELECT v.id, 0.15::DOUBLE / k + 0.85::DOUBLE * coalesce(s.got, 0) AS rank FROM v CROSS JOIN k LEFT JOIN (SELECT x.dst, sum(r.rank * x.share) AS got FROM x JOIN r{i - 1} r ON r.id = x.src GROUP BY x.dst) s ON s.dst = v.id)" for i in range(1, 4)
)


@query(f"{GRAPH}, {_RANK} SELECT id, round(rank, 9) AS rank FROM r3")
def pagerank_fixed_iters(spark, sf_dir):
    """Three rounds over the whole graph, parallel edges counted."""
    return G.pagerank(vertices(spark, sf_dir), edges(spark, sf_dir), iterations=3, tolerance=0.0).select("id", F.round("rank", 9).alias("rank"))


@query()
def pagerank_full(spark, sf_dir):
    """PageRank of the whole graph until no rank moves by 1e-6, a hundred rounds at most."""
    return G.pagerank(vertices(spark, sf_dir), edges(spark, sf_dir), iterations=100).select("id", F.round("rank", 6).alias("rank"))


@query()
def graph_components(spark, sf_dir):
    """Components of the whole graph with three vertices or more, largest first, at most five."""
    found = components(edges(spark, sf_dir), "src", "dst", hubs=True).groupBy("component").agg(F.count("*").alias("size"))
    return found.where("size >= 3").orderBy(F.desc("size"), "component").limit(5)


@query()
def label_communities(spark, sf_dir):
    """Communities of the whole graph by label propagation, with their sizes."""
    found = G.label_propagation(vertices(spark, sf_dir), edges(spark, sf_dir))
    return found.groupBy("community").agg(F.count("*").alias("members"))


@query()
def betweenness_sampled(spark, sf_dir):
    """Betweenness over the whole graph, with regions and nations as sampled sources."""
    v = vertices(spark, sf_dir)
    return G.betweenness(v, edges(spark, sf_dir), v.where("type IN ('region', 'nation')").select("id")).withColumn("score", F.round("score", 6))
