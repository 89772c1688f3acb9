"""Merkle manifest of a dataset, with checkpoints and recomputation.

Records become leaves, leaves of a group are numbered by their order, and every FAN consecutive nodes become one node of
the next level until one is left, the group's subroot; subroots, ordered by group, make a further tree that ends in the
root. Only every STEP-th level is stored. A proof gathers the stored nodes of each aligned subtree (at most FAN ** STEP),
computes the missing levels between again, gives out the siblings on the way up, and drops those levels.

Groups are the only thing held by key: rows are numbered by sorted ranges, so that a group of any size is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.sources.tables import table, written

#: Nodes that become one node of the next level.
FAN = 8
#: Levels from one stored level to the next; FAN ** STEP nodes are gathered at once.
STEP = 3

_BITS = FAN.bit_length() - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column | str) -> Column:
    """Lowercase hex sha256 of values, each written as its UTF-8 byte count, a colon and itself, or - where it is null."""
    told = []
    for value in values:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def lowered(text: Column) -> Column:
    """text with A-Z alone in lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at (gapless from 0 in each g by order, nulls first) and n (rows of g); rows equal in all are interchangeable.

    Rows are sorted into ranges, which are cut even between equal rows, and only counts of (range, g) are summed up.
    """
    keys = [F.col("g").asc(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie").asc()]
    dealt = written(rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    each = Window.partitionBy("g")
    counts = dealt.groupBy("g", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("g", "_part", (F.sum("_n").over(each.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(each).alias("n"))
    inside = F.row_number().over(Window.partitionBy("g", "_part").orderBy(*keys[1:]))
    return dealt.withColumn("_inside", inside).join(written(before, 1), ["g", "_part"]).withColumn("at", F.col("_before") + F.col("_inside") - 1).drop("_tie", "_part", "_inside", "_before")


def _depth() -> Column:
    """Levels above the leaves of a group of n."""
    return reduce(Column.__add__, [(F.col("n") > F.lit(FAN**k)).cast("int") for k in range(62 // _BITS)])


def _folded_runs(nodes: Column) -> Column:
    """The next level above an array of nodes."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i, FAN), ""), 256))


def _gathered(nodes: DataFrame, level: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Aligned subtrees of the nodes of a stored level whose groups go on: g, n, depth, up (levels to its top), tree, own (nodes in order), l0 to l{STEP}."""
    up = F.least(F.lit(STEP), F.col("depth") - level)
    open_ = nodes.where(F.col("depth") > level).withColumn("up", up)
    found = open_.groupBy("g", "n", "depth", "up", F.expr(f"shiftright(at, {_BITS} * up)").alias("tree")).agg(F.sort_array(F.collect_list(F.struct("at", "node", *carry))).alias("own"))
    found = found.withColumn("l0", F.transform("own", lambda x: x.node))
    for k in range(STEP):  # levels above the top stay empty
        found = found.withColumn(f"l{k + 1}", F.when(F.col("up") > k, _folded_runs(F.col(f"l{k}"))).otherwise(F.array().cast("array<string>")))
    return found


def _pieces(place: Column) -> Column:
    """What stands left and right of a subtree's node and of its ancestors in their runs, from below; place is its number in the subtree."""
    out = []
    for k in range(STEP):
        at = F.expr(f"shiftright(_place, {_BITS * k})")
        run = at - at % FAN
        own = F.col(f"l{k}")
        sides = F.struct(F.array_join(F.slice(own, run + 1, at - run), "").alias("left"), F.array_join(F.slice(own, at + 2, run + FAN - 1 - at), "").alias("right"))
        out.append(F.when(F.col("up") > k, sides))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels above written leaves (g, n, depth, at, node): level 0, STEP, twice STEP and so on."""
    stored, deepest = [leaves], leaves.agg(F.max("depth")).first()[0] or 0
    for level in range(0, deepest, STEP):
        top = F.when(F.col("up") == STEP, F.col(f"l{STEP}")[0])
        for k in range(1, STEP):
            top = top.when(F.col("up") == k, F.col(f"l{k}")[0])
        stored.append(written(_gathered(stored[-1], level).select("g", "n", "depth", F.col("tree").alias("at"), top.alias("node"))))
    return stored


def _ended(stored: list[DataFrame]) -> DataFrame:
    """The last node of every group: g, node."""
    return reduce(DataFrame.unionByName, [s.where(F.col("depth") <= k * STEP).select("g", "node") for k, s in enumerate(stored)])


def _paths(stored: list[DataFrame], ends: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The leaves (carried columns, g, at, node) with pieces: their way up to the end of their group and ends' (g, pieces) from there."""
    above = None
    for k in reversed(range(len(stored))):
        kept = carry if k == 0 else ()
        closed = stored[k].where(F.col("depth") <= k * STEP).select("g", "at", "node", *kept).join(ends, "g")
        if above is None:
            above = closed
            continue
        trees = _gathered(stored[k], k * STEP, kept).join(above.select("g", F.col("at").alias("tree"), F.col("pieces").alias("_above")), ["g", "tree"])
        each = trees.select("*", F.posexplode("own").alias("_place", "_own")).withColumn("pieces", F.concat(_pieces(F.col("_place")), "_above"))
        above = each.select("g", F.col("_own.at").alias("at"), F.col("_own.node").alias("node"), *[F.col(f"_own.{c}").alias(c) for c in kept], "pieces").unionByName(closed)
        if k:
            above = written(above)
    return above


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the tree over their subroots, and the root (None without rows)."""

    levels: list[DataFrame]
    upper: list[DataFrame]
    root: str | None
    carry: tuple[str, ...]

    def subroots(self) -> DataFrame:
        """g (0 for a null group, else 1 and its value) and subroot."""
        return _ended(self.levels).withColumnRenamed("node", "subroot")

    def proofs(self, wanted: DataFrame | None = None, on: str | None = None) -> DataFrame:
        """Leaves with their carried columns, g, at, node and pieces (left and right, from the leaf's level to the root).

        With wanted, a table of values of the carried column on, only those leaves and the subtrees above them are
        gathered. Repeated values give their leaves once.
        """
        levels = self.levels
        if wanted is not None:
            asked = written(levels[0].join(wanted.select(on).distinct(), on, "left_semi"))
            trees = asked.select("g", F.expr(f"shiftright(at, {_BITS} * least({STEP}, depth))").alias("_tree")).distinct()
            levels = [levels[0].withColumn("_tree", F.expr(f"shiftright(at, {_BITS} * least({STEP}, depth))")).join(trees, ["g", "_tree"], "left_semi").drop("_tree"), *levels[1:]]
        ends = self.subroots().select("g").join(self._ends(), "g")
        found = _paths(levels, ends, self.carry)
        return found if wanted is None else found.join(asked.select("g", "at"), ["g", "at"], "left_semi")

    def _ends(self) -> DataFrame:
        top = self.upper[0].sparkSession.createDataFrame([("", [])], "g string, pieces array<struct<left:string,right:string>>")
        return written(_paths(self.upper, top, ("own",)).select(F.col("own").alias("g"), "pieces"))


def manifest(records: DataFrame, leaf: Column, group: str, order: list[str], carry: tuple[str, ...] = ()) -> Manifest:
    """The trees over records, whose leaves stand by order inside each group, nulls first, ties by the leaf.

    Null groups are one group, the first. Equal records are leaves each. carry names columns that leaves keep.
    """
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = written(records.select(g.alias("g"), leaf.alias("node"), *dict.fromkeys([*order, *carry])))  # texts are read once
    placed = numbered(leaves, [*order, "node"]).withColumn("depth", _depth())
    levels = _levels(written(placed.select("g", "n", "depth", "at", "node", *carry)))
    ends = _ended(levels).select(F.lit("").alias("g"), F.col("g").alias("own"), "node")
    upper = _levels(written(numbered(written(ends), ["own"]).withColumn("depth", _depth()).select("g", "n", "depth", "at", "node", "own")))
    last = _ended(upper).first()
    return Manifest(levels, upper, last and last.node, carry)


def folded(leaf: Column, pieces: Column) -> Column:
    """The root that follows from a leaf and its pieces."""
    return F.aggregate(pieces, leaf, lambda h, p: F.sha2(F.concat(p.left, h, p.right), 256))


def op13_merkle(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document, trees by lang; see the oracle.

    Null and repeated ids are leaves of their own: null ids first, equal ones by their leaf. A null lang is a group; an
    empty one is another. A document without siblings on its way has the sha256 of nothing as proof_sha256. Further
    columns are left out. No documents give no rows.
    """
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered(F.col("text"))).otherwise(F.col("text"))
    docs = docs.withColumn("other", digest("doc_id", "source", "lang", "n_chars", tampered))
    made = manifest(docs, digest("doc_id", "source", "lang", "n_chars", "text"), "lang", ["doc_id"], ("doc_id", "other"))
    told = F.array_join(F.transform("pieces", lambda p: F.concat(p.left, p.right)), "")
    found = made.proofs().join(made.subroots(), "g")
    return found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"), F.sha2(told, 256).alias("proof_sha256"), folded(F.col("other"), F.col("pieces")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _enc(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


#: The same trees by recursion; DuckDB has no crc32, so a table of it and a fold over bytes stand for it.
ORACLE = f"""WITH RECURSIVE
steps AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b)),
crcs AS (SELECT list(v ORDER BY b) AS t FROM steps),
d AS (SELECT doc_id, lang, source, n_chars, text, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS crc FROM documents, crcs),
d1 AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS changed FROM d),
head AS (SELECT *, {_enc("doc_id")} || {_enc("source")} || {_enc("lang")} || {_enc("n_chars")} AS h FROM d1),
leaves AS (SELECT doc_id, lang, sha256(h || {_enc("text")}) AS leaf, sha256(h || {_enc("changed")}) AS other FROM head),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (SELECT lang, 0 AS level, i, leaf AS node, n FROM placed
  UNION ALL SELECT lang, level + 1, i // {FAN}, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + {FAN - 1}) // {FAN} FROM tree WHERE n > 1 GROUP BY lang, level, i // {FAN}),
ends AS (SELECT lang, level AS depth, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (SELECT 0 AS level, i, subroot AS node, n FROM ends
  UNION ALL SELECT level + 1, i // {FAN}, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + {FAN - 1}) // {FAN} FROM upper WHERE n > 1 GROUP BY level, i // {FAN}),
every AS (SELECT coalesce('1' || lang, '0') AS g, level, i, node, n FROM tree WHERE n > 1
  UNION ALL SELECT coalesce('1' || e.lang, '0') AS g, e.depth + u.level, u.i, u.node, u.n FROM ends e, upper u WHERE u.n > 1),
me AS (SELECT row_number() OVER () AS k, p.doc_id, coalesce('1' || p.lang, '0') AS g, p.leaf, p.other, p.i, e.depth, e.i AS end_i, e.subroot FROM placed p JOIN ends e ON p.lang IS NOT DISTINCT FROM e.lang),
mine AS (SELECT k, g, level, me.other, CASE WHEN level < depth THEN me.i // (pow({FAN}, level)::BIGINT) ELSE end_i // (pow({FAN}, level - depth)::BIGINT) END AS i FROM me JOIN (SELECT DISTINCT g, level FROM every) USING (g)),
sides AS (SELECT k, level, coalesce(string_agg(e.node, '' ORDER BY e.i) FILTER (WHERE e.i < m.i), '') AS l, coalesce(string_agg(e.node, '' ORDER BY e.i) FILTER (WHERE e.i > m.i), '') AS r
  FROM mine m JOIN every e USING (g, level) WHERE e.i // {FAN} = m.i // {FAN} GROUP BY k, level),
fold AS (SELECT k, 0 AS level, other AS h FROM me UNION ALL SELECT k, f.level + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN sides s USING (k, level)),
ended AS (SELECT k, arg_max(h, level) AS folded_root FROM fold GROUP BY k),
proofs AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM sides GROUP BY k),
root AS (SELECT node AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM me JOIN ended USING (k) LEFT JOIN proofs USING (k), root"""
