"""N-gram Jaccard join by T-occurrence search in the manner of DivideSkip.

Two sets of n and m shingles with Jaccard similarity t or more share T = ceil(t (n + m) / (1 + t)) of them. Under one
order of all shingles, a set's first n - ceil(t n) + 1 form its short lists: a partner must share one of those. The
order puts long inverted lists last, so that they are probed, not merged. Short lists are merged by Spark's shuffle:
occurrences are counted for each pair, pairs that can't reach T any more are dropped, and for the rest the remaining
shingles of one set are binary-probed in the other's. Equal sets are one node throughout. Before pairs are formed,
every list is compared with one pivot, which turns groups of near copies into components at a cost linear in their
size; afterwards all pairs of a list that lie in different components are still counted, so no link between
components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm._text import mixed, shingles, signed, text_slices, words
from lodegraph.llm._rows import hidden
from lodegraph.llm._wanted import texts_of
from lodegraph.operators.components import connected_components
from lodegraph.sources.tables import written

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A list is long with more nodes than this, or more if there would be over MOST_LONG of them; they travel to all tasks.
LONG, MOST_LONG = 12, 1_000_000
#: A node is at home with a hub from this similarity on, and blocks of nodes with one home hold so many at most.
HOME, BLOCK = 0.02, 400
#: Shingles of a slice of a component at most, texts longer than that alone; a task that counts links holds two slices.
SLICE_SHINGLES = 1 << 20
#: Nodes that a task remembers in order not to send copies again; forgetting only sends them twice.
REMEMBERED = 1 << 20


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for low, high, data, starts in text_slices(column):
        hashes, _, _, rows = words(data, starts)
        values, counts = shingles(hashes, rows)
        for r in range(high - low):
            yield np.unique(values[rows[r] : rows[r] + counts[r]])


def node_of(values: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        spread = mixed(values + np.uint64(len(values)))
        return int(signed(mixed(np.array([spread.sum(dtype=np.uint64)], dtype=np.uint64)) ^ mixed(np.array([np.bitwise_xor.reduce(spread)], dtype=np.uint64) + np.uint64(7)))[0])


def short(n: int) -> int:
    """How many of n shingles a set must merge."""
    return n - (PERCENT * n + 99) // 100 + 1


def _prefixes(long_lists: np.ndarray | None, slack: bool):
    """For each distinct set of a task: node, size and its first shingles, those of long lists last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, lists = [], [], []
            for values in shingle_sets(batch.column("text")):
                if not len(values):
                    continue
                node = node_of(values)
                if node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                n = len(values)
                if long_lists is not None and len(long_lists):
                    at = np.searchsorted(long_lists, values)
                    is_long = long_lists[np.minimum(at, len(long_lists) - 1)] == values
                    values = np.concatenate([values[~is_long], values[is_long]])
                p = short(n)
                if slack:  # what would move up if some of the first turn out long
                    p = min(n, p + p // 8 + 2)
                nodes.append(node)
                sizes.append(n)
                lists.append(signed(np.ascontiguousarray(values[:p])))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int32()), pa.array(lists, type=pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes = [], []
        for values in shingle_sets(batch.column("text")):
            nodes.append(node_of(values) if len(values) else None)
            sizes.append(len(values))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int64())], names=["doc_id", "text_hash", "node", "n"])


def _close(n: Column, m: Column) -> Column:
    """Sizes that leave the similarity possible."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _reachable(count: Column, n: Column, m: Column) -> Column:
    """Whether count occurrences among the short lists leave the required overlap possible."""
    rest = lambda x: F.ceil(x * PERCENT / 100) - 1  # noqa: E731  shingles beyond the short lists
    return count + F.greatest(rest(n), rest(m)) >= F.ceil((n + m) * PERCENT / (100 + PERCENT) - 1e-9)


def nodes_of(column: pa.Array) -> np.ndarray:
    """The name of each row's set; rows without words have name 0."""
    return np.array([node_of(values) if len(values) else 0 for values in shingle_sets(column)], dtype=np.int64)


def _verified(docs: DataFrame, pairs: DataFrame, carriers: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes, counted exactly, and whether they link; b should be the one in many pairs."""
    named = pairs.join(carriers.select(F.col("node").alias("a"), F.col("doc_id").alias("doc_a")), "a").join(carriers.select(F.col("node").alias("b"), F.col("doc_id").alias("doc_b")), "b")
    named = written(named)
    if not named.take(1):
        return named.select("a", "b", F.lit(0.0).alias("similarity"), F.lit(False).alias("linked"))
    texts = texts_of(docs, named.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")), nodes_of)
    # rows are told apart by node, for ids may be null or repeat
    b, a = (texts.select(F.col("node").alias(f"_{x}"), F.col("doc_id").alias(f"_doc_{x}"), F.col("text").alias(f"text_{x}")) for x in "ba")
    both = named.join(b, (F.col("b") == F.col("_b")) & F.col("doc_b").eqNullSafe(F.col("_doc_b"))).drop("_b", "_doc_b")
    both = both.join(a, (F.col("a") == F.col("_a")) & F.col("doc_a").eqNullSafe(F.col("_doc_a"))).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                names = batch.column("b").to_pylist()
                fresh = [i for i, b in enumerate(names) if b not in known]
                if len(known) > 512:
                    known.clear()
                    fresh = list(range(len(names)))
                known.update(zip([names[i] for i in fresh], shingle_sets(batch.column("text_b").take(pa.array(fresh, type=pa.int64()))), strict=True))
                similar, linked = [], []
                for mine, b in zip(shingle_sets(batch.column("text_a")), names, strict=True):
                    other = known[b]
                    few, many = (mine, other) if len(mine) <= len(other) else (other, mine)
                    at = np.searchsorted(many, few)  # a binary probe of the longer list for each shingle of the shorter
                    shared = int((many[np.minimum(at, len(many) - 1)] == few).sum())
                    similar.append(shared / (len(mine) + len(other) - shared))
                    linked.append(100 * shared >= PERCENT * (len(mine) + len(other) - shared))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar, type=pa.float64()), pa.array(linked, type=pa.bool_())], names=["a", "b", "similarity", "linked"])

    return both.mapInArrow(run, "a long, b long, similarity double, linked boolean").distinct()


def _homes(star: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, home, far): the hub that a node is near enough to be one of its copies, and its distance; hubs of hubs first."""
    near = star.join(seen, (F.col("node") == F.col("a")) & (F.col("hub") == F.col("b"))).where(F.col("similarity") >= HOME)
    own = written(near.groupBy("node").agg(F.max(F.struct("c", "hub", (1 - F.col("similarity")).alias("far"))).alias("h")).select("node", F.col("h.hub").alias("home"), "h.far"))
    own = own.unionByName(own.select(F.col("home").alias("node")).distinct().join(own, "node", "left_anti").select("node", F.col("node").alias("home"), F.lit(0.0).alias("far")))
    for _ in range(3):  # a hub that is itself a copy hands its copies on; how far they are is not known then
        up = own.where("node <> home").select(F.col("node").alias("home"), F.col("home").alias("up"))
        own = written(own.join(up, "home", "left").select("node", F.coalesce("up", "home").alias("home"), F.when(F.col("up").isNull(), F.col("far")).alias("far")))
    return own


def _in_blocks(docs: DataFrame, marked: DataFrame, carriers: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that share a home but not a component, from tasks of two blocks of BLOCK nodes at most.

    Blocks hold one component or many; two of the same single component need no task, nor do two whose distances from
    the hub differ by more than a link allows, for Jaccard distance is a metric, nor two of too different sizes.
    """
    nodes = marked.where("home IS NOT NULL").groupBy("node").agg(F.min("n").alias("n"), F.min("c").alias("c"), F.min("home").alias("home"), F.min("far").alias("far"))
    main = nodes.groupBy("home", "c").agg(F.count("*").alias("size")).groupBy("home").agg(F.max(F.struct("size", "c")).alias("m")).select("home", F.col("m.c").alias("main"))
    kind = F.struct((F.col("c") == F.col("main")).alias("main"), F.coalesce(F.floor(F.col("far") * 20), F.lit(-1)).alias("far"))
    nodes = written(nodes.join(main, "home").withColumn("kind", kind).drop("main"))
    sizes = nodes.groupBy("home", "kind").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SLICE_SHINGLES)).alias("slices"))
    nodes = written(nodes.join(sizes, ["home", "kind"]).withColumn("block", F.xxhash64("home", "kind", F.pmod(F.xxhash64("node"), "slices"))).drop("slices"))
    blocks = nodes.groupBy("home", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("far").alias("f0"), F.max("far").alias("f1"))
    blocks = written(blocks)
    a, b = (blocks.select("home", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "n0", "n1", "c0", "c1", "f0", "f1")]) for side in "ab")
    one = (F.col("c0_a") == F.col("c1_a")) & (F.col("c0_b") == F.col("c1_b")) & (F.col("c0_a") == F.col("c0_b"))
    gap = F.greatest(F.col("f0_a") - F.col("f1_b"), F.col("f0_b") - F.col("f1_a")) > (100 - PERCENT) / 100 + 1e-9
    size = (F.col("n1_a") * 100 >= F.col("n0_b") * PERCENT) & (F.col("n1_b") * 100 >= F.col("n0_a") * PERCENT)
    tasks = a.join(b, "home").where((F.col("block_a") <= F.col("block_b")) & ~one & size & ~F.coalesce(gap, F.lit(False)))
    sides = tasks.select(F.xxhash64("block_a", "block_b").alias("task"), F.explode(F.when(F.col("block_a") == F.col("block_b"), F.array("block_a")).otherwise(F.array("block_a", "block_b"))).alias("block"))
    sent = written(sides.join(nodes, "block").join(carriers, "node").select("task", "block", "node", "c", "doc_id"))
    if not sent.take(1):
        return sent.select(F.col("node").alias("a"), F.col("node").alias("b"))
    texts = texts_of(docs, sent.select("doc_id"), nodes_of).withColumnsRenamed({"node": "_node", "doc_id": "_doc"})
    whole = sent.join(texts, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("task", "block", "node", "c", "text")
    return whole.groupBy("task").applyInArrow(_search, "a long, b long").distinct()


def _search(table: pa.Table) -> pa.Table:
    """T-occurrence search of each node of the first block among those of the second: list positions are counted for each
    candidate, and candidates that reach the overlap which their sizes ask for are links."""
    node, c, block = (np.array(table.column(x)) for x in ("node", "c", "block"))
    sets = [x for chunk in table.column("text").chunks for x in shingle_sets(chunk)]
    _, first = np.unique(node, return_index=True)  # rows that repeat an id repeat a text
    order = first[np.argsort(block[first], kind="stable")]
    left = order[block[order] == block[order].min()]
    right = order[block[order] == block[order].max()]
    tokens = np.concatenate([sets[i] for i in right])
    owner = np.repeat(np.arange(len(right)), [len(sets[i]) for i in right])
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    sizes = np.array([len(sets[i]) for i in right])
    out_a, out_b = [], []
    for i in left:
        low, high = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        spans = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        hit = np.flatnonzero((100 * shared >= PERCENT * (len(sets[i]) + sizes - shared)) & (c[right] != c[i]))
        out_a.extend([node[i]] * len(hit))
        out_b.extend(node[right[hit]])
    return pa.table({"a": pa.array(out_a, type=pa.int64()), "b": pa.array(out_b, type=pa.int64())})


def _degrees(docs: DataFrame, nodes: DataFrame, carriers: DataFrame) -> DataFrame:
    """(node, n_links): rows whose set is another one that links with the node's. nodes: (node, n, rows, c).

    Links stay inside components. Those are cut into slices by a class of sizes, of which only a neighbouring one can hold
    partners, and a hash; a task takes two slices, and small components of a class share one. Every text is sent to as
    many tasks as its component has slices that can hold partners.
    """
    several = nodes.groupBy("c").agg(F.count("*").alias("size")).where("size > 1").select("c")
    kind = F.floor(F.log("n") / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
    own = written(nodes.join(several, "c").withColumn("kind", kind))
    if not own.take(1):
        return own.select("node", F.lit(0).cast("long").alias("n_links"))
    sizes = own.groupBy("c", "kind").agg(F.ceil(F.sum("n") / SLICE_SHINGLES).cast("int").alias("slices"), F.sum("n").alias("shingles"))
    # a component is small if a slice can hold all of it; several of those go to one task
    large = sizes.groupBy("c").agg((F.sum("shingles") > SLICE_SHINGLES // 4).alias("large"), F.collect_list(F.struct("kind", "slices")).alias("kinds"))
    total = own.join(large.where("not large"), "c").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = int(max(1, total * 4 // SLICE_SHINGLES))
    told = own.join(large, "c")
    together = told.where("not large").select(F.pmod(F.xxhash64("c"), F.lit(tasks)).alias("task"), F.lit(0).alias("side"), "node", "rows", "c")
    parts = told.where("large").withColumn("slice", F.pmod(F.xxhash64(F.lit(3), "node"), F.element_at(F.map_from_entries("kinds"), F.col("kind"))).cast("int"))
    # all slices of the own kind and of both neighbours; of two slices, the lesser one names the task and is its first side
    mine = F.struct("kind", "slice")
    partners = F.flatten(F.transform(F.filter("kinds", lambda k: F.abs(k["kind"] - F.col("kind")) <= 1), lambda k: F.transform(F.sequence(F.lit(0), k["slices"] - 1), lambda i: F.struct(k["kind"].alias("kind"), i.alias("slice")))))
    parts = parts.withColumn("other", F.explode(partners)).select(F.xxhash64("c", F.least(mine, "other"), F.greatest(mine, "other")).alias("task"), F.when(mine == F.col("other"), 0).when(mine < F.col("other"), 1).otherwise(2).alias("side"), "node", "rows", "c")
    sent = written(together.unionByName(parts).join(carriers, "node"))
    texts = texts_of(docs, sent.select("doc_id"), nodes_of).withColumnsRenamed({"node": "_node", "doc_id": "_doc"})
    whole = sent.join(texts, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("task", "side", "node", "rows", "c", "text")
    return whole.groupBy("task").applyInArrow(_count_links, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of left shares with each of right, as a product of the matrices of those that both sides have."""
    of = [np.concatenate([np.zeros(0, dtype=np.uint64), *x]) for x in (left, right)]
    common = np.intersect1d(*of)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, len(common), 4096):
        part, dense = common[low : low + 4096], []
        for sets, values in ((left, of[0]), (right, of[1])):
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            m[owner[hit], at[hit]] = 1.0
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _count_links(table: pa.Table) -> pa.Table:
    """Links of a task's nodes with each other, side 0, or of the nodes of side 1 with those of side 2, in blocks."""
    node, rows, c, side = (np.array(table.column(x)) for x in ("node", "rows", "c", "side"))
    sets = [x for chunk in table.column("text").chunks for x in shingle_sets(chunk)]
    _, first = np.unique(node, return_index=True)  # rows that repeat an id and a text
    first = first[np.lexsort((node[first], c[first]))]
    sizes = np.array([len(x) for x in sets])
    links = np.zeros(len(node), dtype=np.int64)
    one = first if side[0] == 0 else first[side[first] == 1]
    two = first if side[0] == 0 else first[side[first] == 2]
    steps = 256
    for i in range(0, len(one), steps):
        a = one[i : i + steps]
        # nodes are in order of components, so the partners of a block are a stretch
        low, high = np.searchsorted(c[two], c[a].min(), "left"), np.searchsorted(c[two], c[a].max(), "right")
        for j in range(low if side[0] else max(low, i), high, steps):
            b = two[j : min(high, j + steps)]
            shared = _shared([sets[x] for x in a], [sets[x] for x in b])
            hit = (100 * shared >= PERCENT * (sizes[a][:, None] + sizes[b][None, :] - shared)) & (node[a][:, None] != node[b][None, :])
            links[a] += hit @ rows[b]
            if side[0] or j > i:
                links[b] += rows[a] @ hit
    return pa.table({"node": pa.array(node[first]), "n_links": pa.array(links[first])})


def jaccard_components(docs: DataFrame, with_text_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) of each row of docs (doc_id long, text); with_text_hash also component and text_hash.

    n_links counts the other rows that the row links with, rows of an equal set included. Null and empty texts have no
    shingles, no links and their own id.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    members = written(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_members, "doc_id long, text_hash long, node long, n long"))
    carriers = written(members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").cast("int").alias("n"), F.count("*").alias("rows")))
    sizes, carriers = carriers, carriers.select("node", "doc_id")
    shape = "node long, n int, tokens array<long>"
    first = docs.mapInArrow(_prefixes(None, True), shape).select(F.explode("tokens").alias("token"))
    counts = written(first.groupBy("token").count().where(F.col("count") > LONG))
    limit = LONG
    while counts.where(F.col("count") > limit).count() > MOST_LONG:
        limit *= 2
    long_lists = np.sort(np.array(counts.where(F.col("count") > limit).select("token").toArrow().column("token"), dtype=np.int64).view(np.uint64))
    rows = docs.mapInArrow(_prefixes(long_lists, False), shape).select("node", "n", F.explode("tokens").alias("token"))
    here = Window.partitionBy("token")
    live = rows.withColumns({"least": F.min("node").over(here), "most": F.max("node").over(here)}).where("least < most")
    live = written(live.select("token", "node", "n").distinct())  # tasks that met the same set sent it more than once
    # the hub of a list is the node that shares most of its short lists: the text that near copies were made from
    shared = live.groupBy("node").agg(F.count("*").alias("k"), F.min("n").alias("n"))
    shared = shared.select("node", (F.col("k") / (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).alias("score"))
    star = live.join(shared, "node").withColumn("hub", F.max(F.struct("score", "node", "n")).over(here)).where(F.col("node") != F.col("hub.node"))
    star = star.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("c"), F.min("n").alias("n"), F.min("hub.n").alias("m"))
    star = written(star.where(F.col("c") * 100 >= F.least("n", "m") * 2))
    seen = written(_verified(docs, star.select(F.col("node").alias("a"), F.col("hub").alias("b")), carriers))
    links = seen.where("linked").select("a", "b")
    classes = written(connected_components(links))
    homes = written(_homes(star, seen))
    marked = live.join(classes, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    several = marked.groupBy("token").agg((F.min("c") < F.max("c")).alias("open")).where("open").select("token")
    marked = written(marked.join(several, "token").join(homes, "node", "left"))
    # k lists of a node are open, so no partner can be met in more of them
    open_lists = marked.groupBy("node").agg(F.count("*").cast("int").alias("k"))
    a, b = (marked.join(open_lists, "node").select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "c", "home", "k")]) for side in "ab")
    # two that are at home with one hub are compared block by block, all others list by list
    apart = ~F.coalesce(F.col("home_a") == F.col("home_b"), F.lit(False))
    pairs = a.join(b, "token").where((F.col("c_a") != F.col("c_b")) & (F.col("node_a") < F.col("node_b")) & _close(F.col("n_a"), F.col("n_b")) & apart & _reachable(F.least("k_a", "k_b"), F.col("n_a"), F.col("n_b")))
    pairs = pairs.groupBy("node_a", "node_b").agg(F.count("*").alias("c"), F.min("n_a").alias("n"), F.min("n_b").alias("m"))
    pairs = pairs.where(_reachable(F.col("c"), F.col("n"), F.col("m"))).select(F.col("node_b").alias("a"), F.col("node_a").alias("b"))
    links = links.union(_verified(docs, pairs, carriers).where("linked").select("a", "b")).union(_in_blocks(docs, marked, carriers))
    links = written(links)
    classes = connected_components(links)
    nodes = written(sizes.join(classes, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
    degrees = _degrees(docs, nodes.select("node", "n", "rows", "c"), carriers)
    least = nodes.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(least, "c").join(degrees, "node", "left").select("node", "c", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    found = members.join(named, "node", "left")
    # rows without words are components of their own
    more = [F.coalesce("c", F.xxhash64(F.lit("no words"), "doc_id", "text_hash")).alias("component"), "text_hash"] if with_text_hash else []
    return found.select(*more, "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _typed(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")


def op5_ngram_join(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Set sizes and components of all documents under links of five-word shingles at 75 %.

    Rows that repeat an id are rows of their own, told apart by their sets; a null id takes part in links and has the
    least id reachable, or null. n_links counts the other rows that a row links with. Further columns are ignored.
    An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    return jaccard_components(_typed(docs)).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component, in the columns of docs.

    Documents without words are components of their own; documents without an id stay if their component has no id at
    all. Where rows share that least id, one stays: of those that link, the one whose text has the least hash. An empty
    table gives no rows; further columns may have any name.
    """
    plain, name = hidden(docs)
    rows = plain.select("*", F.col(name["doc_id"]).cast("long").alias("_doc"), F.col(name["text"]).cast("string").alias("_text"))
    found = jaccard_components(rows.select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text")), with_text_hash=True)
    stay = written(found.where("doc_id <=> component_id").groupBy("component", "doc_id").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("rows")))
    own = rows.withColumn("_hash", F.xxhash64("_text"))
    same = F.col("_doc").eqNullSafe(stay["doc_id"]) & (F.col("_hash") == stay["text_hash"])
    kept = own.join(stay, same, "left_semi")
    if stay.where("rows > 1 AND doc_id IS NOT NULL").take(1):  # rows that repeat an id and a text are one
        again = kept.where(F.col("_doc").isNotNull()).dropDuplicates(["_doc", "_hash"])
        kept = again.unionByName(kept.where(F.col("_doc").isNull()))
    return kept.select(*plain.columns).toDF(*docs.columns)
