"""Stored runs of community detection: runs, communities and summaries by run, the latest run, retention, and matching across runs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.sources.commits import CommitLog
from lodegraph.sources.tables import drop, written

_SUMMARIES = "run_id string, community string, title string, summary string, version int"


class RunStore:
    """Runs under path. The log's last version lists the runs that are kept, so a run appears, and goes, as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, CommitLog(spark, f"{path}/commits")

    def runs(self) -> list[dict]:
        """What is kept of each run: run_id, created, algorithm, nodes, communities; oldest first."""
        return self.log.latest()[1].get("runs", [])

    def store(self, run_id: str, created: str, assigned: DataFrame, algorithm: str = "louvain") -> None:
        """Keep a run's communities, of assigned (id, community); an id that repeats keeps its least community.

        created is a time in text that sorts as it passes. A run_id that is known raises.
        """
        version, content = self.log.latest()
        if any(r["run_id"] == run_id for r in self.runs()):
            raise ValueError(f"run {run_id} exists")
        folder = f"members/{uuid.uuid4().hex}"
        rows = assigned.where("id IS NOT NULL AND community IS NOT NULL").groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.col("community").cast("string")).alias("community"))
        rows.withColumn("run_id", F.lit(run_id)).write.parquet(f"{self.path}/{folder}")
        n, k = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.count("*"), F.count_distinct("community")).first()
        run = {"run_id": run_id, "created": created, "algorithm": algorithm, "nodes": n, "communities": k, "folder": folder}
        self.log.commit(version + 1, {**content, "runs": sorted([*self.runs(), run], key=lambda r: (r["created"], r["run_id"]))})

    def latest(self) -> dict | None:
        """The run that was created last."""
        return self.runs()[-1] if self.runs() else None

    def members(self, run_id: str | None = None) -> DataFrame:
        """(id, community, run_id) of a run, or of the latest."""
        run = next((r for r in reversed(self.runs()) if run_id in (None, r["run_id"])), None)
        if run is None:
            return self.spark.createDataFrame([], "id string, community string, run_id string")
        return self.spark.read.schema("id string, community string, run_id string").parquet(f"{self.path}/{run['folder']}")

    def communities(self, run_id: str | None = None, least: int = 1) -> DataFrame:
        """(community, size, run_id) of a run, those of fewer members left out."""
        return self.members(run_id).groupBy("community", "run_id").agg(F.count("*").alias("size")).where(F.col("size") >= least)

    def snapshots(self, limit: int = 10) -> DataFrame:
        """(run_id, created, algorithm, nodes, communities) of the last runs, latest first."""
        rows = [(r["run_id"], r["created"], r["algorithm"], r["nodes"], r["communities"]) for r in reversed(self.runs()[-limit:])]
        return self.spark.createDataFrame(rows, "run_id string, created string, algorithm string, nodes long, communities long")

    def summarise(self, summaries: DataFrame) -> None:
        """Keep summaries (run_id, community, title, summary); a later one of the same community counts."""
        version, content = self.log.latest()
        folder = f"summaries/{uuid.uuid4().hex}"
        summaries.select("run_id", F.col("community").cast("string").alias("community"), "title", "summary", F.lit(version + 1).alias("version")).write.parquet(f"{self.path}/{folder}")
        self.log.commit(version + 1, {**content, "summaries": [*content.get("summaries", []), folder]})

    def summaries(self, communities: list[str] | None = None, run_id: str | None = None) -> DataFrame:
        """(run_id, community, title, summary) of a run, or of the latest: the last of each community that was not deleted."""
        content = self.log.latest()[1]
        run = run_id or (self.latest() or {}).get("run_id")
        folders = [f"{self.path}/{f}" for f in content.get("summaries", [])]
        rows = self.spark.read.schema(_SUMMARIES).parquet(*folders) if folders else self.spark.createDataFrame([], _SUMMARIES)
        rows = rows.where(F.col("run_id") == F.lit(run))
        rows = rows if communities is None else rows.where(F.col("community").isin(communities))
        last = rows.groupBy("run_id", "community").agg(F.max(F.struct("version", "title", "summary")).alias("s"))
        return last.where("s.summary IS NOT NULL").select("run_id", "community", "s.title", "s.summary")

    def delete_summary(self, community: str, run_id: str | None = None) -> None:
        """Forget the summary of a community: a later row without text."""
        run = run_id or (self.latest() or {}).get("run_id")
        self.summarise(self.spark.createDataFrame([(run, community, None, None)], "run_id string, community string, title string, summary string"))

    def retain(self, most: int) -> list[str]:
        """Keep the last runs alone; the ids of those that go. Their files are deleted once no version names them as kept."""
        version, content = self.log.latest()
        kept, gone = self.runs()[-most:] if most else [], self.runs()[:-most] if most else self.runs()
        if gone:
            self.log.commit(version + 1, {**content, "runs": kept})
            for run in gone:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run['folder']}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return [r["run_id"] for r in gone]

    def stats(self) -> DataFrame:
        """(kind, n): how many runs, communities, summaries and members are kept."""
        runs = self.runs()
        summaries = reduce(lambda n, r: n + self.summaries(run_id=r["run_id"]).count(), runs, 0)
        rows = [("run", len(runs)), ("community", sum(r["communities"] for r in runs)), ("member", sum(r["nodes"] for r in runs)), ("summary", summaries)]
        return self.spark.createDataFrame(rows, "kind string, n long")


def overlaps(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new, common, old_size, new_size): communities of two runs (id, community) that share members."""
    a = before.select("id", F.col("community").alias("old"))
    b = after.select("id", F.col("community").alias("new"))
    sizes = a.groupBy("old").agg(F.count("*").alias("old_size")), b.groupBy("new").agg(F.count("*").alias("new_size"))
    return a.join(b, "id").groupBy("old", "new").agg(F.count("*").alias("common")).join(sizes[0], "old").join(sizes[1], "new").select("old", "new", "common", "old_size", "new_size")


def matched(pairs: DataFrame) -> DataFrame:
    """(old, new, common): the greedy one-to-one matching of pairs (old, new, common), most in common first, ties by old, then new.

    In each round every pair that is the best left for both of its ends is taken; with one order of all pairs, this
    takes the pairs that a walk down the whole order would. Each round takes a pair at least, commonly most of them.
    """
    best = lambda side: Window.partitionBy(side).orderBy(F.desc("common"), "old", "new")
    left, found = written(pairs.select("old", "new", "common")), []
    while left.take(1):
        ranked = left.withColumns({"_o": F.row_number().over(best("old")), "_n": F.row_number().over(best("new"))})
        taken = written(ranked.where("_o = 1 AND _n = 1").select("old", "new", "common"))
        found.append(taken)
        rest = written(left.join(taken.select("old"), "old", "left_anti").join(taken.select("new"), "new", "left_anti"))
        drop(left)
        left = rest
    return reduce(DataFrame.unionByName, found) if found else pairs.select("old", "new", "common")


def compared(before: DataFrame, after: DataFrame, share: float = 0.3) -> DataFrame:
    """(old, new, change): what has become of the communities of one run in the next, both as (id, community).

    Matched communities are same (equal members and name), renamed (equal members, another name) or changed. Others
    are split: a new one with at least share of its members from an old one that is matched elsewhere; merged: an old
    one with at least share of its members in a new one that is matched elsewhere; or else new and gone.
    """
    pairs = written(overlaps(before, after))
    match = written(matched(pairs))
    told = match.join(pairs, ["old", "new", "common"])
    same = (F.col("common") == F.col("old_size")) & (F.col("common") == F.col("new_size"))
    change = F.when(same & (F.col("old") == F.col("new")), "same").when(same, "renamed").otherwise("changed")
    first = told.select("old", "new", change.alias("change"))
    w = lambda side: Window.partitionBy(side).orderBy(F.desc("common"), "old", "new")
    free_new = after.select(F.col("community").alias("new")).distinct().join(match.select("new"), "new", "left_anti")
    parts = pairs.join(free_new, "new").withColumn("_k", F.row_number().over(w("new"))).where((F.col("_k") == 1) & (F.col("common") >= share * F.col("new_size")))
    fresh = free_new.join(parts.select("new", "old"), "new", "left").select("old", "new", F.when(F.col("old").isNotNull(), "split").otherwise("new").alias("change"))
    free_old = before.select(F.col("community").alias("old")).distinct().join(match.select("old"), "old", "left_anti")
    into = pairs.join(free_old, "old").withColumn("_k", F.row_number().over(w("old"))).where((F.col("_k") == 1) & (F.col("common") >= share * F.col("old_size")))
    lost = free_old.join(into.select("old", "new"), "old", "left").select("old", "new", F.when(F.col("new").isNotNull(), "merged").otherwise("gone").alias("change"))
    return first.unionByName(fresh).unionByName(lost)
