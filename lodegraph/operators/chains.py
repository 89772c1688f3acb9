"""Chains of any length by pointer doubling: the root and the place of every row from its link alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.sources.tables import drop, written


def ranked(links: DataFrame, ident: str, before: str) -> DataFrame:
    """(ident, root, position, cyclic): the row at which each row's chain of links begins, and how many links lead there.

    before names the row that a row follows, null for a first one; a link to a row that is not there ends the chain too.
    In each round every row looks up what the row that it points at points at, so chains of n rows take log2(n) rounds.
    Rows whose links run into a cycle have no root and no position, and cyclic is true. Several rows may follow one. Of
    rows that repeat an ident the one with the least link counts; null idents are left out.
    """
    rows = links.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("id")).agg(F.min(before).alias("to"))
    there = rows.select(F.col("id").alias("to"), F.lit(True).alias("_there"))
    now = written(rows.join(there, "to", "left").select("id", F.when(F.col("_there"), F.col("to")).alias("to")).select("id", "to", F.coalesce("to", "id").alias("root"), F.col("to").isNotNull().cast("long").alias("position")))
    most = now.count()
    steps = 0
    while (1 << steps) <= max(1, most) and now.where("to IS NOT NULL").take(1):
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("root").alias("_root"), F.col("position").alias("_more"))
        done = now.where("to IS NULL")
        on = now.where("to IS NOT NULL").join(ahead, "to")
        following = written(done.unionByName(on.select("id", F.col("_to").alias("to"), F.col("_root").alias("root"), (F.col("position") + F.col("_more")).alias("position"))))
        drop(now)
        now, steps = following, steps + 1
    cyclic = F.col("to").isNotNull()
    return now.select(F.col("id").alias(ident), F.when(~cyclic, F.col("root")).alias("root"), F.when(~cyclic, F.col("position")).alias("position"), cyclic.alias("cyclic"))


def ends(links: DataFrame, ident: str, after: str) -> DataFrame:
    """(ident, end, steps, cyclic): where each row's chain of replacements ends, such as the type that a deprecated one has become."""
    return ranked(links, ident, after).withColumnsRenamed({"root": "end", "position": "steps"})
