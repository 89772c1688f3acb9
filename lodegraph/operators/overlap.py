"""Overlap of every document with every item, from the terms that they have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of items up to which they are broadcast; more are joined by a shuffle.
MOST_TERMS = 1_000_000


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, common, n_doc, n_item) of each pair of rows with a common term; all other pairs have none.

    docs has doc_id, items has item_id, both have terms, an array of distinct values. Rows that repeat an id, or have
    none, are rows of their own. All terms of a document are in one task, so counts are summed up before the shuffle.
    """
    # rows are numbered before they are exploded
    wanted = items.withColumn("_item", F.monotonically_increasing_id()).select("item_id", "_item", F.size("terms").alias("n_item"), F.explode("terms").alias("_term"))
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_TERMS else wanted
    had = docs.withColumn("_doc", F.monotonically_increasing_id()).select("doc_id", "_doc", F.size("terms").alias("n_doc"), F.explode("terms").alias("_term"))
    pairs = had.join(wanted, "_term").groupBy("_doc", "_item", "doc_id", "item_id", "n_doc", "n_item").agg(F.count("*").alias("common"))
    return pairs.select("doc_id", "item_id", "common", "n_doc", "n_item")
