"""Heavy hitters of streams: a bounded summary as streaming state, and exact counts of what it holds."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodegraph.streaming.state import _latest
from lodegraph.streaming.twins import drained

#: Counters of a summary, and summaries: items are dealt over them by a hash, so no task sees all.
COUNTERS, SHARDS = 1_000, 16


class Summary:
    """Space-saving counters of a stream of items: a new item takes the place, and the count as its error, of the least.

    Of n items, any that came more than n / size times has a counter, whose count less its error is at most the true
    count, and whose count is at least that.
    """

    def __init__(self, size: int):
        self.size, self.n = size, 0
        self.counts: dict[str, int] = {}
        self.errors: dict[str, int] = {}
        self.heap: list[tuple[int, str]] = []

    def add(self, item: str, times: int = 1) -> None:
        self.n += times
        if item in self.counts:
            self.counts[item] += times
            return
        least = self._drop() if len(self.counts) >= self.size else 0
        self.counts[item], self.errors[item] = least + times, least
        heapq.heappush(self.heap, (least + times, item))

    def _drop(self) -> int:
        """Take the item of the least count out; counts in the heap may be old ones, too low, and are put right as they come up."""
        while True:
            count, item = self.heap[0]
            now = self.counts.get(item)
            if now == count:
                heapq.heappop(self.heap)
                del self.counts[item], self.errors[item]
                return count
            heapq.heapreplace(self.heap, (now, item))


def streamed_summary(items: DataFrame, item: str, counters: int = COUNTERS, shards: int = SHARDS) -> DataFrame:
    """(item, count, error, total): the summaries of all shards after a stream of items; total is of all items of its shard.

    State is counters a shard, whatever the number of items. Null items are left out.
    """
    spark = items.sparkSession

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        summary, part = pickle.loads(state.get[0]) if state.exists else (Summary(counters), 0)
        for rows in batches:
            for value, times in sorted(rows["item"].value_counts().items()):
                summary.add(value, int(times))
        state.update((pickle.dumps((summary, part + 1)),))
        told = sorted(summary.counts)
        yield pd.DataFrame({"shard": [name[0]], "held": [told], "counts": [[summary.counts[x] for x in told]], "errors": [[summary.errors[x] for x in told]], "total": [summary.n], "_part": [part]})

    rows = items.select(F.col(item).cast("string").alias("item")).where("item IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    held = rows.groupBy("shard").applyInPandasWithState(update, "shard int, held array<string>, counts array<long>, errors array<long>, total long, _part long", "state binary", "update", GroupStateTimeout.NoTimeout)
    final = _latest(spark, drained(spark, held, "update"), "shard")
    each = final.select("total", F.explode(F.arrays_zip("held", "counts", "errors")).alias("z"))
    return each.select(F.col("z.held").alias("item"), F.col("z.counts").alias("count"), F.col("z.errors").alias("error"), "total")


def frequent(spark: SparkSession, stream: DataFrame, stored: DataFrame, item: str, share: float, counters: int = COUNTERS, shards: int = SHARDS) -> DataFrame:
    """(item, n): every item that makes up more than share of stored, found in its stream and counted in a second pass.

    The second pass counts items that the summaries hold alone, so it shuffles a bounded number. share has to be above
    1 / counters: an item of more than share of all is more than that of its shard.
    """
    if share * counters < 1:
        raise ValueError("share must be at least 1 / counters")
    held = streamed_summary(stream, item, counters, shards).select("item")
    rows = stored.select(F.col(item).cast("string").alias("item")).where("item IS NOT NULL")
    total = rows.count()
    counts = rows.join(F.broadcast(held), "item").groupBy("item").agg(F.count("*").alias("n"))  # counters * shards at most
    return counts.where(F.col("n") > share * total)
