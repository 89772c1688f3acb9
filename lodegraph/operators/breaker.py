"""Circuit breakers replayed from logs of calls: closed, open and half-open, call by call.

A service's calls are folded in order by one task, since each state follows from the one before; what the task holds is
the rolling window of one service, so a service of any size streams through. Services are dealt over all tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the names of the states
CLOSED, OPEN, HALF_OPEN = "closed", "open", "half-open"


@dataclass(frozen=True)
class Rule:
    """Open when, of volume calls or more in the last window microseconds, threshold or more failed; try again after reset."""

    window: int = 10_000_000
    reset: int = 30_000_000
    volume: int = 5
    threshold: float = 0.5


@dataclass
class Breaker:
    """One service's breaker: its state, since when, the calls of its window, and counters."""

    rule: Rule
    state: str = CLOSED
    since: int = -1
    calls: int = 0
    failures: int = 0
    rejected: int = 0
    opened: int = 0
    recent: deque = field(default_factory=deque)
    bad: int = 0

    def at(self, t: int) -> str:
        """The state at t: an open breaker is half-open from the reset on."""
        if self.state == OPEN and t >= self.since + self.rule.reset:
            self.state, self.since = HALF_OPEN, self.since + self.rule.reset
        return self.state

    def call(self, t: int, failed: bool) -> None:
        """A call at t, not before the last one: rejected while open, a trial while half-open."""
        if self.at(t) == OPEN:
            self.rejected += 1
            return
        self.calls += 1
        self.failures += failed
        if self.state == HALF_OPEN:
            self._turn(OPEN if failed else CLOSED, t)
            return
        while self.recent and self.recent[0][0] <= t - self.rule.window:
            self.bad -= self.recent.popleft()[1]
        self.recent.append((t, failed))
        self.bad += failed
        if failed and len(self.recent) >= self.rule.volume and self.bad >= self.rule.threshold * len(self.recent):
            self._turn(OPEN, t)

    def _turn(self, state: str, t: int) -> None:
        self.state, self.since, self.bad = state, t, 0
        self.recent.clear()
        self.opened += state == OPEN

    def told(self) -> tuple:
        return self.state, self.since, self.calls, self.failures, self.rejected, self.opened


_TOLD = ("state", "since", "calls", "failures", "rejected", "opened")
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def prepared(calls: DataFrame, service: str, ts: str, failed: Column, order: str) -> DataFrame:
    """(service string, t in microseconds, failed, k) of calls; rows without a service or time are left out, a null failed is a success."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return calls.select(F.col(service).cast("string").alias("service"), t.alias("t"), F.coalesce(failed, F.lit(False)).alias("failed"), F.col(order).cast("long").alias("k")).where("service IS NOT NULL AND t IS NOT NULL")


def replayed(calls: DataFrame, service: str, ts: str, failed: Column, order: str, rule: Rule = Rule()) -> DataFrame:
    """(service, state, since, calls, failures, rejected, opened): every breaker at the instant of the last call of all.

    since is null for a breaker that has never left its first state. Calls of one instant stand by order.
    """
    rows = prepared(calls, service, ts, failed, order)
    last = rows.agg(F.max("t")).first()[0]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, breaker = None, Breaker(rule)
        for batch in batches:
            out: list[tuple] = []
            for own, t, bad in zip(*(batch.column(c).to_pylist() for c in ("service", "t", "failed")), strict=True):
                if own != name:
                    if name is not None:
                        breaker.at(last)
                        out.append((name, *breaker.told()))
                    name, breaker = own, Breaker(rule)
                breaker.call(t, bad)
            yield _batch(out)
        if name is not None:
            breaker.at(last)
            yield _batch([(name, *breaker.told())])

    dealt = rows.repartition("service").sortWithinPartitions("service", "t", "k")
    found = dealt.mapInArrow(fold, "service string, state string, since long, calls long, failures long, rejected long, opened long")
    return _with_time(found)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * (1 + len(_TOLD))
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, (pa.string(), *_KINDS), strict=True)], names=["service", *_TOLD])


def _with_time(found: DataFrame) -> DataFrame:
    return found.withColumn("since", F.when(F.col("since") >= 0, F.timestamp_micros("since")))
