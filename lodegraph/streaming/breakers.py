"""Circuit breakers as keyed state with timers: the streaming twin of replayed logs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodegraph.operators.breaker import HALF_OPEN, OPEN, Breaker, Rule, _with_time, prepared
from lodegraph.streaming.state import _latest
from lodegraph.streaming.twins import _stream, drained

_OUT = "service string, state string, since long, calls long, failures long, rejected long, opened long, seen long, _part long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Breakers(StatefulProcessor):
    """One breaker a service; a timer turns an open one half-open when no call comes."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "breaker binary, seen long, part long")

    def _load(self) -> tuple[Breaker, int, int]:
        if self.held.exists():
            raw, seen, part = self.held.get()
            return pickle.loads(bytes(raw)), seen, part
        return Breaker(self.rule), -1, 0

    def _told(self, name: str, breaker: Breaker, seen: int, part: int) -> Row:
        self.held.update((pickle.dumps(breaker), seen, part))
        return Row(service=name, **dict(zip(("state", "since", "calls", "failures", "rejected", "opened"), breaker.told(), strict=True)), seen=seen, _part=part)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        breaker, seen, part = self._load()
        for r in sorted(rows, key=lambda r: (r.t, r.k)):
            breaker.call(r.t, r.failed)
            seen = max(seen, r.t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if breaker.state == OPEN:
            self.handle.registerTimer((breaker.since + self.rule.reset) // 1000 + 1)
        yield self._told(key[0], breaker, seen, part + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        breaker, seen, part = self._load()
        breaker.at(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield self._told(key[0], breaker, seen, part + 1)

    def close(self) -> None:
        pass


def breakers(spark: SparkSession, path: str, service: str, ts: str, failed: Column, order: str, rule: Rule = Rule(), late: str = "1 hour") -> DataFrame:
    """The columns of breaker.replayed, kept up by a stream of the calls at path and told as of the last call of all.

    Calls of a micro-batch are taken in order; what is there at the start is one micro-batch, so that its files may be in
    any order of time. Needs the RocksDB state store, which is set for this stream alone.
    """
    rows = prepared(_stream(spark, path, None), service, ts, failed, order).withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    held = rows.groupBy("service").transformWithState(_Breakers(rule), _OUT, "Update", "EventTime")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        out = drained(spark, held, "update")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    final = _latest(spark, out, "service")
    last = final.agg(F.max("seen").alias("last"))
    due = F.col("since") + F.lit(rule.reset)
    over = (F.col("state") == OPEN) & (due <= F.col("last"))
    turned = {"since": F.when(over, due).otherwise(F.col("since")), "state": F.when(over, HALF_OPEN).otherwise(F.col("state"))}
    told = final.join(F.broadcast(last)).withColumns(turned)  # both at once, as each asks for the other's old value
    return _with_time(told.select("service", "state", "since", "calls", "failures", "rejected", "opened"))
