"""The streaming fold: events are kept by request id until the call is complete.

State holds a request's events as they came; the same batch expressions then derive the call,
so streaming and batch agree. A call is complete when its access line has come; when its bill
has come and it has been quiet for SETTLE seconds, by the clock or by its log's own times; or,
stalled, after STALL seconds without a line. Lines that come after that, for GONE seconds, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from logloom.functions.scalars import epoch_of
from logloom.operators.calls import worth_keeping
from logloom.operators.fold import derived, gathered, with_chunks
from logloom.sources.store import Store

SETTLE, STALL, GONE = 15.0, 600.0, 3600.0
_EVENT = ("ord", "file", "level", "ts", "rid", "msg", "kind", "body", "status", "access_kind", "latency", "ip", "method", "path", "stream_end", "error")
#: transformWithState needs this state store.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Collect(StatefulProcessor):
    """Holds events as JSON texts of one request and lets them go together.

    Events are only appended; what decides when they go is kept apart, in a few numbers.
    """

    def __init__(self, settle: float = SETTLE, stall: float = STALL, gone: float = GONE):
        self.settle, self.stall, self.gone = settle, stall, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", StructType([StructField("event", StringType())]))
        self.seen = handle.getValueState("seen", "billed boolean, last bigint")
        self.done = handle.getValueState("done", "at bigint", int(1000 * self.gone))

    def _let_go(self, key: tuple, now: int, stalled: bool) -> Iterator[pd.DataFrame]:
        events = [r[0] for r in self.events.get()]
        self.events.clear()
        self.seen.clear()
        self.done.update((now,))
        yield pd.DataFrame({"rid": [key[0]] * len(events), "event": events, "stalled": [stalled] * len(events)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if self.done.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        billed, last = self.seen.get() if self.seen.exists() else (False, 0)
        over = False
        for part in parts:
            self.events.appendList([(e,) for e in part["event"]])
            kinds = set(part["kind"])
            over, billed = over or "access" in kinds, billed or "billing" in kinds
            last = max(last, int(part["epoch"].max()))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if over or billed and 0 < 1000 * last <= now - 1000 * self.settle:
            yield from self._let_go(key, now, False)
            return
        self.seen.update((billed, last))
        self.handle.registerTimer(now + int(1000 * (self.settle if billed else self.stall)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            yield from self._let_go(key, timerValues.getCurrentProcessingTimeInMs(), not self.seen.get()[0])

    def close(self) -> None:
        pass


def complete(events: DataFrame, settle: float = SETTLE, stall: float = STALL, gone: float = GONE) -> DataFrame:
    """rid, event (JSON), stalled: the events of calls as they become complete."""
    kind = F.when((F.col("kind") == "billing") & F.col("body").isNull(), "other").otherwise(F.col("kind"))
    held = events.select("rid", kind.alias("kind"), epoch_of(F.col("ts")).alias("epoch"), F.to_json(F.struct(*_EVENT)).alias("event"))
    return held.groupBy("rid").transformWithStateInPandas(statefulProcessor=Collect(settle, stall, gone), outputStructType="rid string, event string, stalled boolean", outputMode="append", timeMode="ProcessingTime")


def calls_of(batch: DataFrame, events_schema: StructType, pod: str = "") -> DataFrame:
    """Calls from one batch of complete()."""
    rows = batch.select(F.from_json("event", events_schema).alias("e"), "stalled").select("e.*", "stalled")
    stalls = batch.groupBy("rid").agg(F.bool_or("stalled").alias("stalled"))
    return derived(gathered(with_chunks(rows.drop("stalled"))).join(stalls, "rid"), F.col("stalled"), pod)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings that a query takes over when it starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_calls(events: DataFrame, store: Store, checkpoint: str, pod: str = "", settle: float = SETTLE, stall: float = STALL, gone: float = GONE, **trigger) -> StreamingQuery:
    """A running query that appends complete calls to a store; a batch that is run again adds nothing.

    With availableNow it ends when all that is there has been read. While a state has timers by
    the clock Spark would run empty batches without end, so these are off then: calls that are
    not complete wait in the checkpoint for the next run.
    """
    schema = events.select(*_EVENT).schema
    once = bool(trigger.get("availableNow") or trigger.get("once"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        calls = worth_keeping(calls_of(batch, schema, pod)).withColumn("append_seq", F.lit(number).cast("bigint"))
        store.append_new(calls)
        batch.unpersist()

    writer = complete(events, settle, stall, gone).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"}))
    with _settings(events.sparkSession, {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(not once).lower()}):
        return writer.start()
