"""Flags with a time to live, and flags that are used once, as state of a stream.

A ping keeps a flag wanted for some seconds; who asks learns whether it is. A request stands until someone takes it; of all
who try, one gets it. Both are one state by flag, kept by transformWithState; a timer in event time drops what has run out and
says so, so that flags nobody asks for any more take no room.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.session import share_path

#: How long a ping keeps a flag, in seconds.
TTL = 150.0
PING, ASK, REQUEST, TAKE, EXPIRED = "ping", "ask", "request", "take", "expired"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Flags(StatefulProcessor):
    """until: the microsecond from which on the flag is not wanted; standing: whether a request waits."""

    def __init__(self, ttl: float):
        self.ttl = round(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")
        self.standing = handle.getValueState("standing", "standing boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until, standing = (self.until.get()[0] if self.until.exists() else None), self.standing.exists()
        before, out = until, []
        p = pd.concat(list(rows)).sort_values(["at", "id"])
        for at, number, what in zip(p["at"].tolist(), p["id"].tolist(), p["what"], strict=True):
            if what == PING:
                until = max(until or at, at + self.ttl)
            elif what == ASK:
                out.append((key[0], number, what, until is not None and at < until))
            elif what == REQUEST:
                standing = True
            elif what == TAKE:
                out.append((key[0], number, what, standing))
                standing = False
        if until != before:
            self.until.update((until,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-until // 1000))  # timers count milliseconds
        if standing and not self.standing.exists():
            self.standing.update((True,))
        elif not standing and self.standing.exists():
            self.standing.clear()
        yield pd.DataFrame(out, columns=["flag", "id", "what", "wanted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.until.clear()
        yield pd.DataFrame([(key[0], None, EXPIRED, False)], columns=["flag", "id", "what", "wanted"]).astype({"id": "Int64"})


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as transformWithState asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def flags(events: DataFrame, flag: str, what: Column, number: str, ts: str = "ts", ttl: float = TTL, late: str = "0 seconds") -> DataFrame:
    """flag, id, what, wanted: an answer for each ask and each take, and a row when a flag runs out.

    what is one of ping, ask, request, take; other rows and rows without a moment are left out. A ping counts from its moment
    up to, not at, ttl seconds later; a later ping prolongs it. Rows of a flag are taken by moment, then number; micro-batches must
    come in that order, rows later than late behind the newest are dropped. Streams of this need the state store STORE, see
    rocks().
    """
    share_path(events.sparkSession)
    rows = events.withColumn("what", what).filter(F.col("what").isin(PING, ASK, REQUEST, TAKE) & F.col(ts).isNotNull())
    rows = rows.withWatermark(ts, late).select(F.col(flag).alias("flag"), F.col(ts).alias("moment"), F.unix_micros(ts).alias("at"), F.col(number).cast("long").alias("id"), "what")
    kind = events.schema[flag].dataType.simpleString()
    out = rows.groupBy("flag").transformWithStateInPandas(Flags(ttl), f"flag {kind}, id long, what string, wanted boolean", "append", "EventTime")
    return out.withColumnRenamed("flag", flag)
