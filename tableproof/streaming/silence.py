"""Databases that go quiet, told by a timer of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tableproof.functions import names as N
from tableproof.session import keyed_state

OUTPUT = "db string, stamp string, status string"
DAY_MS = N.DAY * 1000


class _Silence(StatefulProcessor):
    """One row of state and one timer per database: its newest stamp, and when that will be too old."""

    def __init__(self, days: int, lag_ms: int):
        self.days, self.lag_ms = days, lag_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "stamp string, at_ms bigint, due_ms bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, stamp = max((int(ms), s) for part in rows for ms, s in zip(part["at_ms"], part["stamp"], strict=True))
        held = self.newest.get() if self.newest.exists() else None
        if held is None or at > held[1]:
            # strictly older than the limit is stale, and stamps are whole seconds
            due = at + self.days * DAY_MS + 1 - self.lag_ms
            if held is not None and not held[3]:
                self.handle.deleteTimer(held[2])
            self.handle.registerTimer(due)
            self.newest.update((stamp, at, due, False))
            if held is not None and held[3]:
                yield pd.DataFrame([(key[0], stamp, "BACK")], columns=["db", "stamp", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stamp, at, due, told = self.newest.get()
        if not told:
            self.newest.update((stamp, at, due, True))
            yield pd.DataFrame([(key[0], stamp, "SILENT")], columns=["db", "stamp", "status"])

    def close(self) -> None:
        pass


def stream_silence(names: DataFrame, days: int, late_days: int = 0) -> DataFrame:
    """``db, stamp, status`` once when a database's newest stamp has become older than ``days`` (SILENT), and once when a
    newer one arrives after that (BACK). ``append`` output.

    ``names``: ``name`` rows as they arrive. No row has to come from the database that is told of: its timer stands
    in the state, and the clock is the newest stamp that any database has sent (a watermark, so a replay of old
    names gives the answers of their own time). ``late_days``: how far behind that clock a name may arrive and still
    count; older ones are dropped, and neither they nor late names ever lower a newest stamp. When every database
    falls silent at once the clock stands still too: watch the stream itself for that."""
    keyed_state(names.sparkSession)
    stamp = N.artefact_stamp(F.col("name"))
    stamped = names.select(N.artefact_db(F.col("name")).alias("db"), stamp.alias("stamp"), N.stamp_epoch(stamp).alias("at")).filter("stamp IS NOT NULL")
    timed = stamped.select("db", "stamp", (F.col("at") * 1000).cast("bigint").alias("at_ms"), F.timestamp_seconds("at").alias("taken"))
    return timed.withWatermark("taken", f"{late_days} days").groupBy("db").transformWithStateInPandas(
        statefulProcessor=_Silence(days, late_days * DAY_MS), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
