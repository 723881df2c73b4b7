"""The stateful operators of operators/state.py for streams: circuits, caches and sessions of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.state import SMOOTH, THRESHOLD
from ..sources.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BreakerProcessor(StatefulProcessor):
    """For each key: consecutive failures, when its circuit last opened, trips, and smoothed latency, from (at, seq, ok, value)."""

    def __init__(self, threshold: int = THRESHOLD):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("circuit", "failures INT, opened_at DOUBLE, trips INT, ewma DOUBLE")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        failures, opened, trips, ewma = self.state.get() if self.state.exists() else (0, None, 0, 0.0)
        events = pd.concat(rows).sort_values(["at", "seq"])
        for at, ok, value in zip(events["at"], events["ok"], events["value"]):
            if value > 0:
                ewma = float(value) if ewma == 0 else SMOOTH * float(value) + (1 - SMOOTH) * ewma
            if ok:
                failures, opened = 0, None
            else:
                failures += 1
                if failures >= self.threshold or opened is not None:
                    trips += opened is None
                    opened = float(at)
        self.state.update((int(failures), opened, int(trips), float(ewma)))
        yield pd.DataFrame({"key": [key[0]], "failures": [failures], "opened_at": [opened], "trips": [trips], "ewma": [ewma]}).astype({"failures": "int32", "trips": "int32", "opened_at": "float64"})

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Each key's circuit after each batch of a stream (key, at, seq, ok, value); needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(BreakerProcessor(threshold), "key LONG, failures INT, opened_at DOUBLE, trips INT, ewma DOUBLE", "Update", "None")


def first_requests(events: DataFrame, ttl: str = "5 minutes", at: str = "ts", key: str = "key") -> DataFrame:
    """Requests that no equal one came before within `ttl`: those a cache can't answer."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts", key: str = "key") -> DataFrame:
    """(key, begin, end, events): events of a key with gaps below `gap`; events later than `late` are dropped."""
    found = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events")


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """(begin, end, event_type, events): tumbling windows, or sliding ones if `slide` is given."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    found = events.withWatermark(at, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"))
    return found.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "event_type", "events")


def keep_latest(updates: DataFrame, table: KeyedTable, source: str = "stream") -> DataStreamWriter:
    """A writer that merges each batch of a stream into a table of each key's last row. A batch adds its own rows only; files are
    merged after some tens of batches, and a batch that is run again is left out."""
    return table.sink(updates, source)
