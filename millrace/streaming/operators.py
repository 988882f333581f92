"""Operators on streams. Event times are cast to timestamps with a zone, which watermarks need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def timed(stream: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def windowed(stream: DataFrame, by: list[str], size: str, slide: str | None = None, at: str = "ts") -> DataFrame:
    """Counts by window and key: begin, end, keys, n."""
    cell = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.groupBy(cell.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *by, "n")


def session_counts(stream: DataFrame, by: list[str], gap: str, at: str = "ts") -> DataFrame:
    return stream.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *by, "n")


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys haven't come within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, after: str) -> DataFrame:
    """Pairs of two streams in which the right row comes at most `after` later. Columns have different names."""
    left, right = timed(left, left_at), timed(right, right_at)
    at_a, at_b = F.col(left_at), F.col(right_at)
    return left.join(right, (F.col(key) == F.col(f"{key}_right")) & (at_b >= at_a) & (at_b <= at_a + F.expr(f"interval {after}")))


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """(key, n): the number of rows so far, held in state of one number for each key."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        state.update((n,))
        yield pd.DataFrame({key: [keys[0]], "n": [n]})

    return stream.select(key).groupBy(key).applyInPandasWithState(step, f"{key} bigint, n bigint", "n bigint", "update", "NoTimeout")


class Idle(StatefulProcessor):
    """Counts the rows of a key, and gives the count when none has come for some days of event time."""

    def __init__(self, key: str, at: str, days: int) -> None:
        self.key, self.at, self.millis = key, at, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "n bigint, last timestamp, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, last, timer = self.seen.get() if self.seen.exists() else (0, None, None)
        for part in rows:
            n, latest = n + len(part), part[self.at].max().to_pydatetime()
            last = latest if last is None else max(last, latest)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(pd.Timestamp(last).timestamp() * 1000) + self.millis
        self.handle.registerTimer(timer)
        self.seen.update((n, last, timer))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, last, _ = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "last": [last]})

    def close(self) -> None:
        pass


def idle_counts(stream: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """(key, n, last): the rows of a key, given once it has been idle for `days`; then its state ends. Needs a watermark
    and RocksDB state."""
    rows = stream.select(key, at).groupBy(key)
    return rows.transformWithStateInPandas(Idle(key, at, days), f"{key} bigint, n bigint, last timestamp", "append", "EventTime")


class Kinds(StatefulProcessor):
    """Counts the rows of each kind of a key in a map; a kind that none has come of for a while is forgotten."""

    def __init__(self, key: str, kind: str, millis: int) -> None:
        self.key, self.kind, self.millis = key, kind, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"{self.kind} string", "n bigint", self.millis)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        new: dict[str, int] = {}
        for part in rows:
            for kind, n in part[self.kind].value_counts().items():
                new[kind] = new.get(kind, 0) + int(n)
        for kind, n in new.items():
            if self.seen.containsKey((kind,)):
                n += self.seen.getValue((kind,))[0]
            self.seen.updateValue((kind,), (n,))
            new[kind] = n
        yield pd.DataFrame({self.key: [key[0]] * len(new), self.kind: list(new), "n": list(new.values())})

    def close(self) -> None:
        pass


def kind_counts(stream: DataFrame, key: str, kind: str, hours: float) -> DataFrame:
    """(key, kind, n): the rows so far of each kind of a key, given for the kinds that a batch has. A kind's entry lives for
    `hours` of processing time after its last row, so that state is bounded by what came in that time. Null kinds don't
    count. Needs RocksDB state; `state_of` reads it."""
    rows = stream.select(key, kind).groupBy(key)
    return rows.transformWithStateInPandas(Kinds(key, kind, int(hours * 3_600_000)), f"{key} bigint, {kind} string, n bigint", "update", "ProcessingTime")


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The entries of a named state as the last batch has left them, by the state data source."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
