"""Stateful streaming with event-time timers: sessions that expire, and one vote per response.

State lives in Spark's state store under the key's own partition; a timer for a session or an undecided vote fires once the
watermark has passed it. A user has one timer, for the session that closes first. Rows later than the watermark are dropped by Spark before they get here. What is still open when a
run ends stays in state, goes on in the next run from the same checkpoint, and can be read with ``open_sessions`` and
``open_votes``; no row has to be made up to close it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SESSION = "user_id string, opened timestamp, closed timestamp, n bigint"
VOTE = "response_id string, ts timestamp, vote string"
#: The store that keeps timers and several kinds of state apart.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def _after(micros: int) -> int:
    """The first whole millisecond not before a time in microseconds."""
    return -(-micros // 1000)


class Sessions(StatefulProcessor):
    """Open sessions of one user: (first, last, n) in microseconds, apart by ``gap`` at least. A session closes ``gap`` after its
    last event; one that comes in between two sessions, out of order but not late, joins them."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.open.get()]
        merged = held
        for part in rows:
            several: list[tuple[int, int, int]] = []
            for first, last, n in sorted(merged + [(t, t, 1) for t in _micros(part["ts"])]):
                if several and first < several[-1][1] + self.gap:
                    was = several.pop()
                    several.append((was[0], max(was[1], last), was[2] + n))
                else:
                    several.append((first, last, n))
            merged = several
        self.open.put(merged)
        self._wait_for_first(held, merged)
        return iter(())

    def _wait_for_first(self, before: list[tuple], now: list[tuple]) -> None:
        """One timer a user, for the session that closes first."""
        old, new = (_after(s[0][1] + self.gap) if s else None for s in (before, now))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.open.get()]
        over = [s for s in held if _after(s[1] + self.gap) <= passed]
        left = held[len(over):]  # in order of their ends
        if left:
            self.open.put(left)
            self.handle.registerTimer(_after(left[0][1] + self.gap))
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame({
                "user_id": key[0], "opened": pd.to_datetime([s[0] for s in over], unit="us"),
                "closed": pd.to_datetime([s[1] + self.gap for s in over], unit="us"), "n": [s[2] for s in over]})

    def close(self) -> None:
        pass


class FirstVotes(StatefulProcessor):
    """The earliest vote of a response. It is decided once the watermark has passed it, since no earlier one can come then, and
    remembered for ``memory`` after it, so that later votes are not counted."""

    def __init__(self, memory_us: int):
        self.memory = memory_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ts bigint, tie bigint, vote string, decided boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.first.get()) if self.first.exists() else None
        if held is None or not held[3]:
            votes = [(t, int(i), v, False) for part in rows for t, i, v in zip(_micros(part["ts"]), part["tie"], part["vote"])]
            best = min(votes + ([held] if held else []))
            if best != held:
                if held:
                    self.handle.deleteTimer(_after(held[0]))
                self.first.update(best)
                self.handle.registerTimer(_after(best[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, tie, vote, decided = tuple(self.first.get())
        if decided:
            self.first.clear()
        else:
            self.first.update((ts, tie, vote, True))
            self.handle.registerTimer(_after(ts + self.memory))
            yield pd.DataFrame({"response_id": [key[0]], "ts": pd.to_datetime([ts], unit="us"), "vote": [vote]})

    def close(self) -> None:
        pass


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def expiring_sessions(events: DataFrame, delay: str = "1 hour", gap_minutes: int = 30) -> DataFrame:
    """user_id (string), opened, closed, n: sessions whose documents expire, each once. ``events``: a stream with ts, user_id.

    Rows without user or time belong to no session.
    """
    rows = _timed(events.filter("user_id is not null and ts is not null"), delay).select(F.col("user_id").cast("string").alias("user_id"), "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(
        Sessions(gap_minutes * 60_000_000), outputStructType=SESSION, outputMode="Append", timeMode="EventTime")


def first_votes(votes: DataFrame, delay: str = "1 hour", memory_days: int = 30) -> DataFrame:
    """response_id, ts, vote: the earliest vote of each response, once. ``votes``: a stream with ts, tie, response_id, vote.

    ``tie`` orders votes of one instant. Rows without response or time are no votes.
    """
    rows = _timed(votes.filter("response_id is not null and ts is not null"), delay).select(
        F.col("response_id").cast("string").alias("response_id"), "ts", F.col("tie").cast("bigint").alias("tie"), "vote")
    return rows.groupBy("response_id").transformWithStateInPandas(
        FirstVotes(memory_days * 86_400_000_000), outputStructType=VOTE, outputMode="Append", timeMode="EventTime")


def drain(stream: DataFrame, path: str, per_batch: str = "append") -> None:
    """Runs an append-mode stream of this module over what is there now, into the files of ``path``/out.

    The state store named here holds for this query: a query keeps the store that it starts with.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(key, None)
    conf.set(key, STATE_STORE)
    try:
        query = (stream.writeStream.outputMode(per_batch).format("parquet").option("path", f"{path}/out")
                 .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    finally:
        conf.unset(key) if old is None else conf.set(key, old)
    query.awaitTermination()


def _state(spark: SparkSession, path: str, variable: str, flat: bool) -> DataFrame:
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return (reader.option("flattenCollectionTypes", "true") if flat else reader).load(f"{path}/state")


def open_sessions(spark: SparkSession, path: str, gap_minutes: int = 30) -> DataFrame:
    """Like ``expiring_sessions``, the sessions that are still in the state of a run."""
    s = _state(spark, path, "open", True)
    return s.select(s["key"].getField("user_id").alias("user_id"), F.timestamp_micros("list_element.first").alias("opened"),
                    F.timestamp_micros(F.col("list_element.last") + gap_minutes * 60_000_000).alias("closed"), F.col("list_element.n").alias("n"))


def open_votes(spark: SparkSession, path: str) -> DataFrame:
    """Like ``first_votes``, the earliest votes so far that the watermark has not passed."""
    s = _state(spark, path, "first", False)
    return s.filter("not value.decided").select(
        s["key"].getField("response_id").alias("response_id"), F.timestamp_micros("value.ts").alias("ts"), F.col("value.vote").alias("vote"))
