"""Streams that keep state for each key: ranks, verdicts and behaviour windows, with timers that forget silent keys.

Every processor keeps its values in named state variables and one event-time timer, which
each row moves on; when the watermark passes it the key is forgotten, so state is bounded by the keys of
the last `ttl_days` days.  Rows behind the watermark or older than a key's state change nothing.
They need the RocksDB state store: `use_rocksdb` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


class Forgetting(StatefulProcessor):
    """A processor whose keys are forgotten `ttl_days` after their last event."""

    def __init__(self, ttl_days: int):
        self.ttl = ttl_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", _fields(at=T.LongType()))
        self.variables()

    def renew(self, newest_ms: int) -> None:
        """Moves the timer to ttl after the newest event."""
        now = self.due.get()[0] if self.due.exists() else None
        due = newest_ms + self.ttl
        if now is None or due > now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by)


RANK = "site_id string, keyword string, last_position bigint, previous_position bigint, best_position bigint, checked_at timestamp"


class RankState(Forgetting):
    """Last, previous and best position; failed checks, and checks older than the last, change nothing."""

    def variables(self) -> None:
        self.rank = self.handle.getValueState("rank", _fields(last=T.LongType(), previous=T.LongType(), best=T.LongType()))
        self.at = self.handle.getValueState("at", _fields(us=T.LongType()))

    def forget(self) -> None:
        self.rank.clear()
        self.at.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, prev, best = self.rank.get() if self.rank.exists() else (None, None, None)
        at = self.at.get()[0] if self.at.exists() else -1
        for r in _sorted(rows, ["checked_at", "check_id"]).itertuples():
            us = r.checked_at.value // 1000
            if r.error is not None or us < at:
                continue
            now = None if pd.isna(r.position) else int(r.position)
            last, prev, at = now, last, us
            best = now if best is None else best if now is None else min(best, now)
        if at >= 0:
            self.rank.update((last, prev, best))
            self.at.update((at,))
            self.renew(at // 1000)
            number = lambda x: pd.array([x], "Int64")
            yield pd.DataFrame({"site_id": [key[0]], "keyword": [key[1]], "last_position": number(last), "previous_position": number(prev), "best_position": number(best), "checked_at": [pd.Timestamp(at * 1000)]})


VERDICT = "question string, engine string, verdict string, errors bigint"


class VerdictState(Forgetting):
    """The verdict of the newest sound check, and how many failed."""

    def variables(self) -> None:
        self.verdict = self.handle.getValueState("verdict", _fields(verdict=T.StringType(), us=T.LongType()))
        self.errors = self.handle.getValueState("errors", _fields(n=T.LongType()))

    def forget(self) -> None:
        self.verdict.clear()
        self.errors.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        verdict, at = self.verdict.get() if self.verdict.exists() else (None, -1)
        errors, newest = self.errors.get()[0] if self.errors.exists() else 0, at
        for r in _sorted(rows, ["checked_at", "check_id"]).itertuples():
            us = r.checked_at.value // 1000
            newest = max(newest, us)
            if r.error is not None:
                errors += 1
            elif us >= at:
                verdict, at = r.verdict, us
        self.verdict.update((verdict, at))
        self.errors.update((errors,))
        self.renew(newest // 1000)
        yield pd.DataFrame({"question": [key[0]], "engine": [key[1]], "verdict": [verdict], "errors": [errors]})


BEHAVIOR = "key string, last_day date, days bigint, sessions bigint, rage_clicks bigint, scroll bigint"


PULLS = ["pulled_at", "sessions", "rage_clicks", "scroll"]
#: Pulls that a task holds before it gives them out.
PULLS_AT_ONCE = 20_000


def _latest(pulls: pd.DataFrame) -> pd.DataFrame:
    """The latest pull of each key and day."""
    t = pulls.iloc[np.lexsort([pulls[c].to_numpy() for c in reversed(PULLS)])]
    return t[~t.assign(day=t["pulled_at"].dt.normalize()).duplicated(["key", "day"], keep="last").to_numpy()]


def latest_pulls(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's pulls without those that a later one of the same key and day replaces; what is held between pieces is bounded."""
    held = None
    for piece in pieces:
        held = _latest(piece if held is None else pd.concat([held, piece]))
        if len(held) >= PULLS_AT_ONCE:
            yield held
            held = None
    if held is not None:
        yield held


class BehaviorWindow(Forgetting):
    """The latest pull of each day of the window that ends at a key's last day; a later pull of a day replaces an earlier one."""

    def __init__(self, days: int, ttl_days: int):
        super().__init__(ttl_days)
        self.days = days

    def variables(self) -> None:
        self.pulls = self.handle.getMapState("pulls", _fields(day=T.IntegerType()), _fields(us=T.LongType(), sessions=T.LongType(), rage=T.LongType(), scroll=T.LongType()))

    def forget(self) -> None:
        self.pulls.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = {k[0]: tuple(v) for k, v in self.pulls.iterator()}
        held, newest = dict(stored), 0
        for r in rows:  # a piece at a time, and of that only the latest pull of each day
            us = r["pulled_at"].to_numpy("datetime64[ns]").astype("int64") // 1000
            values = [us, *(r[c].to_numpy("int64") for c in PULLS[1:])]
            order = np.lexsort(values[::-1])
            day = us[order] // (1000 * DAY_MS)
            for i in np.flatnonzero(np.append(day[1:] != day[:-1], True)):
                d, pull = int(day[i]), tuple(int(v[order[i]]) for v in values)
                held[d] = max(held.get(d, pull), pull)
            newest = max(newest, int(us.max()))
        last = max(held)
        held = {d: pull for d, pull in held.items() if d > last - self.days}
        # the state is told once of each day that differs: a call is a round trip to the JVM
        for d in stored.keys() - held.keys():
            self.pulls.removeKey((d,))
        for d, pull in held.items():
            if pull != stored.get(d):
                self.pulls.updateValue((d,), pull)
        self.renew(newest // 1000)
        sums = [sum(v[i] for v in held.values()) for i in (1, 2)]
        yield pd.DataFrame({"key": [key[0]], "last_day": [date(1970, 1, 1) + timedelta(days=int(last))], "days": [len(held)], "sessions": [sums[0]], "rage_clicks": [sums[1]], "scroll": [max(v[3] for v in held.values())]})


def _timed(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_rank_state(checks: DataFrame, delay: str = "60 days", ttl_days: int = 400) -> DataFrame:
    """Rank state of every keyword, emitted whenever checks of it arrive; the batch twin is `rank_state`."""
    return _timed(checks, "checked_at", delay).groupBy("site_id", "keyword").transformWithStateInPandas(RankState(ttl_days), RANK, "Update", "EventTime")


def stream_verdict_state(checks: DataFrame, delay: str = "60 days", ttl_days: int = 400) -> DataFrame:
    """Verdict of every (question, engine); an errored check keeps the last one."""
    return _timed(checks, "checked_at", delay).groupBy("question", "engine").transformWithStateInPandas(VerdictState(ttl_days), VERDICT, "Update", "EventTime")


def stream_behavior_window(pulls: DataFrame, days: int = 30, delay: str = "60 days", ttl_days: int = 400) -> DataFrame:
    """Sums of each key (key, pulled_at, sessions, rage_clicks, scroll) over the `days` days that end at its last, one pull a day."""
    rows = pulls.select("key", F.col("pulled_at").cast("timestamp"), *PULLS[1:])
    # the state takes its rows one by one in Python: what a later pull of the task replaces does not get there
    rows = rows.mapInPandas(latest_pulls, rows.schema)
    return _timed(rows, "pulled_at", delay).groupBy("key").transformWithStateInPandas(BehaviorWindow(days, ttl_days), BEHAVIOR, "Update", "EventTime")
