"""Streams whose state is kept per key by Spark: exact trailing windows, statuses with a time to live, and merges that late rows can't spoil."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64)


class _Rate(StatefulProcessor):
    """Events of a key, counted when the watermark has passed the end of their bucket of the window's length. One timer a key stands at the end of its first bucket that is open.

    Each batch adds one part with all of a key's rows; a timer settles all buckets that have ended by then at once, and keeps what is open and one window before it. Parts that lose no row aren't rewritten.
    """

    def __init__(self, window: int, limit: int, key: str, ident: str):
        self.window, self.limit, self.key, self.ident = window, limit, key, ident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part long", f"times binary, ids array<{self.ident}>")
        self.known = handle.getValueState("known", "n long, settled long, due long")  # parts so far, the time before which events are counted, the timer

    def _end(self, at: int) -> int:
        return (at // self.window + 1) * self.window

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, settled, due = self.known.get() if self.known.exists() else (0, None, None)
        had = due
        for part in rows:
            at = _micros(part["ts"])
            self.parts.updateValue((n,), (at.tobytes(), part["event_id"].to_numpy().tolist()))
            n, first = n + 1, self._end(int(at.min()))
            due = first if due is None else min(due, first)
        self._wait(had, n, settled, due)
        return iter(())

    def _wait(self, had: int | None, n: int, settled: int | None, due: int) -> None:
        if due != had:
            if had is not None:
                self.handle.deleteTimer(had // 1000)
            self.handle.registerTimer(due // 1000)
        self.known.update((n, settled, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, settled, _ = self.known.get()
        end = timerValues.getCurrentWatermarkInMs() * 1000 // self.window * self.window
        kept = [(k[0], np.frombuffer(v[0], np.int64), v[1]) for k, v in self.parts.iterator()]
        every = np.concatenate([at for _, at, _ in kept] or [np.zeros(0, np.int64)])
        new = np.flatnonzero((every < end) & (every >= settled) if settled is not None else every < end)
        if len(new):
            times, inorder = every[new], np.sort(every)
            inside = np.searchsorted(inorder, times, "right") - np.searchsorted(inorder, times - self.window, "right")
            over = np.flatnonzero(inside > self.limit)
            if len(over):
                ids = [i for _, _, part in kept for i in part]
                yield pd.DataFrame({self.key: [key[0]] * len(over), "event_id": [ids[k] for k in new[over]], "ts": times[over].astype("datetime64[us]"), "in_window": inside[over]})
        for k, at, ids in kept:
            stay = at >= end - self.window
            if not stay.any():
                self.parts.removeKey((k,))
            elif not stay.all():
                self.parts.updateValue((k,), (at[stay].tobytes(), [ids[j] for j in np.flatnonzero(stay)]))
        if not (every >= end - self.window).any():
            self.known.clear()
            return
        still = every[every >= end]
        self._wait(None, n, end, self._end(int(still.min())) if len(still) else end + self.window)  # at last, when nothing needs the window before

    def close(self) -> None:
        pass


def stream_violations(events: DataFrame, seconds: int, limit: int, key: str, late: str = "1 minute") -> DataFrame:
    """Streaming form of rate_violations: the very events (key, event_id, ts, in_window) that are more than the limit-th in the trailing window of their key.

    Rows may come in any order within `late`. An event is sent when the watermark has passed the bucket of the window's length that holds it.
    """
    kind, ident = (events.schema[c].dataType.simpleString() for c in (key, "event_id"))
    keyed = events.select(key, "ts", "event_id").where("ts is not null").withWatermark("ts", late).groupBy(key)
    return keyed.transformWithStateInPandas(_Rate(seconds * 1_000_000, limit, key, ident), f"`{key}` {kind}, event_id {ident}, ts timestamp, in_window long", "Append", "EventTime")


class _Fresh(StatefulProcessor):
    """The newest verdict of a job, for as long as it lives: by the clock of the stream's event times, or by the machine's."""

    def __init__(self, millis: int, ident: str, by_events: bool):
        self.millis, self.ident, self.by_events = millis, ident, by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = f"at long, check_id {self.ident}, verdict string"
        self.handle = handle
        self.newest = handle.getValueState("newest", schema) if self.by_events else handle.getValueState("newest", schema, ttlDurationMs=self.millis)

    def _row(self, key, at: int, check_id, verdict: str | None) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "verdict": np.array([verdict], dtype=object), "ts": np.array([at], "datetime64[us]"), "check_id": [check_id], "expires_at": np.array([at + self.millis * 1000], "datetime64[us]")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = tuple(self.newest.get()) if self.newest.exists() else None
        now = had
        for part in rows:
            at, idents = _micros(part["ts"]), part["check_id"].to_numpy()
            latest = np.flatnonzero(at == at.max()).tolist()  # of equal times the greatest check_id counts
            k = max(latest, key=idents.__getitem__)
            last = (int(at[k]), idents[k].item() if hasattr(idents[k], "item") else idents[k], part["verdict"].iat[k])
            now = last if now is None or last[:2] > now[:2] else now
        if now == had:
            return
        self.newest.update(now)
        if self.by_events:
            if had is not None:
                self.handle.deleteTimer(had[0] // 1000 + self.millis + 1)
            self.handle.registerTimer(now[0] // 1000 + self.millis + 1)
        yield self._row(key, *now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            at, check_id, _ = self.newest.get()
            self.newest.clear()
            yield self._row(key, at, check_id, None)

    def close(self) -> None:
        pass


def stream_fresh(checks: DataFrame, minutes: int = 30, late: str = "1 minute", by_events: bool = True) -> DataFrame:
    """Streaming form of fresh_status: changes (job_id, verdict, ts, check_id, expires_at) of each job's newest verdict.

    A verdict lives for the minutes after its check. By event times, a row with a null verdict tells that the watermark has passed its end; by the machine's clock
    (by_events false) the state store forgets it without a row, and readers look at expires_at; such a stream runs until it is stopped. A late older check changes nothing. `fresh_at` reads the changes.
    """
    kind, ident = (checks.schema[c].dataType.simpleString() for c in ("job_id", "check_id"))
    checks = checks.select("job_id", "ts", "check_id", "verdict")
    keyed = (checks.withWatermark("ts", late) if by_events else checks).groupBy("job_id")
    return keyed.transformWithStateInPandas(_Fresh(minutes * 60_000, ident, by_events), f"job_id {kind}, verdict string, ts timestamp, check_id {ident}, expires_at timestamp", "Update", "EventTime" if by_events else "ProcessingTime")


def fresh_at(changes: DataFrame, now) -> DataFrame:
    """job_id, verdict, ts of the verdicts that are alive at a time. Rows that tell an end add nothing to expires_at."""
    said = changes.where(F.col("verdict").isNotNull())
    last = said.groupBy("job_id").agg(F.max_by(F.struct("verdict", "ts", "expires_at"), F.struct("ts", "check_id")).alias("x")).select("job_id", "x.*")
    return last.where(F.col("expires_at") >= now).select("job_id", "verdict", "ts")


def merge_observations(obs: DataFrame, key: str, fields: tuple[str, ...], at: str = "verified_at", ident: str = "obs_id") -> DataFrame:
    """One row a key, whatever the order in which observations arrive: what merging them in the order of their times gives. Works on tables and on streams (update mode).

    Each field is the newest official observation's that says something, else the first one's of the others, else empty; verified_at is the newest official time. Ties go by
    ident. Sums of tasks are merged like rows, so a hot key costs one row a task.
    """
    when = F.struct(at, ident)
    official = F.coalesce("is_official", F.lit(False))
    columns = []
    for c in fields:
        says = F.coalesce(c, F.lit("")) != ""
        best = F.max_by(F.when(official & says, F.col(c)), F.when(official & says, when))
        first = F.min_by(F.when(~official & says, F.col(c)), F.when(~official & says, when))
        columns.append(F.coalesce(best, first, F.lit("")).alias(c))
    return obs.groupBy(key).agg(*columns, F.max(F.when(official, F.col(at))).alias(at))
