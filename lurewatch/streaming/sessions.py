"""Sessions as keyed state: one account or user per key, timers remove what can no longer change.

State lives in the state store, so a batch costs what its own keys cost. Rows later than ``delay`` behind
the newest one are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lurewatch.operators.sessions import (ADMIN_LOGIN, DAY, LOGIN, LOGOUT, NO_SESSION, kind_of)

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_ROWS = 100_000


def keyed(stream: DataFrame, key: str, when: str, delay: str, processor: StatefulProcessor, out: str) -> DataFrame:
    """Run a processor per key in event time; its state needs the store that keeps it outside the heap."""
    conf = stream.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream.withWatermark(when, delay).groupBy(key).transformWithStateInPandas(
        processor, out, "Update", "EventTime")


def _arrays(frames: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """The columns of a key's rows in a batch as number arrays."""
    parts = [[f[c].to_numpy(np.int64) for c in columns] for f in frames]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in columns]


def _set_timer(handle: StatefulProcessorHandle, at: int, watermark: int) -> None:
    """One timer per key, in milliseconds; never in the past."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(max(at, watermark + 1))


class AccountSessions(StatefulProcessor):
    """The expiry of an account's session is all its state; a timer behind the expiry removes it."""

    def __init__(self, key: str, lifetime: int):
        self.key, self.lifetime = key, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "expiry bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sec, ident, kind = _arrays(rows, "sec", "id", "kind")
        order = np.lexsort((ident, sec))
        stored = self.expiry.get()
        expiry = stored[0] if stored is not None else NO_SESSION
        told = []
        for t, k in zip(sec[order].tolist(), kind[order].tolist()):
            if k == LOGOUT:
                outcome, expiry = "logout", NO_SESSION
            elif k == ADMIN_LOGIN or (k == LOGIN and t >= expiry):
                outcome, expiry = "accepted", t + self.lifetime
            elif k == LOGIN:
                outcome = "refused"
            elif t <= expiry:
                outcome, expiry = "valid", t + self.lifetime
            else:
                outcome = "invalid"
            told.append(outcome)
        if expiry == NO_SESSION:
            self.expiry.clear()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        else:
            self.expiry.update((expiry,))
            _set_timer(self.handle, (expiry + 1) * 1000, timerValues.getCurrentWatermarkInMs())
        for lo in range(0, len(told), OUT_ROWS):
            yield pd.DataFrame({self.key: key[0], "id": ident[order][lo:lo + OUT_ROWS], "outcome": told[lo:lo + OUT_ROWS]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.expiry.clear()
        yield from ()


def account_outcomes(stream: DataFrame, user: str = "user_id", when: str = "timestamp", row_id: str = "id",
                     lifetime: int = DAY, delay: str = "1 hour") -> DataFrame:
    """``user``, id and outcome of every account event, by the rule of ``operators.sessions.account_outcomes``.

    Within a batch an account's events count in order of (second, id). A row without user or time
    stands alone, as in the table rule. A batch's rows of one account meet in one task, as three
    numbers each.
    """
    typed = dict(stream.dtypes)[user]
    rows = stream.select(user, when, F.col(row_id).cast("bigint").alias("id"),
                         F.unix_seconds(when).alias("sec"), kind_of().cast("bigint").alias("kind"))
    known = F.col(user).isNotNull() & F.col("sec").isNotNull()
    ruled = keyed(rows.filter(known), user, when, delay, AccountSessions(user, lifetime),
                  f"{user} {typed}, id bigint, outcome string")
    alone = F.when(F.col("kind") == LOGOUT, "logout").when(
        F.col("kind").isin(LOGIN, ADMIN_LOGIN), "accepted").otherwise("invalid")
    return ruled.unionByName(rows.filter(~known).select(user, "id", alone.alias("outcome")))


class SlidingSessions(StatefulProcessor):
    """A user's sessions that a row may still reach: first and last request and count, ascending."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState(
            "sessions", "first array<bigint>, last array<bigint>, requests array<bigint>")

    def _stored(self) -> list[np.ndarray]:
        stored = self.sessions.get()
        return [np.asarray(c, np.int64) for c in (stored if stored is not None else ([], [], []))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (at,) = _arrays(rows, "at")
        old = self._stored()
        # Requests and stored sessions alike are spans; spans no further apart than the gap are one session.
        first, last, n = (np.concatenate(c) for c in zip(old, (at, at, np.ones(len(at), np.int64))))
        order = np.argsort(first, kind="stable")
        first, last, n = first[order], last[order], n[order]
        reach = np.maximum.accumulate(last)
        start = np.flatnonzero(np.append(True, first[1:] - reach[:-1] > self.gap))
        made = first[start], np.append(reach[start[1:] - 1], reach[-1]), np.add.reduceat(n, start)
        before = {row[0]: row for row in zip(*(c.tolist() for c in old))}
        now = {row[0]: row for row in zip(*(c.tolist() for c in made))}
        changed = [row for f, row in now.items() if before.get(f) != row]
        gone = [(f, f, 0) for f in before if f not in now]
        self._keep(made, timerValues.getCurrentWatermarkInMs())
        told = changed + gone
        yield pd.DataFrame({self.key: key[0], "started": pd.Series([r[0] for r in told], dtype="int64"),
                            "last_request": pd.Series([r[1] for r in told], dtype="int64"),
                            "requests": pd.Series([r[2] for r in told], dtype="int64")})

    def _keep(self, sessions, watermark: int) -> None:
        """Sessions that no row can reach any more leave the state; the timer waits for the next one."""
        open_ = (sessions[1] + self.gap) // 1000 >= watermark
        kept = [c[open_] for c in sessions]
        if not len(kept[0]):
            self.sessions.clear()
            return
        self.sessions.update(tuple(c.tolist() for c in kept))
        _set_timer(self.handle, (int(kept[1].min()) + self.gap) // 1000 + 1, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._keep(self._stored(), timerValues.getCurrentWatermarkInMs())
        yield from ()


def sliding_sessions(stream: DataFrame, user: str = "user_id", when: str = "timestamp", gap: int = DAY,
                     delay: str = "1 hour") -> DataFrame:
    """Changes of sessions: ``user``, started, last_request, requests; a session that was joined to an
    earlier one comes with 0 requests. Users are not null. ``newest`` reads the sessions back."""
    typed = dict(stream.dtypes)[user]
    rows = stream.select(user, when, F.unix_micros(when).alias("at")).filter(
        F.col(user).isNotNull() & F.col("at").isNotNull())
    told = keyed(rows, user, when, delay, SlidingSessions(user, gap),
                 f"{user} {typed}, started bigint, last_request bigint, requests bigint")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("started", "last_request")})


def newest(written: DataFrame, user: str = "user_id", gap: int = DAY) -> DataFrame:
    """Sessions from the changes that ``runner.to_folder`` wrote: of each session the newest row."""
    last = written.groupBy(user, "started").agg(
        F.max_by(F.struct("last_request", "requests"), "batch").alias("s"))
    return last.filter("s.requests > 0").select(
        user, "started", "s.last_request", "s.requests",
        (F.col("s.last_request") + F.make_dt_interval(secs=F.lit(gap))).alias("expires"))
