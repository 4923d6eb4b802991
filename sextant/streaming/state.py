"""Stateful streaming rules whose results don't hang on the order of arrival: rows wait until the watermark has passed them.

``transformWithState`` processors: what waits, and what a rule keeps of a key, are arrays in value states, read and written once a key
and batch; event-time timers let rows go in order, close what has gone quiet and drop what nobody will ask for. The session
needs the RocksDB state store (``needs_rocksdb``). Rows that come after the watermark has passed them are left out of
``recent_counts`` and ``quiet_sessions`` and counted by ``arrival_counts``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "us array<long>, seq array<long>, mark array<boolean>"


def needs_rocksdb(spark: SparkSession) -> None:
    """Set the state store that these rules need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _array(values: Any, kind: type = np.int64) -> np.ndarray:
    return np.asarray([] if values is None else values, kind)


class _InOrder(StatefulProcessor):
    """Rows (us, seq, mark) of a key go to ``follow`` in the order of (us, seq) once the watermark has passed them."""

    STATE, EMPTY = "times array<long>", ([],)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.kept = handle.getValueState("waiting", WAITING), handle.getValueState("kept", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))
        held = self.waiting.get() if self.waiting.exists() else ([], [], [])
        passed = timerValues.getCurrentWatermarkInMs()
        us = fresh["us"].to_numpy(np.int64)
        real = us > passed * 1000
        merged = [np.concatenate([_array(h, kind), fresh[c].to_numpy(kind)[real]]) for h, c, kind in zip(held, ("us", "seq", "mark"), (np.int64, np.int64, bool), strict=True)]
        yield self._go(key, merged, passed)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.waiting.get() if self.waiting.exists() else ([], [], [])
        yield self._go(key, [_array(held[0]), _array(held[1]), _array(held[2], bool)], timerValues.getCurrentWatermarkInMs())

    def _go(self, key: Any, waiting: list[np.ndarray], passed: int) -> pd.DataFrame:
        order = np.lexsort((waiting[1], waiting[0]))
        us, seq, mark = (w[order] for w in waiting)
        n = int(np.searchsorted(us, passed * 1000, "right"))
        kept = self.kept.get() if self.kept.exists() else self.EMPTY
        out, kept, until = self.follow(kept, us[:n], seq[:n], mark[:n], passed * 1000)
        if kept is None:
            self.kept.clear()
        else:
            self.kept.update(kept)
        if n < len(us):
            self.waiting.update((us[n:].tolist(), seq[n:].tolist(), mark[n:].tolist()))
        else:
            self.waiting.clear()
        due = [-(-int(t) // 1000) for t in ([us[n]] if n < len(us) else []) + ([until] if kept is not None else [])]
        if due:
            self.handle.registerTimer(max(min(due), passed + 1))
        return out.assign(key=key[0])[["key", *out.columns]]

    def follow(self, kept: tuple, us: np.ndarray, seq: np.ndarray, mark: np.ndarray, passed: int) -> tuple[pd.DataFrame, tuple | None, int]:
        """What the rows give; what is kept from now on, if anything; and until when."""
        raise NotImplementedError


class _Recent(_InOrder):
    def __init__(self, span: int) -> None:
        self.span = span

    def follow(self, kept, us, seq, mark, passed):
        times = np.concatenate([_array(kept[0]), us])
        place = np.arange(len(times) - len(us), len(times))
        held = place + 1 - np.searchsorted(times, us - self.span, "right")
        live = times[times > passed - self.span]
        out = pd.DataFrame({"seq": seq, "ts": pd.to_datetime(us, unit="us"), "held": held.astype(np.int64)})
        return out, (live.tolist(),) if len(live) else None, int(live[-1]) + self.span if len(live) else 0


class _Sessions(_InOrder):
    STATE, EMPTY = "first long, last long, n long, at long", (0, 0, 0, 0)

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def follow(self, kept, us, seq, mark, passed):
        first, last, n, at = map(int, kept)
        done = []
        # between marked rows less than ``quiet`` apart nothing happens, so only the ends of such runs are looked at
        apart = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]) | (np.diff(us) >= self.quiet)]) if len(us) else np.zeros(0, np.int64)
        for a, b in zip(apart.tolist(), [*apart.tolist(), len(us)][1:] if len(us) else [], strict=True):
            if n and (us[a] - at >= self.quiet or not mark[a]):
                done.append((first, last, n, "quiet" if us[a] - at >= self.quiet else "good"))
                n = 0
            if mark[a]:
                first, last, n, at = (int(seq[a]) if n == 0 else first), int(seq[b - 1]), n + b - a, int(us[b - 1])
        if n and passed - at >= self.quiet:
            done.append((first, last, n, "quiet"))
            n = 0
        return pd.DataFrame(done, columns=["first", "last", "n", "ended_by"]), (first, last, n, at) if n else None, at + self.quiet


class _Arrivals(StatefulProcessor):
    """Totals of a key, and the ids that it has seen until they are ``span`` behind the watermark."""

    def __init__(self, span: int) -> None:
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen, self.totals = handle.getMapState("seen", "id string", "us long"), handle.getValueState("totals", "n long, repeated long, backward long, latest long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, repeated, backward, latest = self.totals.get() if self.totals.exists() else (0, 0, 0, np.iinfo(np.int64).min)
        passed = timerValues.getCurrentWatermarkInMs()
        for fresh in rows:
            us = fresh["us"].to_numpy(np.int64)
            before = np.maximum.accumulate(np.r_[latest, us])
            backward += int((us < before[:-1]).sum())
            newest = fresh.groupby("id")["us"].agg(["size", "max"])
            known = [x for x in newest.index if self.seen.containsKey((x,))]
            repeated += int(newest["size"].sum()) - len(newest) + len(known)
            for x, at in newest["max"].items():
                self.seen.updateValue((x,), (int(at),))
            n, latest = n + len(fresh), int(before[-1])
        self.totals.update((n, repeated, backward, latest))
        self.handle.registerTimer(max(passed + 1, (latest + self.span) // 1000 + 1))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "repeated": [repeated], "backward": [backward]})

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = timerValues.getCurrentWatermarkInMs() * 1000 - self.span
        for x in [k for k, v in self.seen.iterator() if v[0] <= old]:
            self.seen.removeKey(x)
        yield pd.DataFrame({"key": [], "n": [], "repeated": [], "backward": []}).astype({"key": object, "n": "int64", "repeated": "int64", "backward": "int64"})


def _run(rows: DataFrame, late: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithStateInPandas(processor, schema, mode, "EventTime")


def _us(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1e6)


def recent_counts(rows: DataFrame, key: str, span: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, seq, ts, held): how many rows of the key lie within ``span`` up to each row, itself included; columns key, seq, ts.

    A buffer that expires: a key's times are kept for ``span`` behind the watermark, then the key holds nothing.
    """
    chosen = rows.select(F.col(key).cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "ts", F.lit(True).alias("mark")).where("ts IS NOT NULL AND key IS NOT NULL")
    return _run(chosen, late, _Recent(_us(span)), "key string, seq long, ts timestamp, held long", "Append")


def quiet_sessions(rows: DataFrame, key: str, bad: str = "bad", quiet: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, first, last, n, ended_by): stretches of consecutive bad rows of a key, by time and then seq, ended by a good row
    or, in event time, by ``quiet`` without a bad one; columns key, seq, ts and ``bad``. An open stretch is four numbers."""
    chosen = rows.select(F.col(key).cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "ts", F.coalesce(bad, F.lit(False)).alias("mark")).where("ts IS NOT NULL AND key IS NOT NULL")
    return _run(chosen, late, _Sessions(_us(quiet)), "key string, first long, last long, n long, ended_by string", "Append")


def arrival_counts(rows: DataFrame, key: str, id_column: str, span: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(key, n, repeated, backward), a row for each key of a batch: rows so far, those whose id came before (and lies no more
    than ``span`` behind the watermark), and those earlier than one that came before them."""
    chosen = rows.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), "ts").where("ts IS NOT NULL AND key IS NOT NULL")
    return _run(chosen, late, _Arrivals(_us(span)), "key string, n long, repeated long, backward long", "Update")


def sliding_counts(rows: DataFrame, cell: list[str], window: str = "2 hours", every: str = "4 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, the columns of ``cell``, n): rows of each cell in windows that begin ``every`` so often."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window, every).alias("w"), *cell).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *cell, "n")
