"""Streaming twins of the window rules: event time, watermarks, and state that is bounded for each key.

The functions take and give streaming DataFrames; the caller chooses trigger and sink. Late rows beyond the watermark are
dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(rows: DataFrame, late: str, time: str = "ts") -> DataFrame:
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def lightning_cells(strikes: DataFrame, least: int = 10, size: float = 1.0, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Cells of ``size`` degrees with ``least`` strikes or more in a window."""
    cell = [F.floor(F.col("lat") / size).alias("cy"), F.floor(F.col("lon") / size).alias("cx")]
    out = _timed(strikes, late).groupBy(F.window("ts", window).alias("w"), *cell).agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "cy", "cx", "n")


def traffic_points(rows: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    out = _timed(rows, late).groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def without_repeats(rows: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once while its watermark holds it."""
    return _timed(rows, late).dropDuplicatesWithinWatermark(key)


def outage_sessions(rows: DataFrame, key: str = "process", late: str = "1 hour") -> DataFrame:
    """(key, first, last, n) for each stretch of consecutive bad rows that a good row has ended; columns key, seq, bad, ts.

    State is one open stretch a key, whatever its length. Rows of a key are taken in the order of seq within a batch.
    """
    state = "first long, last long, n long"

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = held.get if held.exists else (None, None, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.bad:
                first, last, n = (row.seq if n == 0 else first), row.seq, n + 1
            elif n:
                out.append((k[0], first, last, n))
                first, last, n = None, None, 0
        if n:
            held.update((int(first), int(last), int(n)))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=[key, "first", "last", "n"])

    return _timed(rows.select(key, "seq", "bad", "ts"), late).groupBy(key).applyInPandasWithState(step, f"{key} string, first long, last long, n long", state, "append", GroupStateTimeout.NoTimeout)


def last_values(rows: DataFrame, key: str, value: str, n: int = 20, late: str = "1 hour", quiet: str = "1 day") -> DataFrame:
    """(key, seq, n, mean, sd) for each row: over the key's last ``n`` values up to it, the batch's in the order of seq.

    State is a ring of ``n`` values a key; it goes when the key has been quiet, in event time, for ``quiet``.
    """
    span = pd.Timedelta(quiet)

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        fresh = pd.concat(list(batches)).sort_values("seq")
        before = list(held.get[0]) if held.exists else []
        values = pd.Series([*before, *fresh["value"]], dtype=float)
        window = values.rolling(n, min_periods=1)
        out = pd.DataFrame({"n": window.count(), "mean": window.mean(), "sd": window.std(ddof=0)}).iloc[len(before) :]
        held.update((values.iloc[-n:].tolist(),))
        held.setTimeoutTimestamp(int((fresh["ts"].max() + span).timestamp() * 1000))
        yield out.assign(**{key: k[0], "seq": fresh["seq"].to_numpy(), "n": out["n"].astype("int64")})[[key, "seq", "n", "mean", "sd"]]

    timed = _timed(rows.select(F.col(key).cast("string").alias(key), "seq", F.col(value).cast("double").alias("value"), "ts").where("value IS NOT NULL"), late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} string, seq long, n long, mean double, sd double", "ring array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown_alerts(rows: DataFrame, key: str, seconds: float, late: str = "1 hour") -> DataFrame:
    """(key, seq, ts) of the rows that raise an alert: a key's first, and each ``seconds`` or more after its last alert.

    State is the time of a key's last alert, kept until the watermark has passed it by ``seconds``. The streaming twin of
    the batch rule for rows that come in the order of time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        fresh = pd.concat(list(batches)).sort_values(["ts", "seq"])
        times = fresh["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        last, at, chosen = held.get[0] if held.exists else None, 0, []
        while at < len(times):
            if last is not None:
                at += int(times[at:].searchsorted(last + seconds * 1e6))
            if at < len(times):
                chosen.append(at)
                last, at = int(times[at]), at + 1
        if last is not None:
            held.update((last,))
            held.setTimeoutTimestamp(max(last // 1000 + int(seconds * 1000), held.getCurrentWatermarkMs() + 1))
        yield fresh.iloc[chosen].assign(**{key: k[0]})[[key, "seq", "ts"]]

    timed = _timed(rows.select(F.col(key).cast("string").alias(key), "seq", "ts"), late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} string, seq long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def publish_changes(before: DataFrame, out: str, id_column: str = "id"):
    """A function for ``foreachBatch``: ids added to and removed from the snapshot of the batch before, as Parquet under
    ``out``/changes, an epoch a folder.

    Each epoch also writes its snapshot of ids under ``out``/snapshots, and is compared with the latest earlier one, the
    first with ``before``. An epoch that runs again overwrites its own folders, so nothing is published twice. Snapshots
    from before the latest two earlier epochs, which no epoch asks for again, are deleted.
    """
    from sextant.operators.spatial import diff_snapshots
    from sextant.storage import delete

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.select(id_column).distinct().write.mode("overwrite").parquet(f"{out}/snapshots/epoch={epoch}")
        held = spark.read.parquet(f"{out}/snapshots").where(F.col("epoch") < epoch)
        last = held.agg(F.max("epoch")).first()[0]
        former = before if last is None else held.where(F.col("epoch") == last)
        now = spark.read.parquet(f"{out}/snapshots/epoch={epoch}")
        diff_snapshots(former, now, id_column).write.mode("overwrite").parquet(f"{out}/changes/epoch={epoch}")
        if last is not None:
            for old in held.where(F.col("epoch") < last - 1).select("epoch").distinct().toLocalIterator():
                delete(spark, f"{out}/snapshots/epoch={old.epoch}")

    return write


def publish_alerts(whitelist: DataFrame, out: str, least: str, key: str = "id"):
    """A function for ``foreachBatch``: alerts of at least a severity whose key isn't in ``whitelist``, as Parquet under ``out``, an epoch
    a folder. The list is read again each epoch; an epoch that runs again overwrites its own folder."""
    from sextant.operators.selection import suppress

    def write(batch: DataFrame, epoch: int) -> None:
        suppress(batch, whitelist, least, key).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return write


def publish_influences(assets: DataFrame, out: str, km: float, id_column: str = "id"):
    """A function for ``foreachBatch``: the pairs of the latest row of each event (columns id, lat, lon, ts) and the assets within ``km``,
    as Parquet under ``out``, an epoch a folder; with ``trigger(processingTime="60 seconds")`` a pass a minute.

    The assets are joined on cells, not broadcast, so either side may be large. Pairs: the event's columns, the asset's with
    the prefix r_, distance_km.
    """
    from sextant.operators.spatial import radius_join

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c != id_column]
        latest = batch.groupBy(id_column).agg(F.max_by(F.struct(*rest), F.struct("ts", "lat", "lon")).alias("_r")).select(id_column, "_r.*")
        radius_join(latest, assets, km).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return write
