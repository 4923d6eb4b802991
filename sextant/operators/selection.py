"""Selections, alert rules and lookups over small dimension tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators.spatial import radius_join
from sextant.storage import cut, discard

#: Heights in metres up to which a layer is shown.
FARTHEST_M = {"quake": 5e6, "fire": 3e6, "aircraft": 2e6, "vessel": 1.5e6, "lightning": 1e6}
SEVERITIES = ("info", "low", "moderate", "warning", "high", "critical")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def suppress(alerts: DataFrame, whitelist: DataFrame, least: str, key: str = "id", snoozed_until: Column | None = None, time: str = "ts") -> DataFrame:
    """Alerts of at least a severity whose key isn't listed; while snoozed none at all, so none of before ``snoozed_until``."""
    loud = alerts.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(least)))
    if snoozed_until is not None:
        loud = loud.where(F.col(time) >= snoozed_until)
    return loud.join(whitelist.select(key).distinct(), key, "left_anti")


def union_alerts(**tables: DataFrame) -> DataFrame:
    """All alerts, with ``origin`` for the table that each comes from; columns that a table lacks are null."""
    out = None
    for name, table in tables.items():
        named = table.withColumn("origin", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def cooldown_alerts(events: DataFrame, key: str | Sequence[str], seconds: float, time: str = "ts", order: str = "seq") -> DataFrame:
    """The events that raise an alert: a key's first, and each that comes ``seconds`` or more after the key's last alert.

    Rows are dealt by key and go through a task in the order of time, a batch at a time; what is kept of a key is the time
    of its last alert. Repeated times go in the order of ``order``; rows without a time raise nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    schema, columns = events.schema, events.columns
    timed = events.where(F.col(time).isNotNull()).withColumn("_us", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("_key", F.xxhash64(*keys))
    dealt = timed.repartition("_key").sortWithinPartitions("_key", *keys, "_us", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            us = batch.column("_us").to_numpy()
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            chosen = []
            for a, b in zip(starts, starts[1:], strict=False):
                if names[a] != before:
                    before, last = names[a], None
                at = a
                while at < b:
                    if last is not None:
                        at += int(np.searchsorted(us[at:b], last + seconds * 1e6))
                    if at < b:
                        chosen.append(at)
                        last = int(us[at])
                        at += 1
            yield batch.take(pa.array(chosen, pa.int64())).select(columns)

    return dealt.mapInArrow(run, schema)


def visible_at(rows: DataFrame, height_m: float, farthest: Mapping[str, float] = FARTHEST_M, layer: str = "layer") -> DataFrame:
    """Rows of layers that are shown from a height; layers that ``farthest`` doesn't name are always shown."""
    hidden = [name for name, most in farthest.items() if height_m > most]
    return rows.where(~F.col(layer).isin(hidden)) if hidden else rows


def best_in_cell(rows: DataFrame, cell: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each cell in ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where("_r = 1").drop("_r")


def weighted_selection(rows: DataFrame, weights: dict[str, float], limit: int) -> DataFrame:
    """The ``limit`` rows of the heaviest layers, ties by id."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return rows.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("layer")), F.lit(0.0))).orderBy(F.desc("weight"), "id").limit(limit)


def pixel_window(box: tuple[Column, Column, Column, Column], origin: tuple[float, float], pixel: float, size: tuple[int, int]) -> list[Column]:
    """(x0, y0, x1, y1) of the pixels that a box (west, south, east, north) touches, clamped to the raster; y grows southward."""
    west, south, east, north = box
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v)).cast("int")
    return [clamp(F.floor((west - origin[0]) / pixel), size[0]), clamp(F.floor((origin[1] - north) / pixel), size[1]), clamp(F.ceil((east - origin[0]) / pixel), size[0]), clamp(F.ceil((origin[1] - south) / pixel), size[1])]


def ramp(value: Column, stops: Sequence[tuple[float, tuple[int, int, int]]]) -> Column:
    """A colour between the stops around a value, as struct<r, g, b>; beyond the ends, the ends' colours."""
    out = None
    for (lo, a), (hi, b) in zip(stops, stops[1:], strict=False):
        v = F.greatest(F.lit(lo), value)
        colour = F.struct(*[F.floor((x * (hi - v) + y * (v - lo)) / (hi - lo) + 0.5).cast("int").alias(n) for n, x, y in zip("rgb", a, b, strict=True)])
        out = F.when(value <= hi, colour) if out is None else out.when(value <= hi, colour)
    return out.otherwise(F.struct(*[F.lit(x).alias(n) for n, x in zip("rgb", stops[-1][1], strict=True)]))


def sound_levels(sources: DataFrame, receivers: DataFrame, km: float, air_db_km: float = 5.0) -> DataFrame:
    """Level at each receiver from the sources (id, lat, lon, lw in dB) within ``km``: spherical spreading and loss in the
    air, added as energies."""
    met = radius_join(receivers.select("id", "lat", "lon"), sources.select("id", "lat", "lon", "lw"), km)
    metres = F.greatest(F.lit(1.0), F.col("distance_km") * 1000)
    level = F.col("r_lw") - (20 * F.log10(metres) + 10 * math.log10(4 * math.pi)) - air_db_km * F.col("distance_km")
    out = met.groupBy("id").agg(F.sum(F.pow(F.lit(10.0), level / 10)).alias("e"), F.count("*").alias("sources"))
    return out.select("id", "sources", (10 * F.log10("e")).alias("level_db"))


class FollowUp:
    """The result of the last question, for questions about it: ``ask`` keeps a DataFrame's rows as a table in the shared folder and
    returns them, ``then`` applies a function to them and keeps what comes out. ``limit`` is for what a person reads; without it
    whole results are kept."""

    def __init__(self, limit: int | None = None) -> None:
        self.limit = limit
        self.rows: DataFrame | None = None

    def ask(self, df: DataFrame) -> DataFrame:
        former, self.rows = self.rows, cut(df if self.limit is None else df.limit(self.limit), "asked")
        if former is not None:
            discard(former)
        return self.rows

    def then(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if self.rows is None:
            raise ValueError("nothing has been asked yet")
        return self.ask(f(self.rows))
