"""Grouped rules over neighbours, cycles, tracks and profiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.geo import EARTH_KM, haversine_km
from sextant.operators.spatial import radius_join, radius_self_join
from sextant.storage import cut, discard

#: WMO weather interpretation codes.
WEATHER_CODES = {0: "clear", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "rime fog", 51: "light drizzle", 53: "drizzle", 55: "dense drizzle", 56: "light freezing drizzle", 57: "freezing drizzle", 61: "light rain", 63: "rain", 65: "heavy rain", 66: "light freezing rain", 67: "freezing rain", 71: "light snow", 73: "snow", 75: "heavy snow", 77: "snow grains", 80: "rain showers", 81: "heavy showers", 82: "violent showers", 85: "snow showers", 86: "heavy snow showers", 95: "thunderstorm", 96: "thunderstorm with hail", 99: "thunderstorm with heavy hail"}


def weather_text(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WEATHER_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("unknown"))


def cluster_outliers(points: DataFrame, value: str, km: float, least: int = 3, limit: float = 2.5) -> DataFrame:
    """Rows whose value is over ``limit`` deviations from those of their neighbours within ``km``, given ``least`` of them."""
    pairs = radius_self_join(points.select("id", "lat", "lon", value), km).where(F.col(f"r_{value}").isNotNull())
    near = pairs.groupBy("id").agg(F.count("*").alias("n"), F.avg(f"r_{value}").alias("mean"), F.stddev_pop(f"r_{value}").alias("sd"))
    out = points.join(near.where((F.col("n") >= least) & (F.col("sd") > 0)), "id").withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd"))
    return out.where(F.abs("z") > limit).select("id", F.col(value).alias("value"), "n", "mean", "z")


def profile(cells: DataFrame, step_m: float = 30.0) -> DataFrame:
    """Along each row of cells: length, ascent, descent and steepest slope in percent."""
    by = Window.partitionBy("y").orderBy("x")
    rise = F.col("v") - F.lag("v").over(by)
    run = (F.col("x") - F.lag("x").over(by)) * step_m
    d = cells.select("y", rise.alias("rise"), run.alias("run")).where("rise IS NOT NULL")
    return d.groupBy("y").agg(F.sum("run").alias("length_m"), F.sum(F.greatest(F.lit(0.0), F.col("rise"))).alias("ascent"), F.sum(F.greatest(F.lit(0.0), -F.col("rise"))).alias("descent"), F.max(F.abs(F.col("rise") / F.col("run"))).alias("steepest"))


def track_length(points: DataFrame, key: str, order: str) -> DataFrame:
    """Points and great-circle length of each track."""
    by = Window.partitionBy(key).orderBy(order)
    leg = haversine_km(F.lag("lat").over(by), F.lag("lon").over(by), F.col("lat"), F.col("lon"))
    return points.select(key, leg.alias("leg")).groupBy(key).agg(F.count("*").alias("points"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("km"))


def outage_patterns(sessions: DataFrame, key: str) -> DataFrame:
    """Outages, mean and longest length of each key, and their commonest length (the least of equals)."""
    lengths = sessions.groupBy(key, "n").agg(F.count("*").alias("c"))
    mode = lengths.groupBy(key).agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("common"))
    return sessions.groupBy(key).agg(F.count("*").alias("outages"), F.avg("n").alias("mean_n"), F.max("n").alias("longest")).join(mode, key)


def outage_kinds(outages: DataFrame) -> DataFrame:
    """One row over resolved outages (type, severity, start, duration_s): how many, mean length, the commonest type and
    severity (the least of equals), and how many began in each hour of the day, as 24 counts."""
    by = lambda c: outages.groupBy(c).agg(F.count("*").alias("n")).agg(F.min_by(c, F.struct(-F.col("n"), c)).alias(c))
    hours = F.array(*[F.count_if(F.hour("start") == h) for h in range(24)])
    total = outages.agg(F.count("*").alias("outages"), F.avg("duration_s").alias("mean_s"), hours.alias("hours"))
    return total.crossJoin(F.broadcast(by("type"))).crossJoin(F.broadcast(by("severity")))


def station_activity(stations: DataFrame, active: Column) -> DataFrame:
    """Stations, active and other ones, over all and by type and by source."""
    on = F.coalesce(active, F.lit(False))
    return stations.withColumn("_on", on).groupingSets([[], ["type"], ["source"]], "type", "source").agg(F.count("*").alias("n"), F.count_if("_on").alias("active"), F.count_if(~F.col("_on")).alias("invalidated"))


def weather_cells(latest: DataFrame, strikes: DataFrame, storms: DataFrame, place: Callable[[Column], Column], size: float = 5.0) -> DataFrame:
    """Cells of ``size`` degrees that hold a station, strike or storm: means of pressure and temperatures, largest wind and
    wave of their stations, and how many of each. Points on a border go where ``place`` rounds them."""
    cell = [place(F.col(c) / size).alias(name) for c, name in (("lat", "cy"), ("lon", "cx"))]
    none = [F.lit(None).cast("double").alias(c) for c in ("pressure", "air_temp", "water_temp", "wind_speed", "wave_height")]
    kind = lambda k: [F.lit(int(k == i)).alias(c) for i, c in enumerate(("stations", "strikes", "storms"))]
    seen = latest.select(*cell, "pressure", "air_temp", "water_temp", "wind_speed", "wave_height", *kind(0)).unionByName(strikes.select(*cell, *none, *kind(1))).unionByName(storms.select(*cell, *none, *kind(2)))
    return seen.groupBy("cy", "cx").agg(
        *[F.avg(c).alias(c) for c in ("pressure", "air_temp", "water_temp")], F.max("wind_speed").alias("wind"), F.max("wave_height").alias("wave"), *[F.sum(c).alias(c) for c in ("stations", "strikes", "storms")]
    )


def misses(reports: DataFrame, key: str, missing: Column, order: str = "seq") -> DataFrame:
    """Share of reports that hold a value, and how many in a row are missing at the end; three or more is offline."""
    place = F.col(order)
    out = reports.withColumn("_m", missing).groupBy(key).agg(F.count("*").alias("n"), F.sum((~F.col("_m")).cast("long")).alias("present"), F.max(F.when(~F.col("_m"), place)).alias("_last"))
    tail = reports.withColumn("_m", missing).join(out.select(key, "_last"), key).where(F.col("_m") & (place > F.coalesce("_last", F.lit(-1)))).groupBy(key).agg(F.count("*").alias("consecutive"))
    met = out.join(tail, key, "left").withColumn("consecutive", F.coalesce("consecutive", F.lit(0)))
    return met.select(key, "n", (100.0 * F.col("present") / F.col("n")).alias("uptime"), "consecutive", (F.col("consecutive") >= 3).alias("offline"))


def outranked(edges: DataFrame) -> DataFrame | None:
    """The ids that greedy thinning drops: edges are (id, rival), the rival near the id and before it in some total order.

    Rounds keep every row that is first among its undecided neighbours and drop those near a kept one, which gives what
    going through the rows in order would. A round takes what is decided out of the rivalries, so the work shrinks; there
    are as many rounds as the longest chain of rows, each near and behind the one before, needs. None if nothing goes.
    """
    edges = cut(edges, "thin")
    gone = None
    while not edges.isEmpty():
        # first among the undecided: rivals that have no rival left
        first = edges.select(F.col("rival").alias("id")).distinct().join(edges.select("id").distinct(), "id", "left_anti")
        dropped = cut(edges.join(first.select(F.col("id").alias("rival")), "rival", "left_semi").select("id").distinct(), "thin")
        # a dropped row is nobody's rival, and needs no decision
        left = edges.join(dropped, "id", "left_anti").join(dropped.select(F.col("id").alias("rival")), "rival", "left_anti")
        former, edges = edges, cut(left.select("id", "rival"), "thin")
        discard(former)
        gone = dropped if gone is None else cut(gone.union(dropped), "thin")
    return gone


def thin(points: DataFrame, km: float) -> DataFrame:
    """Greedy thinning by score: a row stays if no row that stays is within ``km`` and before it (higher score, then id). A row without
    a place or a score is nobody's rival and stays.

    Rows stand in cells of which any two points are within ``km``, so only a cell's first can stay next; it does if it is before the
    firsts of all cells that reach within ``km`` of it. What lies near those that stay goes, and the others are looked at again. Pairs are
    of firsts, and of rows with the few that can stay near them: rows with rows never meet.
    """
    first, width = F.struct((-F.col("score")).alias("s"), "id"), 0.499 * math.degrees(km / EARTH_KM)
    row = F.floor((F.col("lat") + 90) / width)
    # the widest of a row of cells is where it comes nearest the equator
    south = row * width - 90
    widest = F.cos(F.radians(F.when((south <= 0) & (south + width >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(south + width)))))
    across = F.greatest(F.lit(1.0), F.ceil(360 * widest / width).cast("double"))
    column = F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360.0 * across)
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("score").isNotNull()
    todo = cut(points.where(whole).select("id", "lat", "lon", "score", row.alias("_row"), column.alias("_col")), "thin")
    gone = None
    while not todo.isEmpty():
        firsts = cut(todo.groupBy("_row", "_col").agg(F.min_by(F.struct("id", "lat", "lon", "score"), first).alias("f")).select("f.*"), "firsts")
        before = (F.col("r_score") > F.col("score")) | ((F.col("r_score") == F.col("score")) & (F.col("r_id") < F.col("id")))
        behind = radius_join(firsts, firsts, 2 * km, gather=False).where(F.col("id") != F.col("r_id")).where(before).select("id").distinct()
        stay = cut(firsts.join(behind, "id", "left_anti"), "stay")
        near = cut(radius_join(stay.select("id", "lat", "lon"), todo.select("id", "lat", "lon"), km, gather=False).where("id <> r_id").select(F.col("r_id").alias("id")).distinct(), "thin")
        former, todo = todo, cut(todo.join(near, "id", "left_anti").join(stay.select("id"), "id", "left_anti"), "thin")
        gone = near if gone is None else gone.union(near)
        for done in (former, firsts, stay):
            discard(done)
    return points if gone is None else points.join(gone, "id", "left_anti")


def _corners(points: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull, counter-clockwise from the leftmost (Andrew 1979)."""

    def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    corners = sorted(set(points))
    return corners if len(corners) < 3 else half(corners)[:-1] + half(corners[::-1])[:-1]


def hulls(points: DataFrame, key: str) -> DataFrame:
    """Convex hull of each group as ordered corners (x, y).

    Each task first takes the hulls of its own rows, batch by batch, and only their corners meet, so a group of any size
    sends a few points from each task. Rows without a coordinate are left out.
    """
    kind = dict(points.dtypes)[key]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, list[tuple[float, float]]] = {}
        for pdf in batches:
            for name, rows in pdf.groupby(key, dropna=False):
                held[name] = _corners([*held.get(name, []), *zip(rows["x"].astype(float), rows["y"].astype(float), strict=True)])
        yield pd.DataFrame([(k, *p) for k, ring in held.items() for p in ring], columns=[key, "x", "y"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = _corners(zip(pdf["x"], pdf["y"], strict=True))
        return pd.DataFrame({key: pdf[key].iloc[0], "corner": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    some = points.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y").mapInPandas(partial, f"{key} {kind}, x double, y double")
    return some.groupBy(key).applyInPandas(whole, f"{key} {kind}, corner int, x double, y double")


def recent_trails(points: DataFrame, key: str, as_of: Column, most: int = 30, seconds: float = 1800.0, least: int = 2, time: str = "freshness", order: str = "id") -> DataFrame:
    """(key, points, trail): a key's last ``most`` positions of the ``seconds`` up to ``as_of``, oldest first, for keys with ``least``.
    A position without a time is in no trail. The rank keeps ``most`` rows a key and task before anything is shuffled."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 1e6
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc(order)))
    last = points.where(age.between(0, seconds)).withColumn("_r", place).where(F.col("_r") <= most)
    trail = F.transform(F.array_sort(F.collect_list(F.struct(time, order, "lon", "lat"))), lambda p: F.struct(p[time].alias(time), p["lon"].alias("lon"), p["lat"].alias("lat")))
    return last.groupBy(key).agg(F.count("*").alias("points"), trail.alias("trail")).where(F.col("points") >= least)


def largest_rings(vertices: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, ring, vertices, west, south, east, north): the ring of the largest box of each key; of equal ones the least."""
    box = [F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")]
    rings = vertices.groupBy(key, ring).agg(F.count("*").alias("vertices"), *box).withColumn("_area", (F.col("east") - F.col("west")) * (F.col("north") - F.col("south")))
    w = Window.partitionBy(key).orderBy(F.desc("_area"), ring)
    return rings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_area")
