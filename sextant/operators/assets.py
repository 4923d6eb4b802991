"""Health of grid assets, regional climate anomalies, storms over water, and guesses about a connection's medium.

Thresholds are parameters; defaults are common engineering limits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.geo import destination_point, haversine_km
from sextant.operators.spatial import radius_join, region_of

#: Plausible ranges of an asset's measurements.
ASSET_LIMITS = {"temperature": (-40.0, 90.0), "frequency": (49.5, 50.5), "pue": (1.0, 2.5)}


def asset_health(assets: DataFrame, readings: DataFrame, as_of: Column, interval_s: float = 10.0, fields: Sequence[str] = ("load", "temperature", "frequency"), window: int = 5, most_drift: float = 0.5) -> DataFrame:
    """For each asset: age of its last reading, status (ok, stale beyond 2 intervals, failed beyond 5, missing), fields it
    lacks, drift (the last load against the mean of the last ``window`` nonzero ones, as a share) and a score.

    The score is 100 less 20 stale, 50 failed or missing, 10 for each lacking field and 15 for a drift above ``most_drift``.
    """
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("seq")))
    recent = readings.where("load <> 0").withColumn("_r", place).where(F.col("_r") <= window)
    mean = recent.groupBy("asset_id").agg(F.avg("load").alias("_mean"), F.max_by("load", "seq").alias("_last"))
    last = readings.groupBy("asset_id").agg(F.max("ts").alias("ts"), F.max_by(F.struct(*fields), "seq").alias("_m"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    lacking = sum((F.col(f"_m.{f}").isNull().cast("int") for f in fields), F.lit(0))
    out = assets.select(F.col("id").alias("asset_id")).join(last, "asset_id", "left").join(mean, "asset_id", "left")
    status = F.when(age.isNull(), "missing").when(age > 5 * interval_s, "failed").when(age > 2 * interval_s, "stale").otherwise("ok")
    drift = F.abs(F.col("_last") - F.col("_mean")) / F.col("_mean")
    out = out.select("asset_id", age.alias("age_s"), status.alias("status"), F.when(age.isNotNull(), lacking).otherwise(len(fields)).alias("lacking"), drift.alias("drift"))
    points = F.when(F.col("status") == "stale", 20).when(F.col("status").isin("failed", "missing"), 50).otherwise(0)
    return out.withColumn("score", F.greatest(F.lit(0), 100 - points - 10 * F.col("lacking") - F.when(F.col("drift") > most_drift, 15).otherwise(0)))


def asset_limits(readings: DataFrame, limits: Mapping[str, tuple[float, float]] = ASSET_LIMITS) -> DataFrame:
    """(asset_id, seq, field, value) of readings outside their limits; fields that the table lacks are left out."""
    held = [f for f in limits if f in readings.columns]
    stacked = ", ".join(f"'{f}', CAST({f} AS DOUBLE), CAST({limits[f][0]} AS DOUBLE), CAST({limits[f][1]} AS DOUBLE)" for f in held)
    long = readings.selectExpr("asset_id", "seq", f"stack({len(held)}, {stacked}) AS (field, value, low, high)")
    return long.where("value < low OR value > high").select("asset_id", "seq", "field", "value")


def asset_alerts(assets: DataFrame, readings: DataFrame, health: DataFrame, limit: int | None = None, full: float = 0.95, warm: float = 70.0, hot: float = 85.0) -> DataFrame:
    """(asset_id, kind, severity): overloaded (load above ``full`` of capacity_mw), hot, warm and silent assets;
    with ``limit`` as many of the worst."""
    last = readings.groupBy("asset_id").agg(F.max_by(F.struct("load", "temperature"), "seq").alias("m"))
    met = assets.select(F.col("id").alias("asset_id"), "capacity_mw").join(last, "asset_id", "left").join(health.select("asset_id", "status"), "asset_id", "left")
    kinds = F.array(
        F.when(F.col("m.load") > full * F.col("capacity_mw"), F.struct(F.lit("overload").alias("kind"), F.lit("critical").alias("severity"))),
        F.when(F.col("m.temperature") > hot, F.struct(F.lit("hot").alias("kind"), F.lit("critical").alias("severity"))).when(F.col("m.temperature") > warm, F.struct(F.lit("warm").alias("kind"), F.lit("warning").alias("severity"))),
        F.when(F.col("status").isin("failed", "missing"), F.struct(F.lit("silent").alias("kind"), F.lit("warning").alias("severity"))),
    )
    out = met.select("asset_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("a")).select("asset_id", "a.kind", "a.severity")
    return out if limit is None else out.orderBy("severity", "kind", "asset_id").limit(limit)


def health_summary(health: DataFrame) -> DataFrame:
    """One row: assets, mean score, how many of each status, and how many score below 50."""
    count = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return health.agg(F.count("*").alias("assets"), F.avg("score").alias("mean_score"), *[count(s) for s in ("ok", "stale", "failed", "missing")], F.sum((F.col("score") < 50).cast("long")).alias("poor"))


def fetch_health(fetches: DataFrame, window: int = 10, slow_ms: float = 100.0) -> DataFrame:
    """For each fetch: mean latency and share of successes of the source's last ``window``, its size against their mean,
    and a band (good, slow above ``slow_ms``, failing below half successes)."""
    w = Window.partitionBy("source").orderBy("seq").rowsBetween(-(window - 1), 0)
    out = fetches.select("source", "seq", F.avg("latency_ms").over(w).alias("mean_ms"), F.avg(F.col("ok").cast("double")).over(w).alias("success"), (F.col("payload") / F.avg("payload").over(w)).alias("relative_size"))
    return out.withColumn("band", F.when(F.col("success") < 0.5, "failing").when(F.col("mean_ms") > slow_ms, "slow").otherwise("good"))


def region_anomaly(points: DataFrame, regions: DataFrame, value: str, equator: float = 28.0, per_degree: float = 0.45) -> DataFrame:
    """For each region the mean of values less a baseline that falls by ``per_degree`` of latitude from ``equator``, and the
    distinct stations; points: id, lat, lon and the value."""
    placed = region_of(points.where(F.col(value).isNotNull()), regions).where("region IS NOT NULL")
    gap = F.col(value) - (equator - per_degree * F.abs("lat"))
    return placed.groupBy("region").agg(F.avg(gap).alias("anomaly"), F.countDistinct("id").alias("stations"))


def regional_index(anomalies: DataFrame, plus: str, minus: str, scale: float = 2.0, limit: float = 3.0, mark: float = 0.5) -> DataFrame:
    """One row: the difference of two regions' anomalies over ``scale``, clamped, and its phase; 0 where one is missing."""
    of = lambda r: F.avg(F.when(F.col("region") == r, F.col("anomaly")))
    index = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce((of(plus) - of(minus)) / scale, F.lit(0.0))))
    return anomalies.agg(index.alias("index")).withColumn("phase", F.when(F.col("index") >= mark, "positive").when(F.col("index") <= -mark, "negative").otherwise("neutral"))


def storm_water(storms: DataFrame, points: DataFrame, value: str, degrees: float = 10.0, default: float = 26.0) -> DataFrame:
    """Storms with the mean ``value`` of the points in the box of ``degrees`` around each (across the antimeridian too), or
    ``default``. Points and boxes meet on cells as wide as the box's half."""
    cell = lambda c: F.floor(F.col(c) / degrees)
    n = int(360 // degrees)
    held = points.where(F.col(value).isNotNull()).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(value).alias("_v"), cell("lat").alias("_cy"), F.pmod(cell("lon"), F.lit(n)).alias("_cx"))
    near = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: cell(c) + k))
    asked = storms.select("id", "lat", "lon", near("lat").alias("_cy")).select("*", near("lon").alias("_x")).withColumn("_cx", F.pmod("_x", F.lit(n))).drop("_x")
    # no sums before the comparison: on the box's edge their rounding would decide
    apart = F.abs(F.col("_lon") - F.col("lon"))
    gap = F.least(apart, 360.0 - apart)
    met = asked.join(held, ["_cx", "_cy"]).where((gap <= degrees) & (F.abs(F.col("_lat") - F.col("lat")) <= degrees))
    means = met.groupBy("id").agg(F.avg("_v").alias("_mean"))
    return storms.join(means, "id", "left").withColumn("water", F.coalesce("_mean", F.lit(default))).drop("_mean")


def storm_track(storms: DataFrame, steps: int = 20, hours: float = 6.0, keep: float = 0.97, warm: float = 26.0, gain: float = 0.5, floor_kt: float = 15.0, ceiling_kt: float = 185.0) -> DataFrame:
    """(id, hour, lat, lon, wind_kt): each storm carried on along its heading by great-circle steps.

    Its speed (knots) persists by ``keep`` a step, and its wind gains ``gain`` knots for each degree of water above
    ``warm``, within a floor and a ceiling. storms: id, lat, lon, heading, knots, wind_kt, water.
    """
    heat = gain * (F.col("water") - warm)

    def step(s: Column, k: Column) -> Column:
        knots = s["knots"] * keep
        lat, lon = destination_point(s["lat"], s["lon"], s["heading"], knots * (1.852 * hours))
        wind = F.greatest(F.lit(floor_kt), F.least(F.lit(ceiling_kt), s["wind"] + s["heat"]))
        row = F.struct((k * hours).alias("hour"), lat.alias("lat"), lon.alias("lon"), wind.alias("wind_kt"))
        return F.struct(lat.alias("lat"), lon.alias("lon"), s["heading"].alias("heading"), knots.alias("knots"), wind.alias("wind"), s["heat"].alias("heat"), F.concat(s["rows"], F.array(row)).alias("rows"))

    kind = "array<struct<hour:double,lat:double,lon:double,wind_kt:double>>"
    start = F.struct(*[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "heading", "knots")], F.col("wind_kt").cast("double").alias("wind"), heat.cast("double").alias("heat"), F.array().cast(kind).alias("rows"))
    rows = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["rows"])
    return storms.select("id", F.explode(rows).alias("t")).select("id", "t.*")


def depth_plausibility(stations: DataFrame, cells: DataFrame, degrees: float = 2.0, slack: float = 1.1) -> DataFrame:
    """Stations whose depth is more than ``slack`` times that of the sea in their cell (lat_cell, lon_cell, depth), with how
    far: critical at twice the sea's depth, or on land."""
    at = lambda c: F.floor(F.col(c) / degrees + 0.5).alias(f"{c}_cell")
    met = stations.where("depth > 0").select("id", F.col("depth").alias("station_depth"), at("lat"), at("lon")).join(cells.select("lat_cell", "lon_cell", F.col("depth").alias("sea_depth")), ["lat_cell", "lon_cell"])
    deep = met.where(F.col("station_depth") > slack * F.col("sea_depth"))
    return deep.select("id", "station_depth", "sea_depth", F.when(F.col("station_depth") >= 2 * F.col("sea_depth"), "critical").otherwise("warning").alias("severity"))


def with_places(connections: DataFrame, places: DataFrame) -> DataFrame:
    """Connections with the place (ip, country, ...) of their public remote address; private ones and strangers get nulls."""
    from sextant.operators.network import is_private_ip

    ip = F.when(~is_private_ip(F.col("remote_ip")), F.col("remote_ip"))
    return connections.withColumn("_ip", ip).join(places.withColumnRenamed("ip", "_ip"), "_ip", "left").drop("_ip")


def guess_medium(rows: DataFrame, key: str, votes: Sequence[tuple[str, str, float]]) -> DataFrame:
    """(key, medium, confidence): rules (SQL condition over a row, medium, weight) vote on each row; the medium of the
    largest sum wins, the first by name of equals, with its share of all votes."""
    cast = F.array(*[F.when(F.expr(test), F.struct(F.lit(m).alias("medium"), F.lit(float(w)).alias("w"))) for test, m, w in votes])
    given = rows.select(key, F.explode(F.filter(cast, lambda v: v.isNotNull())).alias("v"))
    sums = given.groupBy(key, "v.medium").agg(F.sum("v.w").alias("w"))
    best = sums.groupBy(key).agg(F.min_by("medium", F.struct((-F.col("w")).alias("w"), F.col("medium"))).alias("medium"), F.max("w").alias("top"), F.sum("w").alias("total"))
    return best.select(key, "medium", (F.col("top") / F.col("total")).alias("confidence"))


def resolver_leaks(resolvers: DataFrame, exits: DataFrame) -> DataFrame:
    """Resolvers (session, ip, country) of sessions whose exit (session, country) lies elsewhere; nulls prove nothing."""
    met = resolvers.join(exits.select("session", F.col("country").alias("exit_country")), "session")
    return met.where(F.col("country") != F.col("exit_country"))


def path_contacts(vertices: DataFrame, cells: float = 3.0) -> DataFrame:
    """(path, other, vertices): paths of which a vertex lies less than ``cells`` from one of another path, and how many do.

    vertices: path, x, y. They meet on squares as wide as the distance, the others sent to the squares around them; a vertex has one
    square, so it is counted where it met. Small files hold many vertices, so neither side is ever broadcast.
    """
    square = lambda c: F.floor(F.col(c) / cells)
    around = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: square(c) + k))
    a = vertices.select("path", "x", "y", square("x").alias("_cx"), square("y").alias("_cy"))
    b = vertices.select(F.col("path").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"), around("x").alias("_cx"), "y").select("other", "_x", "_y", "_cx", around("y").alias("_cy"))
    near = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 < cells * cells
    met = a.hint("merge").join(b.hint("merge"), ["_cx", "_cy"]).where((F.col("path") != F.col("other")) & near)
    each = met.select("_cx", "_cy", "path", "other", "x", "y").distinct()
    return each.groupBy("path", "other").agg(F.count("*").alias("vertices"))


def nearest_report(targets: DataFrame, reports: DataFrame, km: float) -> DataFrame:
    """For each target (id, lat, lon) the nearest report within ``km``, ties by its id."""
    met = radius_join(targets, reports, km)
    best = met.groupBy("id").agg(F.min_by(F.struct("r_id", "distance_km"), F.struct("distance_km", "r_id")).alias("b"))
    return best.select("id", "b.r_id", "b.distance_km")


def track_spread(tracks: DataFrame) -> DataFrame:
    """(id, km): how far each storm goes between its first and last hour."""
    ends = tracks.groupBy("id").agg(F.min_by(F.struct("lat", "lon"), "hour").alias("a"), F.max_by(F.struct("lat", "lon"), "hour").alias("b"))
    return ends.select("id", haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("km"))
