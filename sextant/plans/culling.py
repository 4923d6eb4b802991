"""Named queries of views with padding and detail, recent trails, jumps between cycles, tiles and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions import geo
from sextant.operators import acoustics, quality, rollups, selection
from sextant.plans.extra import _ALERTS, _alerts
from sextant.plans.registry import _FIELDS, _LONG, _STEP, _long, _on, _r
from sextant.plans.views import AS_OF

_NEAR = "lat BETWEEN -40 AND 40 AND (lon >= 150 OR lon <= -140)"


@_on("features", "p5_padded_view", f"SELECT id FROM features WHERE {_NEAR}")
def _p5_padded(df: DataFrame) -> DataFrame:
    return df.where(geo.in_padded_box(F.col("lat"), F.col("lon"), 160.0, -30.0, -150.0, 30.0)).select("id")


@_on("features", "p5_tall_view", "SELECT id FROM features")
def _p5_tall(df: DataFrame) -> DataFrame:
    return df.where(geo.in_padded_box(F.col("lat"), F.col("lon"), 160.0, -80.0, -150.0, 80.0)).select("id")


@_on("features", "p6_detail_in_view", f"SELECT id, layer FROM features WHERE {_NEAR} AND layer NOT IN ('vessel', 'lightning')")
def _p6_detail(df: DataFrame) -> DataFrame:
    shown = selection.visible_at(df, 1_800_000.0)
    return shown.where(geo.in_padded_box(F.col("lat"), F.col("lon"), 155.0, -35.0, -145.0, 35.0, pad=5.0)).select("id", "layer")


@_on(
    "features", "w1_recent_trail",
    f"SELECT user_id, count(*) AS points, round(arg_min(lon, freshness), 6) AS first_lon, round(arg_max(lon, freshness), 6) AS last_lon FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY freshness DESC, id DESC) AS r FROM features WHERE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(freshness) BETWEEN 0 AND 5 * 86400e6) WHERE r <= 30 GROUP BY user_id HAVING count(*) >= 2",
)
def _w1_recent(df: DataFrame) -> DataFrame:
    out = rollups.recent_trails(df, "user_id", F.lit(AS_OF).cast("timestamp_ntz"), seconds=5 * 86_400.0)
    return out.select("user_id", "points", _r(F.get("trail", F.lit(0))["lon"], "first_lon"), _r(F.element_at("trail", -1)["lon"], "last_lon"))


@_on(
    "measurements", "v8_cycle_jump",
    _LONG + f", c AS (SELECT *, seq // 40 AS cycle FROM long), d AS (SELECT *, CASE WHEN cycle = lag(cycle) OVER w + 1 THEN abs(value - lag(value) OVER w) END AS change FROM c WINDOW w AS (PARTITION BY station_id, field ORDER BY cycle, seq)) SELECT station_id, field, seq, 'jump' AS rule, CASE WHEN change > 2 * {_STEP} THEN 'critical' ELSE 'warning' END AS severity, round(change, 6) AS change FROM d WHERE change > {_STEP}",
)
def _v8_cycle(df: DataFrame) -> DataFrame:
    return quality.cycle_jumps(_long(df).withColumn("cycle", F.floor(F.col("seq") / 40))).withColumn("change", F.round("change", 6))


@_on(
    "features", "f_tile_pixel",
    "SELECT id, CAST(floor((px - floor(px)) * 256) AS BIGINT) AS px, CAST(floor((py - floor(py)) * 256) AS BIGINT) AS py, CASE WHEN lon > 170 THEN NULL ELSE zoom END AS zoom FROM (SELECT id, lon, (lon + 180) / 360 * 1024 AS px, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024 AS py,"
    " (SELECT max(z) FROM range(0, 11) r(z) WHERE z = 0 OR (floor((lon + 185) / 360 * (1 << z)) - floor((lon + 180) / 360 * (1 << z)) < 4 AND floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * (1 << z)) - floor((1 - ln(tan(radians(lat + 5)) + 1 / cos(radians(lat + 5))) / pi()) / 2 * (1 << z)) < 4)) AS zoom FROM features)",
)
def _f_tile(df: DataFrame) -> DataFrame:
    px, py = geo.pixel_xy(F.col("lat"), F.col("lon"), 10)
    zoom = geo.optimal_zoom(F.col("lon"), F.col("lat"), F.col("lon") + 5, F.col("lat") + 5, preferred=10, tiles=4)
    return df.select("id", px.cast("long").alias("px"), py.cast("long").alias("py"), F.when(~(F.col("lon") > 170), zoom.cast("long")).alias("zoom"))


@_on(
    "features", "f_offsets",
    "SELECT id, round(lat + 3000 * k, 6) AS lat2, round(lon + 4000 * k / cos(radians(lat)), 6) AS lon2, round(sqrt(pow(4000 * k / cos(radians(lat)) * cos(radians(lat + 1500 * k)), 2) + pow(3000 * k, 2)) / k, 3) AS metres, round(dayofyear(freshness) - 1 + (extract(hour FROM freshness) * 3600 + extract(minute FROM freshness) * 60 + floor(extract(second FROM freshness))) / 86400, 6) AS day FROM (SELECT *, 180 / (pi() * 6371000) AS k FROM features)",
)
def _f_offsets(df: DataFrame) -> DataFrame:
    lat, lon = geo.offset_point_m(F.col("lat"), F.col("lon"), F.lit(4000.0), F.lit(3000.0))
    metres = geo.dist_planar_m(F.col("lat"), F.col("lon"), lat, lon)
    return df.select("id", _r(lat, "lat2"), _r(lon, "lon2"), F.round(metres, 3).alias("metres"), _r(geo.day_of_year(F.col("freshness")), "day"))


@_on("features", "p8_snoozed", _ALERTS.replace("SELECT id, layer, CASE", "SELECT id, layer, freshness, CASE") + " SELECT id, severity FROM al WHERE severity IN ('high', 'critical') AND freshness >= TIMESTAMP '2024-01-12 00:00:00' AND id NOT IN (SELECT id FROM features WHERE speed < 30)")
def _p8_snoozed(df: DataFrame) -> DataFrame:
    alerts = _alerts(df).join(df.select("id", "freshness"), "id")
    until = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    return selection.suppress(alerts, df.where("speed < 30"), "high", snoozed_until=until, time="freshness").select("id", "severity")


@_on("features", "p23_arrow", "SELECT id, round(lat + least(speed / 20, 5) * cos(radians(heading)), 6) AS lat2, round(lon + least(speed / 20, 5) * sin(radians(heading)) / cos(radians(lat)), 6) AS lon2 FROM features")
def _p23_arrow(df: DataFrame) -> DataFrame:
    lat, lon = geo.arrow_end(F.col("lat"), F.col("lon"), F.col("speed") / 10, F.col("heading"))
    return df.select("id", _r(lat, "lat2"), _r(lon, "lon2"))


@_on("features", "u2_union_alerts", _ALERTS + " SELECT id, severity, layer, CAST(NULL AS DOUBLE) AS speed, 'hazards' AS origin FROM al UNION ALL SELECT id, 'warning', NULL, speed, 'fast' FROM features WHERE speed > 250")
def _u2(df: DataFrame) -> DataFrame:
    fast = df.where("speed > 250").select("id", F.lit("warning").alias("severity"), "speed")
    return selection.union_alerts(hazards=_alerts(df).drop("speed"), fast=fast).select("id", "severity", "layer", "speed", "origin")


@_on("measurements", "a20_rain_day", "SELECT station_id, date_trunc('day', ts) AS day, round(sum(wave_height), 6) AS total, min(air_temp) AS low, max(air_temp) AS high, round(max(salinity / 100), 6) AS most_likely FROM measurements GROUP BY 1, 2")
def _a20_rain(df: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return df.groupBy("station_id", day).agg(_r(F.sum("wave_height"), "total"), F.min("air_temp").alias("low"), F.max("air_temp").alias("high"), _r(F.max(F.col("salinity") / 100), "most_likely"))


@_on(
    "features", "a24_largest_ring",
    ", r AS (SELECT layer, user_id AS ring, count(*) AS vertices, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM features GROUP BY layer, user_id) SELECT layer, ring, vertices, west, south, east, north FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY (east - west) * (north - south) DESC, ring) AS n FROM r) WHERE n = 1",
)
def _a24_ring(df: DataFrame) -> DataFrame:
    return rollups.largest_rings(df.withColumnRenamed("user_id", "ring"), "layer", "ring")


@_on(
    "measurements", "v15_field_drops",
    ", h AS (SELECT station_id, seq, CAST(" + " + ".join(f"(CASE WHEN {f} IS NULL THEN 0 ELSE 1 END)" for f in _FIELDS) + " AS BIGINT) AS held FROM measurements) SELECT station_id, seq, 'field_drop' AS rule, 'warning' AS severity, before, held FROM (SELECT *, lag(held) OVER (PARTITION BY station_id ORDER BY seq) AS before FROM h) WHERE before - held > 1",
)
def _v15_drops(df: DataFrame) -> DataFrame:
    return quality.field_drops(df, _FIELDS, most=1)


_AIR = repr(acoustics.absorption_db_per_m(500.0))
_WAVE = repr(acoustics.SOUND_M_S / 500.0)


@_on(
    "relief", "t20_terrain_levels",
    ", s AS (SELECT y * 400 + x AS id, x AS sx, y AS sy, 95e0 + x % 7 AS power, v + 2e0 AS sz FROM relief WHERE x % 97 = 0 AND y % 11 = 0), r AS (SELECT x, y, v + 1.5e0 AS z FROM relief WHERE x % 7 = 0 AND y % 7 = 0),"
    " p AS (SELECT *, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) * 30e0 AS flat FROM s JOIN r ON (x - sx) * (x - sx) + (y - sy) * (y - sy) BETWEEN 1 AND 225),"
    " q AS (SELECT *, sqrt(flat * flat + (z - sz) * (z - sz)) AS direct, least(20, CAST(floor(flat / 30) AS INTEGER)) AS n FROM p),"
    " k AS (SELECT q.*, i / CAST(n AS DOUBLE) AS t FROM q LEFT JOIN range(1, 20) a(i) ON i < n),"
    " e AS (SELECT k.*, g.v AS edge, sqrt(pow(t * flat, 2) + pow(g.v - sz, 2)) AS over_, sqrt(pow((1 - t) * flat, 2) + pow(g.v - z, 2)) AS down_ FROM k LEFT JOIN relief g ON g.x = floor(sx + t * (k.x - sx) + 0.5e0) AND g.y = floor(sy + t * (k.y - sy) + 0.5e0)),"
    " w AS (SELECT id, x, y, power, direct, max(CASE WHEN edge IS NOT NULL THEN {'d': CASE WHEN edge >= sz + t * (z - sz) THEN over_ + down_ - direct ELSE direct - over_ - down_ END, 'o': over_, 'u': down_} END) AS m FROM e GROUP BY id, x, y, power, direct),"
    f" b AS (SELECT *, greatest(0e0, 4.8e0 - 3.5e0 / direct * (17 + 300 / direct)) AS soft, 3 + 20 / {_WAVE} * m.d * CASE WHEN m.d > 0 THEN exp(-sqrt(m.o * m.u * direct / (2 * m.d)) / 2000) ELSE 1e0 END AS inside FROM w),"
    f" l AS (SELECT x, y, power - (20 * log10(direct) + 11) - {_AIR} * direct - soft - coalesce(greatest(0e0, CASE WHEN inside > 1 THEN least(20e0, 10 * log10(inside)) ELSE 0 END - soft), 0) AS level FROM b)"
    " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(10 * log10(sum(pow(10e0, level / 10))), 5) AS level, count(*) AS n FROM l GROUP BY x, y",
)
def _t20_terrain(df: DataFrame) -> DataFrame:
    sources = df.where("x % 97 = 0 AND y % 11 = 0").select((F.col("y") * 400 + F.col("x")).alias("source_id"), "x", "y", (95 + F.col("x") % 7).cast("double").alias("power_db"), F.lit(2.0).alias("height_m"))
    receivers = df.where("x % 7 = 0 AND y % 7 = 0").select("x", "y")
    return acoustics.terrain_levels(sources, receivers, df, 450.0).withColumn("level", F.round("level", 5))
