"""More named queries: neighbours, profiles, tracks, patterns, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions import geo, physics
from sextant.operators import network, quality, rollups, spatial
from sextant.plans.registry import _hav, _on, _query, _r
from sextant.plans.views import view, with_views

_D = _hav("a.lat", "a.lon", "b.lat", "b.lon")
_LATEST = ", latest AS (SELECT id, lat, lon, arg_max(water_temp, seq) AS v FROM measurements JOIN stations ON id = station_id GROUP BY id, lat, lon)"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = view(spark, sf_dir, "measurements").groupBy("station_id").agg(F.max_by("water_temp", "seq").alias("v"))
    return view(spark, sf_dir, "stations").select("id", "lat", "lon").join(last, F.col("id") == F.col("station_id")).drop("station_id")


@_query("v13_cluster_outliers", with_views("stations", "measurements") + _LATEST + f"SELECT id, v AS value, n, round(m, 6) AS mean, round((v - m) / s, 6) AS z FROM (SELECT a.id, any_value(a.v) AS v, count(*) AS n, avg(b.v) AS m, stddev_pop(b.v) AS s FROM latest a JOIN latest b ON a.id <> b.id AND {_D} <= 300 GROUP BY a.id) WHERE n >= 3 AND s > 0 AND abs((v - m) / s) > 1.5")
def _v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.cluster_outliers(_latest(spark, sf_dir), "v", 300.0, limit=1.5).select("id", "value", "n", _r("mean", "mean"), _r("z", "z"))


@_query("v9_neighbour_mismatch", with_views("stations", "measurements") + _LATEST + f"SELECT a.id, b.id AS r_id, round(abs(a.v - b.v), 6) AS gap FROM latest a JOIN latest b ON a.id <> b.id AND {_D} <= 200 AND abs(a.v - b.v) > 5")
def _v9(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.col("v") - F.col("r_v"))
    return spatial.radius_self_join(_latest(spark, sf_dir), 200.0).where(gap > 5).select("id", "r_id", _r(gap, "gap"))


@_on("measurements", "v5_misses", ", m AS (SELECT station_id, seq, air_temp IS NULL AS miss, max(seq) FILTER (air_temp IS NOT NULL) OVER (PARTITION BY station_id) AS last FROM measurements) SELECT station_id, count(*) AS n, round(100.0 * count(*) FILTER (NOT miss) / count(*), 6) AS uptime, count(*) FILTER (miss AND seq > coalesce(last, -1)) AS consecutive, count(*) FILTER (miss AND seq > coalesce(last, -1)) >= 3 AS offline FROM m GROUP BY station_id")
def _v5(df: DataFrame) -> DataFrame:
    return rollups.misses(df, "station_id", F.col("air_temp").isNull()).withColumn("uptime", F.round("uptime", 6))


@_on("measurements", "v16_sequence_health", ", m AS (SELECT *, lag(ts) OVER w AS p, lag(water_temp) OVER w AS q FROM measurements WINDOW w AS (PARTITION BY station_id ORDER BY seq)) SELECT station_id, count(*) FILTER (ts < p) AS out_of_order, count(*) FILTER (water_temp = q) AS repeats, count(*) AS n FROM m GROUP BY station_id")
def _v16(df: DataFrame) -> DataFrame:
    by = Window.partitionBy("station_id").orderBy("seq")
    m = df.select("station_id", (F.col("ts") < F.lag("ts").over(by)).alias("back"), (F.col("water_temp") == F.lag("water_temp").over(by)).alias("again"))
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return m.groupBy("station_id").agg(count("back").alias("out_of_order"), count("again").alias("repeats"), F.count("*").alias("n"))


@_on("measurements", "g3_rate_of_change", "SELECT station_id, seq, round(c, 6) AS change FROM (SELECT station_id, seq, abs(wave_height - p) / p AS c FROM (SELECT *, lag(wave_height) OVER (PARTITION BY station_id ORDER BY seq) AS p FROM measurements WHERE wave_height > 0)) WHERE c > 0.5")
def _g3(df: DataFrame) -> DataFrame:
    before = F.lag("wave_height").over(Window.partitionBy("station_id").orderBy("seq"))
    out = df.where("wave_height > 0").select("station_id", "seq", (F.abs(F.col("wave_height") - before) / before).alias("c"))
    return out.where("c > 0.5").select("station_id", "seq", _r("c", "change"))


@_on("dem", "w2_profile", "SELECT y, CAST(sum(run) AS DOUBLE) AS length_m, round(sum(greatest(0, rise)), 6) AS ascent, round(sum(greatest(0, -rise)), 6) AS descent, round(max(abs(rise / run)), 6) AS steepest FROM (SELECT y, v - lag(v) OVER w AS rise, (x - lag(x) OVER w) * 30.0 AS run FROM dem WINDOW w AS (PARTITION BY y ORDER BY x)) WHERE rise IS NOT NULL GROUP BY y")
def _w2(df: DataFrame) -> DataFrame:
    return rollups.profile(df).select("y", "length_m", *[_r(c, c) for c in ("ascent", "descent", "steepest")])


@_on("features", "a27_track_length", ", t AS (SELECT user_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM features WINDOW w AS (PARTITION BY user_id ORDER BY id)) SELECT user_id, count(*) AS points, round(coalesce(sum(" + _hav("plat", "plon", "lat", "lon") + "), 0), 3) AS km FROM t GROUP BY user_id")
def _a27(df: DataFrame) -> DataFrame:
    return rollups.track_length(df, "user_id", "id").select("user_id", "points", F.round("km", 3).alias("km"))


@_on("features", "a24_layer_extent", "SELECT layer, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM features GROUP BY layer")
def _a24(df: DataFrame) -> DataFrame:
    return df.groupBy("layer").agg(_r(F.avg("lat"), "lat"), _r(F.avg("lon"), "lon"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


@_query("a12_region_correlation", with_views("stations", "measurements") + "SELECT source, count(*) AS n, round(corr(water_temp, pressure), 6) AS r FROM measurements JOIN stations ON id = station_id GROUP BY source HAVING count(*) >= 3")
def _a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = view(spark, sf_dir, "stations").select(F.col("id").alias("station_id"), "source")
    out = view(spark, sf_dir, "measurements").join(stations, "station_id").groupBy("source").agg(F.count("*").alias("n"), _r(F.corr("water_temp", "pressure"), "r"))
    return out.where("n >= 3")


@_query("a14_uniformity", with_views("stations", "measurements") + _LATEST + "SELECT count(*) AS n, round(stddev_pop(v) / avg(v), 6) AS cv, count(*) > 100 AND stddev_pop(v) / avg(v) < 0.1 AS suspicious FROM latest")
def _a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = F.stddev_pop("v") / F.avg("v")
    return _latest(spark, sf_dir).agg(F.count("*").alias("n"), _r(cv, "cv"), ((F.count("*") > 100) & (cv < 0.1)).alias("suspicious"))


@_on("measurements", "a20_daily_totals", "SELECT station_id, date_trunc('day', ts) AS day, min(air_temp) AS low, max(air_temp) AS high, round(sum(wave_height), 6) AS total FROM measurements GROUP BY 1, 2")
def _a20(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.min("air_temp").alias("low"), F.max("air_temp").alias("high"), _r(F.sum("wave_height"), "total"))


@_on("connections", "a16_outage_patterns", ", b AS (SELECT process, seq, latency_ms = 0 AS bad, coalesce(lag(latency_ms = 0) OVER (PARTITION BY process ORDER BY seq), false) AS was FROM connections), s AS (SELECT *, sum(CASE WHEN bad AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY process ORDER BY seq) AS k FROM b), o AS (SELECT process, k, count(*) AS n FROM s WHERE bad GROUP BY process, k), l AS (SELECT process, n, count(*) AS c FROM o GROUP BY process, n), m AS (SELECT process, n AS common FROM (SELECT *, row_number() OVER (PARTITION BY process ORDER BY c DESC, n) AS r FROM l) WHERE r = 1) SELECT o.process, count(*) AS outages, round(avg(n), 6) AS mean_n, max(n) AS longest, any_value(common) AS common FROM o JOIN m ON o.process = m.process GROUP BY o.process")
def _a16(df: DataFrame) -> DataFrame:
    out = rollups.outage_patterns(quality.sessions(df, "process", F.col("latency_ms") == 0), "process")
    return out.withColumn("mean_n", F.round("mean_n", 6))


@_on("connections", "a18_process_totals", "SELECT process, count(*) AS n, count(DISTINCT conn_id) AS connections, round(sum(latency_ms), 4) AS total, round(arg_max(latency_ms, seq), 6) AS latest FROM connections GROUP BY process ORDER BY total DESC, process LIMIT 10")
def _a18(df: DataFrame) -> DataFrame:
    out = df.groupBy("process").agg(F.count("*").alias("n"), F.countDistinct("conn_id").alias("connections"), F.round(F.sum("latency_ms"), 4).alias("total"), _r(F.max_by("latency_ms", "seq"), "latest"))
    return out.orderBy(F.desc("total"), "process").limit(10)


@_on("connections", "n9_hop_stats", "SELECT remote_ip, round(avg(latency_ms) FILTER (latency_ms > 0), 6) AS latency_ms, round(100.0 * count(*) FILTER (latency_ms = 0) / count(*), 6) AS loss_pct FROM connections GROUP BY remote_ip")
def _n9(df: DataFrame) -> DataFrame:
    lost = (F.col("latency_ms") == 0).cast("double")
    return df.groupBy("remote_ip").agg(_r(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), "latency_ms"), _r(100.0 * F.sum(lost) / F.count("*"), "loss_pct"))


@_on("connections", "n3_expiry", ", l AS (SELECT max(ts) AS now FROM connections) SELECT conn_id, max(ts) AS last_seen FROM connections, l GROUP BY conn_id, now HAVING max(ts) >= now - INTERVAL 5 DAY")
def _n3(df: DataFrame) -> DataFrame:
    last = df.groupBy("conn_id").agg(F.max("ts").alias("last_seen"))
    now = df.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).where(F.col("last_seen") >= F.col("now") - F.expr("INTERVAL 5 DAYS")).drop("now")


@_on("connections", "p9_private_ip", "SELECT remote_ip, remote_ip LIKE '10.%' OR remote_ip LIKE '192.168.%' AS private, count(*) AS n FROM connections GROUP BY ALL")
def _p9(df: DataFrame) -> DataFrame:
    return df.groupBy("remote_ip", network.is_private_ip(F.col("remote_ip")).alias("private")).agg(F.count("*").alias("n"))


@_on("measurements", "p18_weather_text", "SELECT station_id, seq, CASE CAST(wind_speed AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rollups.WEATHER_CODES.items()) + " ELSE 'unknown' END AS weather FROM measurements")
def _p18(df: DataFrame) -> DataFrame:
    return df.select("station_id", "seq", rollups.weather_text(F.col("wind_speed")).alias("weather"))


@_on("measurements", "p16_space_weather", "SELECT station_id, seq, greatest(0, least(5, CAST(floor(wave_height) AS INT) - 4)) AS g FROM measurements")
def _p16(df: DataFrame) -> DataFrame:
    return df.select("station_id", "seq", physics.storm_scale(F.col("wave_height")).alias("g"))


@_on("features", "p6_tiles_in_view", "SELECT id, CASE WHEN height > 500 THEN 'far' ELSE 'near' END AS detail FROM features WHERE lon BETWEEN -30 AND 30 AND lat BETWEEN -25 AND 25")
def _p6(df: DataFrame) -> DataFrame:
    seen = spatial.scope_box(df, -25.0 - 5, -20.0 - 5, 25.0 + 5, 20.0 + 5)
    return seen.select("id", F.when(F.col("height") > 500, "far").otherwise("near").alias("detail"))


@_on("features", "p19_props_numbers", "SELECT id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM features WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _p19(df: DataFrame) -> DataFrame:
    parsed = df.select("id", F.from_json("props", "k int").alias("p"))
    return parsed.select("id", F.col("p.k").alias("k")).where("k IS NOT NULL")


@_query("j8_cell_lookup", with_views("stations", "dem") + "SELECT id, v AS elevation FROM stations LEFT JOIN dem ON x = CAST(floor((lon + 180) / 9) AS INT) AND y = CAST(floor((lat + 90) / 45) AS INT)")
def _j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = view(spark, sf_dir, "stations").select("id", F.floor((F.col("lon") + 180) / 9).cast("int").alias("x"), F.floor((F.col("lat") + 90) / 45).cast("int").alias("y"))
    return cell.join(view(spark, sf_dir, "dem"), ["x", "y"], "left").select("id", F.col("v").alias("elevation"))


@_query("j10_nearest_distance", with_views("stations", "assets") + f"SELECT a.id, round(min({_D}), 6) AS distance_km, CASE WHEN min({_D}) <= 200 THEN 1.0 ELSE round((1500 - min({_D})) / 1300, 6) END AS score FROM stations a JOIN assets b ON {_D} <= 1500 GROUP BY a.id")
def _j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = spatial.radius_join(view(spark, sf_dir, "stations").select("id", "lat", "lon"), view(spark, sf_dir, "assets").select("id", "lat", "lon"), 1500.0)
    d = F.col("d")
    near = met.groupBy("id").agg(F.min("distance_km").alias("d"))
    return near.select("id", _r("d", "distance_km"), F.when(d <= 200, 1.0).otherwise(F.round((1500 - d) / 1300, 6)).alias("score"))


@_query("j13_nearby_maximum", with_views("features", "assets") + f"SELECT b.id, count(*) AS n, max(a.mag) AS most FROM features a JOIN assets b ON a.layer = 'lightning' AND {_D} <= 800 GROUP BY b.id")
def _j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    strikes = view(spark, sf_dir, "features").where("layer = 'lightning'").select("id", "lat", "lon", "mag")
    met = spatial.radius_join(view(spark, sf_dir, "assets").select("id", "lat", "lon"), strikes, 800.0)
    return met.groupBy("id").agg(F.count("*").alias("n"), F.max("r_mag").alias("most"))


@_query("o9_whats_near", with_views("features") + f"SELECT id, layer, round({_hav('0.0', '0.0', 'lat', 'lon')}, 6) AS distance_km FROM features WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40 ORDER BY {_hav('0.0', '0.0', 'lat', 'lon')}, id LIMIT 50")
def _o9(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spatial.scope_box(view(spark, sf_dir, "features"), -60.0, -40.0, 60.0, 40.0)
    far = seen.withColumn("distance_km", geo.haversine_km(F.lit(0.0), F.lit(0.0), F.col("lat"), F.col("lon")))
    return spatial.sort_and_limit(far, "distance_km", descending=False, limit=50).select("id", "layer", _r("distance_km", "distance_km"))


_KEPT = "{'id': q.id, 'lat': q.lat, 'lon': q.lon, 'score': q.mag}"


@_query(
    "o6_thinning",
    with_views("features").replace("WITH", "WITH RECURSIVE", 1)
    + ", q AS (SELECT id, lat, lon, mag, row_number() OVER (ORDER BY mag DESC, id) AS i FROM features WHERE layer = 'quake'), "
    + f"g(i, kept) AS (SELECT q.i, [{_KEPT}] FROM q WHERE i = 1 UNION ALL SELECT q.i, CASE WHEN len(list_filter(g.kept, lambda k: {_hav('k.lat', 'k.lon', 'q.lat', 'q.lon')} <= 800)) = 0 THEN list_append(g.kept, {_KEPT}) ELSE g.kept END FROM g JOIN q ON q.i = g.i + 1), "
    + "s AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)) SELECT k.id AS id, k.lat AS lat, k.lon AS lon, k.score AS score FROM s",
)
def _o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    quakes = view(spark, sf_dir, "features").where("layer = 'quake'").select("id", "lat", "lon", F.col("mag").alias("score"))
    return rollups.thin(quakes, 800.0)


@_query("a25_hulls")
def _a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "features").select("layer", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rollups.hulls(points, "layer")


@_on("stations", "u4_undirected_pairs", f"SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM stations a JOIN stations b ON a.id <> b.id AND {_D} <= 100")
def _u4(df: DataFrame) -> DataFrame:
    # distances are the same both ways and a station has one row, so each pair comes once
    return spatial.radius_self_join(df.select("id", "lat", "lon"), 100.0).where("id < r_id").select(F.col("id").alias("a"), F.col("r_id").alias("b"))

