"""Named queries of selections, alerts and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions import physics
from sextant.operators import grids, quality, selection, spatial
from sextant.plans.registry import _hav, _on, _query, _r
from sextant.plans.views import view, with_views

_D = _hav("a.lat", "a.lon", "b.lat", "b.lon")
_WEIGHTS = {"quake": 5.0, "fire": 3.0, "lightning": 2.0}


@_on("features", "o4_weighted_selection", "SELECT id, layer, CASE layer WHEN 'quake' THEN 5.0::DOUBLE WHEN 'fire' THEN 3.0::DOUBLE WHEN 'lightning' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM features ORDER BY weight DESC, id LIMIT 50")
def _o4(df: DataFrame) -> DataFrame:
    return selection.weighted_selection(df, _WEIGHTS, 50).select("id", "layer", "weight")


@_on("features", "o8_scene_selection", "SELECT cx, cy, id, cloud FROM (SELECT CAST(floor(lon / 20) AS BIGINT) AS cx, CAST(floor(lat / 20) AS BIGINT) AS cy, id, heading AS cloud, row_number() OVER (PARTITION BY floor(lon / 20), floor(lat / 20) ORDER BY heading, freshness DESC, id) AS r FROM features WHERE layer = 'vessel' AND heading < 90) WHERE r = 1")
def _o8(df: DataFrame) -> DataFrame:
    scenes = df.where("layer = 'vessel' AND heading < 90").withColumns({"cx": F.floor(F.col("lon") / 20), "cy": F.floor(F.col("lat") / 20)})
    return selection.best_in_cell(scenes, ["cx", "cy"], [F.col("heading"), F.desc("freshness"), F.col("id")]).select("cx", "cy", "id", F.col("heading").alias("cloud"))


@_on("features", "o10_latest_date", "SELECT layer, max(date_trunc('day', freshness)) AS day, count(DISTINCT date_trunc('day', freshness)) AS days FROM features WHERE freshness >= TIMESTAMP '2024-01-17' GROUP BY layer")
def _o10(df: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "freshness").cast("timestamp_ntz")
    return df.where("freshness >= TIMESTAMP_NTZ '2024-01-17 00:00:00'").groupBy("layer").agg(F.max(day).alias("day"), F.countDistinct(day).alias("days"))


@_on("features", "o11_quake_list", "SELECT id, mag FROM features WHERE layer = 'quake' AND mag >= 25 ORDER BY mag DESC, id LIMIT 100")
def _o11(df: DataFrame) -> DataFrame:
    return df.where("layer = 'quake' AND mag >= 25").select("id", "mag").orderBy(F.desc("mag"), "id").limit(100)


@_on("features", "o2_truncated", "SELECT count(*) AS total, least(count(*), 50) AS returned, count(*) > 50 AS truncated FROM features WHERE speed > 280")
def _o2(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.where("speed > 280").agg(n.alias("total"), F.least(n, F.lit(50)).alias("returned"), (n > 50).alias("truncated"))


_ALERTS = ", al AS (SELECT id, layer, CASE WHEN mag >= 70 THEN 'critical' WHEN mag >= 40 THEN 'high' WHEN mag >= 10 THEN 'moderate' ELSE 'low' END AS severity FROM features WHERE layer IN ('quake', 'fire'))"


def _alerts(df: DataFrame) -> DataFrame:
    severity = F.when(F.col("mag") >= 70, "critical").when(F.col("mag") >= 40, "high").when(F.col("mag") >= 10, "moderate").otherwise("low")
    return df.where("layer IN ('quake', 'fire')").select("id", "layer", severity.alias("severity"), "speed")


@_on("features", "p8_suppress", _ALERTS + " SELECT id, layer, severity FROM al WHERE severity IN ('high', 'critical') AND id NOT IN (SELECT id FROM features WHERE speed < 30)")
def _p8(df: DataFrame) -> DataFrame:
    return selection.suppress(_alerts(df), df.where("speed < 30"), "high").select("id", "layer", "severity")


@_on("features", "a21_alert_summary", _ALERTS + " SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM al")
def _a21(df: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("severity") == s).cast("long")).alias(s)
    return _alerts(df).agg(F.count("*").alias("total"), n("critical"), n("high"))


@_on("features", "o5_severity_order", _ALERTS + " SELECT id, severity FROM al ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END DESC, id LIMIT 40")
def _o5(df: DataFrame) -> DataFrame:
    return _alerts(df).orderBy(selection.severity_rank(F.col("severity")).desc(), "id").limit(40).select("id", "severity")


@_on(
    "connections", "n2_cooldown_alerts",
    ", o AS (SELECT process, remote_ip, seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY process, remote_ip ORDER BY ts, seq) AS i FROM connections), "
    "nx AS (SELECT a.process, a.remote_ip, a.i, min(b.i) AS j FROM o a JOIN o b ON a.process = b.process AND a.remote_ip = b.remote_ip AND b.i > a.i AND b.us >= a.us + 30000000000 GROUP BY ALL), "
    "al(process, remote_ip, i) AS (SELECT process, remote_ip, 1 FROM o WHERE i = 1 UNION SELECT nx.process, nx.remote_ip, nx.j FROM al JOIN nx USING (process, remote_ip, i)) "
    "SELECT process, remote_ip, seq FROM al JOIN o USING (process, remote_ip, i)",
)
def _n2(df: DataFrame) -> DataFrame:
    return selection.cooldown_alerts(df, ["process", "remote_ip"], 30000.0).select("process", "remote_ip", "seq")


@_on("connections", "n5_process_status", ", q AS (SELECT process, avg(CASE WHEN latency_ms = 0 THEN 1.0 ELSE 0.0 END) AS loss, avg(latency_ms) AS l FROM connections GROUP BY process) SELECT process, round(loss, 6) AS loss, CASE WHEN loss > 0.5 THEN 'offline' WHEN loss > 0.2 OR l > 60 THEN 'degraded' ELSE 'healthy' END AS status FROM q")
def _n5(df: DataFrame) -> DataFrame:
    q = df.groupBy("process").agg(F.avg((F.col("latency_ms") == 0).cast("double")).alias("loss"), F.avg("latency_ms").alias("l"))
    return q.select("process", _r("loss", "loss"), F.when(F.col("loss") > 0.5, "offline").when((F.col("loss") > 0.2) | (F.col("l") > 60), "degraded").otherwise("healthy").alias("status"))


@_query("j5_event_aircraft", with_views("features") + f"SELECT a.id, b.id AS r_id, round({_D}, 6) AS distance_km FROM (SELECT * FROM features WHERE layer = 'quake' AND mag > 40) a JOIN (SELECT * FROM features WHERE layer = 'aircraft' AND height < 3000 AND speed > 20) b ON {_D} <= 700")
def _j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, kept = view(spark, sf_dir, "features"), ["id", "lat", "lon"]
    met = spatial.radius_join(f.where("layer = 'quake' AND mag > 40").select(*kept), f.where("layer = 'aircraft' AND height < 3000 AND speed > 20").select(*kept), 700.0, decimals=6)
    return met.select("id", "r_id", "distance_km")


@_query("j6_snapshot_assets", with_views("assets", "measurements") + ", k AS (SELECT max(wave_height) AS kp FROM measurements) SELECT id, type, greatest(0, least(5, CAST(floor(kp) AS INT) - 4)) AS g FROM assets, k WHERE kp >= 5 AND type IN ('power_plant', 'substation', 'transformer') AND active")
def _j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kp = view(spark, sf_dir, "measurements").agg(F.max("wave_height").alias("kp")).where("kp >= 5")
    exposed = view(spark, sf_dir, "assets").where("active AND type IN ('power_plant', 'substation', 'transformer')")
    return exposed.crossJoin(F.broadcast(kp)).select("id", "type", physics.storm_scale(F.col("kp")).alias("g"))


@_query("t20_sound_levels", with_views("assets", "stations") + f"SELECT id, count(*) AS sources, round(10 * log10(sum(pow(10, (lw - (20 * log10(greatest(1.0, d * 1000)) + 10 * log10(4 * pi())) - 0.05 * d) / 10))), 6) AS level_db FROM (SELECT a.id, b.capacity_mw / 100 AS lw, {_D} AS d FROM stations a JOIN assets b ON {_D} <= 1000) GROUP BY id")
def _t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = view(spark, sf_dir, "assets").select("id", "lat", "lon", (F.col("capacity_mw") / 100).alias("lw"))
    out = selection.sound_levels(sources, view(spark, sf_dir, "stations"), 1000.0, air_db_km=0.05)
    return out.select("id", "sources", _r("level_db", "level_db"))


@_on("dem", "t6_baseline_mask", "SELECT a.x, a.y, CASE WHEN abs(a.v - b.v) > 50 THEN 1 ELSE 0 END AS anomalous FROM dem a JOIN dem b ON a.x = b.x AND a.y = b.y + 1")
def _t6(df: DataFrame) -> DataFrame:
    base = df.select("x", (F.col("y") + 1).alias("y"), F.col("v").alias("base"))
    return df.join(base, ["x", "y"]).select("x", "y", F.when(F.abs(F.col("v") - F.col("base")) > 50, 1).otherwise(0).alias("anomalous"))


@_on("dem", "t19_colour_ramp", "SELECT x, y, CAST(floor(CASE WHEN v <= 100 THEN 0 + 255 * v / 100 WHEN v <= 200 THEN 255 ELSE 255 END + 0.5) AS INT) AS r, CAST(floor(CASE WHEN v <= 100 THEN 100 + 100 * v / 100 WHEN v <= 200 THEN 200 - 200 * (v - 100) / 100 ELSE 0 END + 0.5) AS INT) AS g, CAST(floor(CASE WHEN v <= 100 THEN 50 - 50 * v / 100 ELSE 0 END + 0.5) AS INT) AS b FROM dem")
def _t19(df: DataFrame) -> DataFrame:
    colour = selection.ramp(F.col("v"), [(0.0, (0, 100, 50)), (100.0, (255, 200, 0)), (200.0, (255, 0, 0))])
    return df.select("x", "y", colour.alias("c")).select("x", "y", "c.r", "c.g", "c.b")


@_on("stations", "t21_pixel_window", "SELECT id, CAST(greatest(0, least(3600, floor((lon - 1 + 180) / 0.1))) AS INT) AS x0, CAST(greatest(0, least(1800, floor((90 - (lat + 1)) / 0.1))) AS INT) AS y0, CAST(greatest(0, least(3600, ceil((lon + 1 + 180) / 0.1))) AS INT) AS x1, CAST(greatest(0, least(1800, ceil((90 - (lat - 1)) / 0.1))) AS INT) AS y1 FROM stations")
def _t21(df: DataFrame) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    w = selection.pixel_window((lon - 1, lat - 1, lon + 1, lat + 1), (-180.0, 90.0), 0.1, (3600, 1800))
    return df.select("id", *[c.alias(n) for c, n in zip(w, ("x0", "y0", "x1", "y1"), strict=True)])


@_on("dem", "p22_vegetation_class", "SELECT x, y, CASE WHEN i < 0 THEN 'water' WHEN i < 0.1 THEN 'bare' WHEN i < 0.2 THEN 'sparse' WHEN i < 0.4 THEN 'grass' WHEN i < 0.6 THEN 'shrub' WHEN i < 0.8 THEN 'forest' ELSE 'dense' END AS class FROM (SELECT x, y, CASE WHEN v + 3 * x > 0 THEN (v - 3 * x) / (v + 3 * x) ELSE 0 END AS i FROM dem)")
def _p22(df: DataFrame) -> DataFrame:
    i = grids.band_index(F.col("v"), 3 * F.col("x"))
    kind = F.when(i < 0, "water").when(i < 0.1, "bare").when(i < 0.2, "sparse").when(i < 0.4, "grass").when(i < 0.6, "shrub").when(i < 0.8, "forest").otherwise("dense")
    return df.select("x", "y", kind.alias("class"))


@_on("measurements", "v11_density_range", "SELECT station_id, seq, round(d, 6) AS density FROM (SELECT station_id, seq, 999.842594 + 6.793952e-2*t - 9.09529e-3*t*t + 1.001685e-4*pow(t,3) - 1.120083e-6*pow(t,4) + 6.536332e-9*pow(t,5) + (8.24493e-1 - 4.0899e-3*t + 7.6438e-5*t*t - 8.2467e-7*pow(t,3) + 5.3875e-9*pow(t,4))*s + (-5.72466e-3 + 1.0227e-4*t - 1.6546e-6*t*t)*pow(s,1.5) + 4.8314e-4*s*s AS d FROM (SELECT *, water_temp AS t, salinity AS s FROM measurements WHERE salinity IS NOT NULL)) WHERE d < 1018 OR d > 1030")
def _v11(df: DataFrame) -> DataFrame:
    d = df.where("salinity IS NOT NULL").withColumn("d", physics.seawater_density(F.col("water_temp"), F.col("salinity")))
    return d.where("d < 1018 OR d > 1030").select("station_id", "seq", _r("d", "density"))


@_on("measurements", "a29_cycle_traffic", "SELECT date_trunc('day', ts) AS cycle, count(*) AS total, count(DISTINCT station_id) AS active, count(*) FILTER (water_temp > 40) AS flagged FROM measurements GROUP BY 1")
def _a29(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("cycle")).agg(F.count("*").alias("total"), F.countDistinct("station_id").alias("active"), F.sum((F.col("water_temp") > 40).cast("long")).alias("flagged"))


@_on("measurements", "g5_new_stations", "SELECT station_id, min(seq) AS first_seq FROM measurements GROUP BY station_id HAVING min(ts) >= TIMESTAMP '2024-01-02'")
def _g5(df: DataFrame) -> DataFrame:
    known = df.where("ts < TIMESTAMP_NTZ '2024-01-02 00:00:00'").select("station_id").distinct()
    return df.join(known, "station_id", "left_anti").groupBy("station_id").agg(F.min("seq").alias("first_seq"))


@_on("measurements", "w3_rolling_health", "SELECT station_id, seq, round(avg(CASE WHEN air_temp IS NULL THEN 0.0 ELSE 100.0 END) OVER (PARTITION BY station_id ORDER BY seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS health FROM measurements")
def _w3(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("station_id").orderBy("seq").rowsBetween(-59, 0)
    return df.select("station_id", "seq", _r(F.avg(F.when(F.col("air_temp").isNull(), 0.0).otherwise(100.0)).over(w), "health"))


@_on("measurements", "v6_health_score", ", f AS (SELECT station_id, count(*) AS n, count(air_temp) AS a, count(salinity) AS s FROM measurements GROUP BY station_id) SELECT station_id, p AS penalty, 100 - p AS score, CASE WHEN 100 - p >= 80 THEN 'healthy' WHEN 100 - p >= 50 THEN 'degraded' ELSE 'failing' END AS status FROM (SELECT station_id, least(100, CAST(floor(60.0 * (n - a) / n) AS INT) + CAST(floor(60.0 * (n - s) / n) AS INT)) AS p FROM f)")
def _v6(df: DataFrame) -> DataFrame:
    f = df.groupBy("station_id").agg(F.count("*").alias("n"), F.count("air_temp").alias("a"), F.count("salinity").alias("s"))
    lost = lambda c: F.floor(60.0 * (F.col("n") - F.col(c)) / F.col("n")).cast("int")
    out = f.select("station_id", F.least(F.lit(100), lost("a") + lost("s")).alias("penalty")).withColumn("score", 100 - F.col("penalty"))
    return out.withColumn("status", F.when(F.col("score") >= 80, "healthy").when(F.col("score") >= 50, "degraded").otherwise("failing"))


@_query("a5_integrity_summary", with_views("measurements") + ", long AS (SELECT 'water_temp' AS field, water_temp AS v FROM measurements UNION ALL SELECT 'pressure', pressure FROM measurements UNION ALL SELECT 'wave_height', wave_height FROM measurements) SELECT field, count(*) AS n, count(*) FILTER (CASE field WHEN 'water_temp' THEN v < -2.5 OR v > 40 WHEN 'pressure' THEN v < 850 OR v > 1100 ELSE v < 0 OR v > 30 END) AS flagged FROM long GROUP BY field")
def _a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = quality.to_long(view(spark, sf_dir, "measurements"), ["water_temp", "pressure", "wave_height"])
    flags = quality.bounds_flags(long).groupBy("field").agg(F.count("*").alias("flagged"))
    return long.groupBy("field").agg(F.count("*").alias("n")).join(flags, "field", "left").select("field", "n", F.coalesce("flagged", F.lit(0)).alias("flagged"))
