"""Named queries of health scores, agreement between neighbours and peers, links, and the wider summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import geo
from sextant.operators import agreement, health, rollups
from sextant.plans.registry import _hav, _on, _query, _r
from sextant.plans.views import AS_OF, view, with_views

_D = _hav("a.lat", "a.lon", "b.lat", "b.lon")

# -- stations ----------------------------------------------------------------------------------------------------------

_INTERVALS = {"NOAA_NDBC": 3600.0 * 6, "ARGO": 86400.0 * 2, "NWS_WEATHER": 3600.0, "PMEL_CO2": 3600.0 * 48}
_EXPECTED = {"NOAA_NDBC": ["water_temp", "air_temp", "wind_speed", "wave_height", "pressure"], "ARGO": ["water_temp", "salinity"], "NWS_WEATHER": ["air_temp", "wind_speed", "pressure"], "PMEL_CO2": ["water_temp", "salinity"], "TAO_PIRATA": ["water_temp", "salinity"]}
_FIELDS = sorted({f for names in _EXPECTED.values() for f in names})


def _lacking(source: str) -> str:
    return " + ".join(f"CAST(m IS NULL OR m.{f} IS NULL AS INT)" for f in _EXPECTED[source])


_PENALTIES = (
    with_views("stations", "measurements")
    + ", l AS (SELECT station_id, max(ts) AS ts, arg_max({" + ", ".join(f"'{f}': {f}" for f in _FIELDS) + "}, seq) AS m FROM measurements GROUP BY station_id),"
    " o AS (SELECT station_id, seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY station_id ORDER BY seq DESC) AS r FROM measurements),"
    " g AS (SELECT station_id, t - lag(t) OVER (PARTITION BY station_id ORDER BY seq) AS gap FROM o WHERE r BETWEEN 2 AND 51),"
    " reg AS (SELECT station_id, CASE WHEN avg(gap) > 0 THEN greatest(0e0, 1 - stddev_pop(gap) / avg(gap)) ELSE 0e0 END AS regularity FROM g GROUP BY station_id HAVING count(*) >= 3),"
    " ms AS (SELECT station_id, count(*) FILTER (air_temp IS NULL AND seq > coalesce(last, -1)) AS consecutive FROM (SELECT *, max(seq) FILTER (air_temp IS NOT NULL) OVER (PARTITION BY station_id) AS last FROM measurements) GROUP BY station_id),"
    f" b AS (SELECT s.id AS station_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(l.ts)) / 1e6 AS age, CASE s.source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _INTERVALS.items()) + " ELSE 3600.0 END AS expected, CASE s.source "
    + " ".join(f"WHEN '{s}' THEN {_lacking(s)}" for s in _EXPECTED) + " ELSE 0 END AS lacking, regularity, consecutive FROM stations s LEFT JOIN l ON s.id = l.station_id LEFT JOIN reg ON s.id = reg.station_id LEFT JOIN ms ON s.id = ms.station_id),"
    " p AS (SELECT station_id, CASE WHEN age IS NULL THEN 'missing' WHEN age > 2 * expected THEN 'very_late' ELSE 'late' END AS rule, CASE WHEN age IS NULL THEN 30 WHEN age > 2 * expected THEN 25 ELSE 10 END AS penalty FROM b WHERE age IS NULL OR age > expected"
    " UNION ALL SELECT station_id, 'irregular', 15 FROM b WHERE regularity < 0.4 UNION ALL SELECT station_id, 'incomplete', 5 * lacking FROM b WHERE lacking > 0 UNION ALL SELECT station_id, 'offline', 20 FROM b WHERE consecutive >= 3) "
)


def _penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = view(spark, sf_dir, "measurements")
    misses = rollups.misses(reports, "station_id", F.col("air_temp").isNull())
    return health.station_penalties(view(spark, sf_dir, "stations"), reports, F.lit(AS_OF), _INTERVALS, _EXPECTED, misses)


@_query("v1_station_penalties", _PENALTIES + "SELECT station_id, rule, CAST(penalty AS INT) AS penalty FROM p")
def _v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _penalties(spark, sf_dir)


@_query("v6_station_health", _PENALTIES + ", h AS (SELECT id AS station_id, CAST(coalesce(sum(penalty), 0) AS BIGINT) AS penalty FROM stations LEFT JOIN p ON id = station_id GROUP BY id) SELECT station_id, penalty, greatest(0, 100 - penalty) AS score, CASE WHEN penalty <= 20 THEN 'verified' WHEN penalty <= 50 THEN 'warning' ELSE 'failed' END AS status FROM h")
def _v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health_scores(view(spark, sf_dir, "stations"), _penalties(spark, sf_dir))


@_on("measurements", "v2_recent_regularity", ", o AS (SELECT station_id, seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY station_id ORDER BY seq DESC) AS r FROM measurements), g AS (SELECT station_id, t - lag(t) OVER (PARTITION BY station_id ORDER BY seq) AS gap FROM o WHERE r BETWEEN 2 AND 51) SELECT station_id, round(CASE WHEN count(*) < 3 THEN NULL WHEN avg(gap) > 0 THEN greatest(0e0, 1 - stddev_pop(gap) / avg(gap)) ELSE 0e0 END, 6) AS regularity FROM g GROUP BY station_id")
def _v2(df: DataFrame) -> DataFrame:
    return health.recent_regularity(df).select("station_id", _r("regularity", "regularity"))


# -- sources and networks ----------------------------------------------------------------------------------------------

_LOG = """SELECT concat('src', CAST(user_id % 5 AS STRING)) AS source, CAST(floor(CAST(event_id AS DOUBLE) / CAST(200 AS DOUBLE)) AS BIGINT) AS fetch_no,
 user_id AS station_id, date_trunc('day', ts) AS ts, event_id FROM events"""
_FETCHES = """SELECT source, fetch_no, CAST((fetch_no * 917 + 13) % 6500 AS DOUBLE) AS latency_ms, CAST(count(*) * 100 AS DOUBLE) + CAST((fetch_no * 31) % 7000 AS DOUBLE) AS payload,
 count(DISTINCT station_id) AS received, CAST(20 + fetch_no % 20 AS BIGINT) AS expected, fetch_no % 4 <> 2 AS ok FROM log GROUP BY source, fetch_no"""


@_query(
    "v16_fetch_scores",
    f"WITH log AS ({_LOG}), f AS ({_FETCHES}), n AS (SELECT *, lag(fetch_no) OVER w AS prev, avg(CAST(ok AS INT)) OVER w AS success, avg(payload) OVER (PARTITION BY source ORDER BY fetch_no ROWS 49 PRECEDING) AS mean FROM f WINDOW w AS (PARTITION BY source ORDER BY fetch_no)),"
    " p AS (SELECT DISTINCT source, fetch_no, station_id, ts FROM log), d AS (SELECT n.source, n.fetch_no, count(*) AS c FROM n JOIN p ON p.source = n.source AND p.fetch_no = n.fetch_no JOIN p q ON q.source = n.source AND q.fetch_no = n.prev AND q.station_id = p.station_id AND q.ts = p.ts GROUP BY ALL),"
    " k AS (SELECT source, fetch_no, count(*) AS c FROM (SELECT *, lag(ts) OVER (PARTITION BY source, station_id ORDER BY fetch_no, ts) AS before FROM log) WHERE ts < before GROUP BY ALL),"
    " x AS (SELECT n.source, n.fetch_no, latency_ms, ok, success, coalesce(d.c, 0) AS duplicates, coalesce(k.c, 0) AS out_of_order, greatest(0, expected - received) AS gaps, 100e0 * received / expected AS completeness, abs(payload - mean) / mean AS deviation FROM n LEFT JOIN d ON d.source = n.source AND d.fetch_no = n.fetch_no LEFT JOIN k ON k.source = n.source AND k.fetch_no = n.fetch_no),"
    " y AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN ok THEN 0 ELSE 40 END - CASE WHEN latency_ms > 5000 THEN 15 WHEN latency_ms > 2000 THEN 5 ELSE 0 END - CASE WHEN completeness < 60 THEN 20 WHEN completeness < 90 THEN 10 ELSE 0 END - CASE WHEN duplicates > 5 THEN 10 ELSE 0 END - CASE WHEN out_of_order > 3 THEN 10 ELSE 0 END - CASE WHEN gaps > 10 THEN 15 ELSE 0 END - CASE WHEN success < 0.8 THEN 15 ELSE 0 END - CASE WHEN deviation > 0.6 THEN 10 ELSE 0 END) AS INT) AS score FROM x)"
    " SELECT source, fetch_no, duplicates, out_of_order, gaps, round(completeness, 6) AS completeness, round(success, 6) AS success, round(deviation, 6) AS deviation, score, CASE WHEN score >= 80 THEN 'verified' WHEN score >= 50 THEN 'warning' ELSE 'failed' END AS status FROM y",
)
def _v16(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    fetches = spark.sql(_FETCHES.replace("FROM log", "FROM {log}"), log=log)
    out = health.fetch_scores(fetches, log.drop("event_id"))
    return out.select("source", "fetch_no", "duplicates", "out_of_order", "gaps", *[_r(c, c) for c in ("completeness", "success", "deviation")], "score", "status")


_NETS = """SELECT remote_ip, CASE count(*) % 4 WHEN 0 THEN 'fiber' WHEN 1 THEN 'copper' WHEN 2 THEN 'wireless' ELSE 'satellite' END AS medium,
 count(*) % 7 <> 6 AS local, min(seq) % 11 <> 3 AS dns, min(seq) % 13 <> 4 AS internet, avg(latency_ms) AS latency_ms, avg(CASE WHEN latency_ms = CAST(0 AS DOUBLE) THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS loss_pct FROM connections GROUP BY remote_ip"""


def _medium(i: int) -> str:
    return "CASE medium " + " ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in health.MEDIA.items() if k != "unknown") + f" ELSE {health.MEDIA['unknown'][i]}e0 END"


@_on("connections", "n5_connectivity", f", n AS ({_NETS}), t AS (SELECT *, {_medium(0)} AS slow, {_medium(1)} AS lossy, {_medium(2)} AS usual FROM n) SELECT remote_ip, CASE WHEN NOT local THEN 'offline' WHEN NOT (internet AND dns) THEN 'critical' WHEN loss_pct > lossy OR latency_ms > slow THEN 'degraded' ELSE 'healthy' END AS status, CAST(floor((25 * (CAST(local AS INT) + CAST(dns AS INT) + CAST(internet AS INT)) + CASE WHEN latency_ms = 0 THEN 0 WHEN latency_ms / usual <= 1 THEN 25 WHEN latency_ms / usual <= 2 THEN 20 WHEN latency_ms / usual <= 3 THEN 15 WHEN latency_ms / usual <= 5 THEN 10 ELSE 5 END) * (1 - least(1e0, loss_pct / lossy)) + 0.5) AS INT) AS score FROM t")
def _n5(df: DataFrame) -> DataFrame:
    networks = df.sparkSession.sql(_NETS.replace("FROM connections", "FROM {connections}"), connections=df)
    return health.connectivity(networks).select("remote_ip", "status", "score")


# -- neighbours, peers, links ------------------------------------------------------------------------------------------

_LATEST = ", latest AS (SELECT id, source, lat, lon, depth, depth * 3 AS sea_depth, m.t AS t, m.s AS s FROM stations JOIN (SELECT station_id, arg_max({'t': water_temp, 's': salinity}, seq) AS m FROM measurements GROUP BY station_id) ON id = station_id)"
_DENSITY = "999.842594 + 6.793952e-2*t - 9.09529e-3*t*t + 1.001685e-4*pow(t,3) - 1.120083e-6*pow(t,4) + 6.536332e-9*pow(t,5) + (8.24493e-1 - 4.0899e-3*t + 7.6438e-5*t*t - 8.2467e-7*pow(t,3) + 5.3875e-9*pow(t,4))*s + (-5.72466e-3 + 1.0227e-4*t - 1.6546e-6*t*t)*pow(s,1.5) + 4.8314e-4*s*s"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = view(spark, sf_dir, "measurements").groupBy("station_id").agg(F.max_by(F.struct("water_temp", "salinity"), "seq").alias("m"))
    stations = view(spark, sf_dir, "stations").select("id", "source", "lat", "lon", "depth", (F.col("depth") * 3).alias("sea_depth"))
    return stations.join(last, F.col("id") == F.col("station_id")).select("id", "source", "lat", "lon", "depth", "sea_depth", "m.water_temp", "m.salinity")


def _neighbours(order: str, needs: str) -> str:
    return f", pairs AS (SELECT a.id, b.id AS r_id, a.t, b.t AS r_t, a.s, b.s AS r_s, {_D} AS d, a.source = 'ARGO' AS own, b.source = 'ARGO' AS theirs, abs(a.depth - b.depth) AS gap, abs(a.sea_depth - b.sea_depth) AS floor_gap FROM latest a JOIN latest b ON a.id <> b.id AND {_D} <= 500 WHERE {needs}), near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}, CASE WHEN own AND theirs THEN gap ELSE d END, d, r_id) AS r FROM pairs)"


@_query("v9_reference_mismatch", with_views("stations", "measurements") + _LATEST + _neighbours("CASE WHEN own AND NOT theirs THEN 1 ELSE 0 END", "a.t IS NOT NULL AND b.t IS NOT NULL") + " SELECT id, r_id, round(abs(t - r_t), 6) AS gap, CASE WHEN theirs THEN 'critical' ELSE 'warning' END AS severity FROM near WHERE r <= 5 AND d < 200 AND abs(t - r_t) > 5 + CASE WHEN gap > 100 THEN 8 WHEN gap > 20 THEN 4 ELSE 0 END AND (NOT own OR (theirs AND gap < 50))")
def _v9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.temperature_mismatch(_latest(spark, sf_dir)).select("id", "r_id", _r("gap", "gap"), "severity")


@_query(
    "v11_density_mismatch",
    with_views("stations", "measurements") + _LATEST + _neighbours("CASE WHEN theirs THEN 0 ELSE 1 END", "a.t IS NOT NULL AND b.t IS NOT NULL AND a.s IS NOT NULL AND b.s IS NOT NULL")
    + f", dens AS (SELECT id, {_DENSITY} AS rho FROM latest), off AS (SELECT near.*, abs(x.rho - y.rho) AS delta FROM near JOIN dens x ON x.id = near.id JOIN dens y ON y.id = r_id WHERE r <= 5 AND d < 200 AND abs(x.rho - y.rho) > 2 + CASE WHEN gap > 100 THEN 3 WHEN gap > 20 THEN 1.5 ELSE 0 END + CASE WHEN floor_gap > 500 THEN 2 WHEN floor_gap > 100 THEN 1 ELSE 0 END),"
    " one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS k FROM off) SELECT id, r_id, round(delta, 6) AS delta, CASE WHEN theirs THEN 'critical' ELSE 'warning' END AS severity FROM one WHERE k = 1 AND (NOT own OR (theirs AND gap < 50))",
)
def _v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.density_mismatch(_latest(spark, sf_dir)).select("id", "r_id", _r("delta", "delta"), "severity")


_PEERS = ", p AS (SELECT *, concat('s', CAST(CAST(floor(capacity_mw) AS BIGINT) % 3 AS VARCHAR)) AS source FROM assets WHERE capacity_mw <> 0)"


@_query(
    "j14_peer_flags",
    with_views("assets") + _PEERS
    + f", near AS (SELECT a.id, abs(a.capacity_mw - b.capacity_mw) / greatest(a.capacity_mw, b.capacity_mw) AS amount, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS r FROM p a JOIN p b ON a.id <> b.id AND a.type = b.type AND {_D} <= 1500)"
    " SELECT id, 'nearby' AS rule, round(max(amount), 6) AS amount FROM near WHERE r <= 5 AND amount >= 0.3 GROUP BY id"
    " UNION ALL SELECT id, 'outlier', round(z, 6) FROM (SELECT a.id, abs(any_value(a.capacity_mw) - avg(b.capacity_mw)) / CASE WHEN stddev_pop(b.capacity_mw) > 0 THEN stddev_pop(b.capacity_mw) ELSE 1 END AS z, count(*) AS n FROM p a JOIN p b ON a.id <> b.id AND a.type = b.type GROUP BY a.id) WHERE n > 3 AND z > 1.5"
    " UNION ALL SELECT id, 'sources', round(s, 6) FROM (SELECT a.id, abs(any_value(a.capacity_mw) - avg(b.capacity_mw)) / avg(b.capacity_mw) AS s FROM p a JOIN p b ON a.type = b.type AND a.country = b.country AND a.source <> b.source GROUP BY a.id) WHERE s >= 0.3",
)
def _j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = view(spark, sf_dir, "assets").withColumn("source", F.concat(F.lit("s"), (F.floor("capacity_mw") % 3).cast("string")))
    return agreement.peer_flags(assets, "capacity_mw", 1500.0, limit=1.5).select("id", "rule", _r("amount", "amount"))


_SUPPLY = ", ".join(f"'{t}'" for t in agreement.SUPPLY)
_NEAREST = f"SELECT a.id, b.id AS r_id, a.type, {_D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS r FROM assets a JOIN assets b ON b.type IN ({_SUPPLY})"


@_on(
    "assets", "j9_asset_links",
    f", f AS ({_NEAREST} AND a.type IN ('data_center', 'ai_center', 'edge_node') AND {_D} < 400), t AS ({_NEAREST} AND a.type = 'transformer' AND {_D} < 300), l AS (SELECT id, r_id, 'fiber' AS kind, d FROM f WHERE r <= 3 UNION ALL SELECT id, r_id, 'ac_line', d FROM t WHERE r <= 2"
    f" UNION ALL SELECT a.id, b.id, CASE WHEN {_D} < 400 THEN 'ac_line' ELSE 'dc_line' END, {_D} FROM assets a JOIN assets b ON a.id < b.id AND a.type IN ({_SUPPLY}) AND b.type IN ({_SUPPLY}) AND {_D} <= 800)"
    " SELECT id AS source_id, r_id AS target_id, kind, round(d, 6) AS distance_km, CAST(floor(d / CASE kind WHEN 'fiber' THEN 20 ELSE 30 END + 0.5) AS BIGINT) AS latency_ms FROM l",
)
def _j9(df: DataFrame) -> DataFrame:
    return agreement.asset_links(df).select("source_id", "target_id", "kind", _r("distance_km", "distance_km"), "latency_ms")


# -- summaries ---------------------------------------------------------------------------------------------------------


@_on("stations", "a4_station_activity", f", s AS (SELECT *, last_update >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AS active FROM stations) SELECT type, source, count(*) AS n, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS invalidated FROM s GROUP BY GROUPING SETS ((), (type), (source))")
def _a4(df: DataFrame) -> DataFrame:
    return rollups.station_activity(df, F.col("last_update") >= F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 1 DAY"))


@_on("features", "a16_outage_kinds", ", o AS (SELECT concat('t', CAST(user_id % 5 AS VARCHAR)) AS type, CASE WHEN mag > 100 THEN 'high' WHEN mag > 50 THEN 'medium' ELSE 'low' END AS severity, hour(freshness) AS h, speed FROM features WHERE layer = 'quake' AND heading < 300) SELECT count(*) AS outages, round(avg(speed), 6) AS mean_s, (SELECT type FROM o GROUP BY type ORDER BY count(*) DESC, type LIMIT 1) AS type, (SELECT severity FROM o GROUP BY severity ORDER BY count(*) DESC, severity LIMIT 1) AS severity, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY h) FROM (SELECT k.h, count(o.h) AS n FROM range(24) k(h) LEFT JOIN o ON o.h = k.h GROUP BY k.h)) AS hours FROM o")
def _a16(df: DataFrame) -> DataFrame:
    outages = df.where("layer = 'quake' AND heading < 300").select(
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("type"), F.when(F.col("mag") > 100, "high").when(F.col("mag") > 50, "medium").otherwise("low").alias("severity"),
        F.col("freshness").alias("start"), F.col("speed").alias("duration_s"),
    )
    return rollups.outage_kinds(outages).select("outages", _r("mean_s", "mean_s"), "type", "severity", F.concat_ws(",", F.col("hours").cast("array<string>")).alias("hours"))


_CELL = "CAST(floor(lat / 5 + 0.5) AS BIGINT) AS cy, CAST(floor(lon / 5 + 0.5) AS BIGINT) AS cx"


@_query(
    "a9_weather_cells",
    with_views("stations", "measurements", "features") + f", l AS (SELECT station_id, arg_max({{'p': pressure, 'a': air_temp, 'w': water_temp, 'g': wind_speed, 'h': wave_height}}, seq) AS m FROM measurements GROUP BY station_id),"
    f" c AS (SELECT {_CELL}, avg(m.p) AS p, avg(m.a) AS a, avg(m.w) AS w, max(m.g) AS g, max(m.h) AS h, count(*) AS n FROM l JOIN stations ON station_id = id GROUP BY ALL),"
    f" e AS (SELECT {_CELL}, count(*) FILTER (layer = 'lightning') AS strikes, count(*) FILTER (layer = 'fire') AS storms FROM features WHERE layer = 'fire' OR (layer = 'lightning' AND freshness >= (SELECT max(freshness) FROM features) - INTERVAL 2 DAY) GROUP BY ALL)"
    " SELECT cy, cx, round(p, 6) AS pressure, round(a, 6) AS air_temp, round(w, 6) AS water_temp, g AS wind, h AS wave, coalesce(n, 0) AS stations, coalesce(strikes, 0) AS strikes, coalesce(storms, 0) AS storms FROM c FULL JOIN e USING (cy, cx)",
)
def _a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("pressure", "air_temp", "water_temp", "wind_speed", "wave_height")
    last = view(spark, sf_dir, "measurements").groupBy("station_id").agg(F.max_by(F.struct(*names), "seq").alias("m"))
    latest = view(spark, sf_dir, "stations").select("id", "lat", "lon").join(last, F.col("id") == F.col("station_id")).select("lat", "lon", "m.*")
    rows = view(spark, sf_dir, "features")
    newest = rows.agg(F.max("freshness").alias("_newest"))
    strikes = rows.where("layer = 'lightning'").crossJoin(F.broadcast(newest)).where("freshness >= _newest - INTERVAL 2 DAY")
    out = rollups.weather_cells(latest, strikes, rows.where("layer = 'fire'"), geo.floor_half)
    return out.select("cy", "cx", *[_r(c, c) for c in ("pressure", "air_temp", "water_temp")], "wind", "wave", "stations", "strikes", "storms")
