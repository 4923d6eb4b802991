"""Named queries of aircraft and infrastructure classes, asset health, regional climate, storms, media and feeds.

Feed readers are run on the nested records that collectors would land, made here from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import physics
from sextant.operators import assets, classify
from sextant.plans.registry import _on, _query, _r
from sextant.plans.views import AS_OF, view, with_views
from sextant.sources import exports, feeds

_HEX = "lower(lpad(to_hex((event_id * 7919 + user_id * 104729) % 16777216), 6, '0'))"
_BLOCKS = ", ".join(f"({a}, {b}, '{c}')" for a, b, c in classify.ADDRESS_BLOCKS)
_CALL = "concat(['AAL','RCH','UPS','N1','QQ','BAWX'][1 + event_id % 6], CAST(event_id % 97 AS VARCHAR))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lower(F.lpad(F.hex((F.col("event_id") * 7919 + F.col("user_id") * 104729) % 16777216), 6, "0"))
    names = F.array(*[F.lit(x) for x in ("AAL", "RCH", "UPS", "N1", "QQ", "BAWX")])
    call = F.concat(F.get(names, (F.col("event_id") % 6).cast("int")), (F.col("event_id") % 97).cast("string"))
    return _events(spark, sf_dir).select("event_id", code.alias("icao24"), call.alias("callsign"), (F.col("event_id") * 13 % 12000).cast("double").alias("height"), (F.col("event_id") * 7 % 300).cast("double").alias("speed"))


@_query("p10_icao_country", f"WITH b(lo, hi, country) AS (VALUES {_BLOCKS}), f AS (SELECT event_id, (event_id * 7919 + user_id * 104729) % 16777216 AS n, {_HEX} AS icao24 FROM events) SELECT event_id, icao24, country FROM f LEFT JOIN b ON n BETWEEN lo AND hi")
def _p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.address_country(_flights(spark, sf_dir)).select("event_id", "icao24", "country")


@_query("p11_airline", f"SELECT event_id, CASE substr(c, 1, 3) WHEN 'AAL' THEN 'American Airlines' WHEN 'UPS' THEN 'UPS Airlines' WHEN 'BAW' THEN 'British Airways' END AS airline FROM (SELECT event_id, {_CALL} AS c FROM events)")
def _p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flights(spark, sf_dir).select("event_id", classify.airline(F.col("callsign")).alias("airline"))


@_query(
    "p12_flight",
    f"SELECT event_id, CASE WHEN c LIKE 'RCH%' THEN 'military' WHEN c LIKE 'UPS%' THEN 'cargo' WHEN c LIKE 'N%' AND length(c) <= 6 THEN 'general_aviation' WHEN regexp_matches(c, '^[A-Z]{{2,3}}[0-9]') THEN 'commercial' ELSE 'unknown' END AS kind,"
    " CASE WHEN a < 100 AND v < 5 THEN 'parked' WHEN a < 100 AND v < 30 THEN 'taxi' WHEN a < 3000 AND v > 30 THEN 'takeoff' WHEN a > 3000 AND a < 10000 AND v > 50 THEN 'climb' WHEN a >= 10000 AND v > 100 THEN 'cruise' WHEN a > 3000 AND a < 10000 AND v < 250 THEN 'descent' WHEN a < 3000 AND v < 100 THEN 'approach' WHEN a < 100 THEN 'landed' ELSE 'unknown' END AS phase"
    f" FROM (SELECT event_id, {_CALL} AS c, event_id * 13 % 12000 AS a, event_id * 7 % 300 AS v FROM events)",
)
def _p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flights(spark, sf_dir).select("event_id", classify.flight_type(F.col("callsign"), F.col("icao24")).alias("kind"), classify.flight_phase(F.col("height"), F.col("speed")).alias("phase"))


@_query("p12_registration", f"WITH b(lo, hi, country) AS (VALUES {_BLOCKS}), f AS (SELECT event_id, (event_id * 7919 + user_id * 104729) % 16777216 AS n, upper({_HEX}) AS h FROM events) SELECT event_id, CASE country WHEN 'United States' THEN 'N' || substr(h, 3, 4) WHEN 'Japan' THEN 'JA' || substr(h, 3, 4) WHEN 'United Kingdom' THEN 'G-' || substr(h, 3, 3) WHEN 'France' THEN 'F-' || substr(h, 3, 3) WHEN 'Germany' THEN 'D-' || substr(h, 3, 3) WHEN 'Canada' THEN 'C-F' || substr(h, 3, 3) WHEN 'Australia' THEN 'VH-' || substr(h, 3, 3) WHEN 'Brazil' THEN 'PR-' || substr(h, 3, 3) WHEN 'Netherlands' THEN 'PH-' || substr(h, 3, 3) WHEN 'Switzerland' THEN 'HB-' || substr(h, 3, 3) WHEN 'Spain' THEN 'EC-' || substr(h, 3, 3) WHEN 'Italy' THEN 'I-' || substr(h, 3, 3) WHEN 'Russia' THEN 'RA-' || substr(h, 3, 3) ELSE h END AS registration FROM f LEFT JOIN b ON n BETWEEN lo AND hi")
def _p12_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.address_country(_flights(spark, sf_dir)).select("event_id", classify.registration(F.col("icao24"), F.col("country")).alias("registration"))


_KEYS, _VALUES = ("power", "aeroway", "man_made", "seamark:type", "highway"), ("plant", "aerodrome", "lighthouse", "lateral_buoy", "substation", "pole", "motorway")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, by: F.get(F.array(*[F.lit(x) for x in names]), by.cast("int"))
    key, value = pick(_KEYS, F.col("p_partkey") % 5), pick(_VALUES, F.col("p_partkey") % 7)
    voltage = F.concat((F.col("p_size") * 1000).cast("string"), F.lit(" V;"), (F.col("p_partkey") % 100).cast("string"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.create_map(key, value, F.lit("voltage"), voltage).alias("tags"))


@_query(
    "p14_infrastructure",
    "SELECT p_partkey, CASE WHEN k = 'power' AND v = 'plant' THEN 'power_plant' WHEN k = 'power' AND v = 'substation' THEN 'substation' WHEN k = 'power' AND v = 'pole' THEN 'tower' WHEN k = 'aeroway' AND v = 'aerodrome' THEN 'airport' WHEN k = 'man_made' AND v = 'lighthouse' THEN 'lighthouse' WHEN k = 'seamark:type' AND v = 'lateral_buoy' THEN 'navigation_buoy' END AS kind, greatest(CAST(p_size AS DOUBLE) * 1000, CAST(p_partkey % 100 AS DOUBLE)) AS voltage"
    f" FROM (SELECT p_partkey, p_size, {list(_KEYS)}[1 + p_partkey % 5] AS k, {list(_VALUES)}[1 + p_partkey % 7] AS v FROM part)",
)
def _p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("p_partkey", classify.infrastructure_kind(F.col("tags")).alias("kind"), classify.largest_voltage(F.col("tags")["voltage"]).alias("voltage"))


_ROADS = ("motorway", "secondary", "steps", "raceway", "busway", "footpath", "track")


@_query("p15_road_cost", f"SELECT * FROM (SELECT p_partkey, h AS highway, CASE h WHEN 'motorway' THEN 0.15e0 WHEN 'secondary' THEN 0.18e0 WHEN 'steps' THEN 0.4e0 WHEN 'track' THEN 0.2e0 END AS cost FROM (SELECT p_partkey, {list(_ROADS)}[1 + p_partkey % 7] AS h FROM part)) WHERE cost IS NOT NULL")
def _p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.get(F.array(*[F.lit(x) for x in _ROADS]), (F.col("p_partkey") % 7).cast("int")).alias("highway"))
    return classify.road_cost(roads)


@_on("dem", "p21_palette_ndvi", "SELECT x, y, CASE WHEN (x * 3) % 30 >= 10 THEN round(greatest(-1e0, least(1e0, ((y * 7) % 256 - v) / 255.0e0 * 0.5e0 + 0.3e0)), 6) END AS ndvi FROM dem")
def _p21(df: DataFrame) -> DataFrame:
    return df.select("x", "y", _r(classify.palette_ndvi(F.col("v"), F.col("y") * 7 % 256, F.col("x") * 3 % 30), "ndvi"))


@_on("features", "p26_map_severity", "SELECT id, CASE WHEN mag > 150 THEN 'critical' WHEN mag > 100 THEN 'moderate' ELSE 'low' END AS severity FROM features")
def _p26(df: DataFrame) -> DataFrame:
    own = F.when(F.col("mag") > 150, "critical").when(F.col("mag") > 100, "warning").otherwise("info")
    return df.select("id", classify.map_severity(own).alias("severity"))


@_on("features", "p19_hypotheses", "SELECT id, layer AS label, least(1e0, speed / 200) AS confidence, CASE WHEN layer IN ('fire', 'quake') THEN layer ELSE 'other' END AS kind FROM features WHERE user_id % 4 > 0")
def _p19_hypotheses(df: DataFrame) -> DataFrame:
    entry = F.to_json(F.array(F.struct(F.col("layer").alias("label"), (F.col("speed") / 200).alias("confidence"), F.initcap("layer").alias("kind")), F.struct(F.lit(" ").alias("label"), F.lit(1.0).alias("confidence"), F.lit("fire").alias("kind"))))
    said = F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("Here they are:\n"), entry, F.lit(" as asked"))).otherwise("nothing found")
    out = df.select("id", F.explode(classify.hypotheses(said, ["fire", "quake"], "other")).alias("h"))
    return out.select("id", "h.label", "h.confidence", "h.kind")


@_on("features", "a28_category_counts", "SELECT layer, count(*) AS n, round(count(*) / (SELECT count(*) FROM features), 6) AS share FROM features GROUP BY layer")
def _a28(df: DataFrame) -> DataFrame:
    return classify.category_counts(df, "layer").select("layer", "n", _r("share", "share"))


@_on("measurements", "p16_flare_class", "SELECT station_id, seq, CASE WHEN f < 1e-7 THEN 'A' WHEN f < 1e-6 THEN 'B' WHEN f < 1e-5 THEN 'C' WHEN f < 1e-4 THEN 'M' ELSE 'X' END AS class FROM (SELECT station_id, seq, pow(10e0, -8 + wind_speed / 8) * 1.000001e0 AS f FROM measurements)")
def _p16_flare(df: DataFrame) -> DataFrame:
    return df.select("station_id", "seq", F.substring(physics.flare_class(F.pow(F.lit(10.0), -8 + F.col("wind_speed") / 8) * 1.000001), 1, 1).alias("class"))


# -- asset health ------------------------------------------------------------------------------------------------------

_READINGS = (
    "readings AS (SELECT concat('as:', CAST(event_id % 120 + 1 AS STRING)) AS asset_id, event_id AS seq, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS load,"
    " CAST(event_id * 7 % 100 AS DOUBLE) AS temperature, CAST(49.3 AS DOUBLE) + CAST(event_id * 11 % 15 AS DOUBLE) / CAST(10 AS DOUBLE) AS frequency FROM events)"
)


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_READINGS.replace('FROM events', 'FROM {events}')} SELECT * FROM readings", events=_events(spark, sf_dir))


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.asset_health(view(spark, sf_dir, "assets"), _readings(spark, sf_dir), F.lit(AS_OF), 86400.0)


_HEALTH = (
    with_views("assets") + f", {_READINGS}, l AS (SELECT asset_id, max(ts) AS ts, arg_max({{'a': load IS NULL, 'b': temperature IS NULL, 'c': frequency IS NULL}}, seq) AS m FROM readings GROUP BY asset_id),"
    " r AS (SELECT asset_id, avg(load) AS mean, arg_max(load, seq) AS last FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seq DESC) AS i FROM readings WHERE load <> 0) WHERE i <= 5 GROUP BY asset_id),"
    f" h AS (SELECT id AS asset_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1e6 AS age_s, CASE WHEN ts IS NULL THEN 3 ELSE CAST(m.a AS INT) + CAST(m.b AS INT) + CAST(m.c AS INT) END AS lacking, abs(last - mean) / mean AS drift FROM assets LEFT JOIN l ON id = l.asset_id LEFT JOIN r ON id = r.asset_id),"
    " s AS (SELECT *, CASE WHEN age_s IS NULL THEN 'missing' WHEN age_s > 432000 THEN 'failed' WHEN age_s > 172800 THEN 'stale' ELSE 'ok' END AS status FROM h),"
    " health AS (SELECT *, greatest(0, 100 - CASE status WHEN 'stale' THEN 20 WHEN 'ok' THEN 0 ELSE 50 END - 10 * lacking - CASE WHEN drift > 0.5 THEN 15 ELSE 0 END) AS score FROM s) "
)


@_query("g1_asset_health", _HEALTH + "SELECT asset_id, round(age_s, 6) AS age_s, status, lacking, round(drift, 6) AS drift, score FROM health")
def _g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("asset_id", _r("age_s", "age_s"), "status", "lacking", _r("drift", "drift"), "score")


@_query("g2_asset_limits", f"WITH {_READINGS} SELECT asset_id, seq, 'temperature' AS field, temperature AS value FROM readings WHERE temperature > 90 UNION ALL SELECT asset_id, seq, 'frequency', frequency FROM readings WHERE frequency < 49.5 OR frequency > 50.5")
def _g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.asset_limits(_readings(spark, sf_dir))


@_query("g4_asset_alerts", _HEALTH + ", m AS (SELECT asset_id, arg_max({'l': load, 't': temperature}, seq) AS x FROM readings GROUP BY asset_id), al AS (SELECT a.id AS asset_id, unnest([CASE WHEN x.l > 0.95 * capacity_mw THEN {'k': 'overload', 's': 'critical'} END, CASE WHEN x.t > 85 THEN {'k': 'hot', 's': 'critical'} WHEN x.t > 70 THEN {'k': 'warm', 's': 'warning'} END, CASE WHEN status IN ('failed', 'missing') THEN {'k': 'silent', 's': 'warning'} END]) AS e FROM assets a LEFT JOIN m ON a.id = m.asset_id LEFT JOIN health h ON a.id = h.asset_id) SELECT asset_id, e.k AS kind, e.s AS severity FROM al WHERE e IS NOT NULL")
def _g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.asset_alerts(view(spark, sf_dir, "assets"), _readings(spark, sf_dir), _health(spark, sf_dir))


@_query("a7_grid_summary", _HEALTH + "SELECT count(*) AS assets, round(avg(score), 6) AS mean_score, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (score < 50) AS poor FROM health")
def _a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.health_summary(_health(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


@_on("connections", "v17_fetch_health", ", f AS (SELECT process, seq, avg(latency_ms) OVER w AS m, avg(CASE WHEN latency_ms > 0 THEN 1e0 ELSE 0e0 END) OVER w AS s, length(conn_id) / avg(length(conn_id)) OVER w AS z FROM connections WINDOW w AS (PARTITION BY process ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT process AS source, seq, round(m, 6) AS mean_ms, round(s, 6) AS success, round(z, 6) AS relative_size, CASE WHEN s < 0.5 THEN 'failing' WHEN m > 100 THEN 'slow' ELSE 'good' END AS band FROM f")
def _v17(df: DataFrame) -> DataFrame:
    log = df.select(F.col("process").alias("source"), "seq", "latency_ms", (F.col("latency_ms") > 0).alias("ok"), F.length("conn_id").alias("payload"))
    return assets.fetch_health(log).select("source", "seq", *[_r(c, c) for c in ("mean_ms", "success", "relative_size")], "band")


# -- climate and storms ------------------------------------------------------------------------------------------------

_REGIONS = (("north", 1, -180.0, 23.0, 180.0, 66.0), ("tropics", 2, -180.0, -23.0, 180.0, 23.0), ("pacific", 0, 150.0, -10.0, -90.0, 10.0), ("south", 3, -180.0, -66.0, 180.0, -23.0))
_IN_REGION = " ".join(f"WHEN {'lon BETWEEN ' + str(w) + ' AND ' + str(e) if w <= e else '(lon >= ' + str(w) + ' OR lon <= ' + str(e) + ')'} AND lat BETWEEN {s} AND {n} THEN '{name}'" for name, _, w, s, e, n in sorted(_REGIONS, key=lambda r: r[1]))
_SEA = ", latest AS (SELECT id, lat, lon, arg_max(water_temp, seq) AS v FROM measurements JOIN stations ON id = station_id GROUP BY id, lat, lon)"
_ANOMALY = with_views("stations", "measurements") + _SEA + f", a AS (SELECT region, avg(v - (28 - 0.45e0 * abs(lat))) AS anomaly, count(DISTINCT id) AS stations FROM (SELECT *, CASE {_IN_REGION} END AS region FROM latest) WHERE region IS NOT NULL GROUP BY region) "


def _sea(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = view(spark, sf_dir, "measurements").groupBy("station_id").agg(F.max_by("water_temp", "seq").alias("v"))
    return view(spark, sf_dir, "stations").select("id", "lat", "lon").join(last, F.col("id") == F.col("station_id")).drop("station_id")


def _anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.createDataFrame(_REGIONS, "region string, priority int, west double, south double, east double, north double")
    return assets.region_anomaly(_sea(spark, sf_dir), regions, "v")


@_query("a10_region_anomaly", _ANOMALY + "SELECT region, round(anomaly, 6) AS anomaly, stations FROM a")
def _a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomaly(spark, sf_dir).select("region", _r("anomaly", "anomaly"), "stations")


@_query("a11_regional_index", _ANOMALY + ", i AS (SELECT greatest(-3e0, least(3e0, coalesce((avg(CASE WHEN region = 'pacific' THEN anomaly END) - avg(CASE WHEN region = 'north' THEN anomaly END)) / 2, 0))) AS idx FROM a) SELECT round(idx, 6) AS \"index\", CASE WHEN idx >= 0.5 THEN 'positive' WHEN idx <= -0.5 THEN 'negative' ELSE 'neutral' END AS phase FROM i")
def _a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.regional_index(_anomaly(spark, sf_dir), "pacific", "north").select(_r("index", "index"), "phase")


_STORMS = ", storms AS (SELECT id, lat, lon, heading, speed / 20 AS knots, 40 + speed / 5 AS wind_kt FROM features WHERE layer = 'fire')"


def _storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "features").where("layer = 'fire'").select("id", "lat", "lon", "heading", (F.col("speed") / 20).alias("knots"), (40 + F.col("speed") / 5).alias("wind_kt"))


_WATER = with_views("features", "stations", "measurements") + _SEA + _STORMS + ", water AS (SELECT s.id, coalesce(avg(v), 26e0) AS water FROM storms s LEFT JOIN latest l ON abs(l.lat - s.lat) <= 10 AND least(abs(l.lon - s.lon), 360 - abs(l.lon - s.lon)) <= 10 GROUP BY s.id) "


@_query("j20_storm_water", _WATER + "SELECT id, round(water, 6) AS water FROM water")
def _j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.storm_water(_storms(spark, sf_dir), _sea(spark, sf_dir), "v").select("id", _r("water", "water"))


_STEP = "(0.97e0 * knots * 11.112e0 / 6371.0e0)"
_NEXT = f"degrees(asin(sin(radians(lat)) * cos({_STEP}) + cos(radians(lat)) * sin({_STEP}) * cos(radians(heading))))"
_EAST = f"degrees(atan2(sin(radians(heading)) * sin({_STEP}) * cos(radians(lat)), cos({_STEP}) - sin(radians(lat)) * sin(radians({_NEXT}))))"


@_query(
    "x3_storm_track",
    _WATER.replace("WITH", "WITH RECURSIVE", 1) + ", t(id, k, lat, lon, heading, knots, wind, heat) AS (SELECT id, 0, CAST(lat AS DOUBLE), CAST(lon AS DOUBLE), CAST(heading AS DOUBLE), CAST(knots AS DOUBLE), CAST(wind_kt AS DOUBLE), 0.5e0 * (water - 26) FROM storms JOIN water USING (id)"
    f" UNION ALL SELECT id, k + 1, {_NEXT}, lon + {_EAST} - 360 * floor((lon + {_EAST} + 180) / 360), heading, 0.97e0 * knots, greatest(15e0, least(185e0, wind + heat)), heat FROM t WHERE k < 20)"
    " SELECT id, CAST(k * 6 AS DOUBLE) AS hour, round(lat, 6) AS lat, round(lon, 6) AS lon, round(wind, 6) AS wind_kt FROM t WHERE k > 0",
)
def _x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    storms = assets.storm_water(_storms(spark, sf_dir), _sea(spark, sf_dir), "v")
    return assets.storm_track(storms).select("id", "hour", *[_r(c, c) for c in ("lat", "lon", "wind_kt")])


@_query("v10_depth", with_views("stations", "dem") + ", sea AS (SELECT CAST(y * 2 - 40 AS BIGINT) AS lat_cell, CAST(x * 4 - 90 AS BIGINT) AS lon_cell, v AS depth FROM dem) SELECT id, s.depth AS station_depth, sea.depth AS sea_depth, CASE WHEN s.depth >= 2 * sea.depth THEN 'critical' ELSE 'warning' END AS severity FROM stations s JOIN sea ON lat_cell = floor(lat / 2 + 0.5) AND lon_cell = floor(lon / 2 + 0.5) WHERE s.depth > 0 AND s.depth > 1.1 * sea.depth")
def _v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    sea = view(spark, sf_dir, "dem").select((F.col("y") * 2 - 40).cast("long").alias("lat_cell"), (F.col("x") * 4 - 90).cast("long").alias("lon_cell"), F.col("v").alias("depth"))
    return assets.depth_plausibility(view(spark, sf_dir, "stations"), sea)


# -- network -----------------------------------------------------------------------------------------------------------


@_on("connections", "j15_places", ", p AS (SELECT remote_ip AS ip, concat('C', CAST(min(seq) % 9 AS VARCHAR)) AS country FROM connections GROUP BY remote_ip) SELECT seq, country FROM connections LEFT JOIN p ON remote_ip = ip AND NOT (ip LIKE '10.%' OR ip LIKE '192.168.%')")
def _j15(df: DataFrame) -> DataFrame:
    places = df.groupBy(F.col("remote_ip").alias("ip")).agg(F.concat(F.lit("C"), (F.min("seq") % 9).cast("string")).alias("country"))
    return assets.with_places(df, places).select("seq", "country")


_VOTES = [("latency_ms > 150", "satellite", 3.0), ("latency_ms BETWEEN 40 AND 150", "cellular", 2.0), ("latency_ms > 0 AND latency_ms < 40", "fibre", 2.0), ("state = 'TimeWait'", "wifi", 1.0), ("latency_ms < 80", "wifi", 0.5)]


@_on("connections", "n6_medium", ", v AS (" + " UNION ALL ".join(f"SELECT process, '{m}' AS medium, {w}e0 AS w FROM connections WHERE {t}" for t, m, w in _VOTES) + "), s AS (SELECT process, medium, sum(w) AS w FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY process ORDER BY w DESC, medium) AS i, sum(w) OVER (PARTITION BY process) AS total FROM s) SELECT process, medium, round(w / total, 6) AS confidence FROM r WHERE i = 1")
def _n6(df: DataFrame) -> DataFrame:
    return assets.guess_medium(df, "process", _VOTES).select("process", "medium", _r("confidence", "confidence"))


@_on("connections", "n8_resolver_leaks", ", r AS (SELECT process AS session, remote_ip AS ip, concat('C', CAST(min(seq) % 9 AS VARCHAR)) AS country FROM connections GROUP BY ALL), e AS (SELECT process AS session, concat('C', CAST(count(*) % 9 AS VARCHAR)) AS country FROM connections GROUP BY 1) SELECT session, ip, r.country, e.country AS exit_country FROM r JOIN e USING (session) WHERE r.country <> e.country")
def _n8(df: DataFrame) -> DataFrame:
    code = lambda n: F.concat(F.lit("C"), (n % 9).cast("string")).alias("country")
    resolvers = df.groupBy(F.col("process").alias("session"), F.col("remote_ip").alias("ip")).agg(code(F.min("seq")))
    return assets.resolver_leaks(resolvers, df.groupBy(F.col("process").alias("session")).agg(code(F.count("*"))))


@_on("dem", "j18_path_contacts", ", p AS (SELECT CAST(v % 40 AS INT) AS path, x, y FROM dem) SELECT a.path, b.path AS other, count(DISTINCT (a.x, a.y)) AS vertices FROM p a JOIN p b ON a.path <> b.path AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9 GROUP BY ALL")
def _j18(df: DataFrame) -> DataFrame:
    return assets.path_contacts(df.select((F.col("v") % 40).cast("int").alias("path"), "x", "y"))


# -- feeds -------------------------------------------------------------------------------------------------------------


def _landed(rows: DataFrame, record: Column, schema: str) -> DataFrame:
    """Records as a collector lands them, one JSON text each, read with the reader's schema."""
    return rows.select(F.from_json(F.to_json(record), schema).alias("j")).select("j.*")


def _point(lon: str, lat: str, *more: Column) -> Column:
    return F.struct(F.array(F.col(lon), F.col(lat), *more).alias("coordinates")).alias("geometry")


@_on("features", "s1_quakes", "SELECT id, lon, lat, -1000 * speed AS height, mag FROM features WHERE layer = 'quake'")
def _s1(df: DataFrame) -> DataFrame:
    one = F.struct(F.col("id"), F.struct("mag", F.lit("p").alias("place"), F.lit(0).cast("long").alias("time"), F.lit(0).alias("tsunami")).alias("properties"), _point("lon", "lat", F.col("speed")))
    return feeds.quake_rows(_landed(df.where("layer = 'quake'"), F.struct(F.array(one).alias("features")), feeds.QUAKES)).select("id", "lon", "lat", "height", "mag")


@_on("features", "s2_aircraft", "SELECT id, 'CS' || CAST(user_id AS VARCHAR) AS callsign, lon, lat, height, speed, heading FROM features WHERE layer = 'aircraft'")
def _s2(df: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    empty = F.lit(None).cast("string")
    one = F.array(F.col("id"), F.concat(F.lit("CS"), text("user_id"), F.lit("  ")), empty, empty, empty, text("lon"), text("lat"), text("height"), empty, text("speed"), text("heading"))
    raw = _landed(df.where("layer = 'aircraft'"), F.struct(F.lit(1).cast("long").alias("time"), F.array(one).alias("states")), feeds.STATES)
    return feeds.aircraft_rows(raw).select("id", "callsign", "lon", "lat", "height", "speed", "heading")


@_on("features", "s3_vessels", "SELECT id, lon, lat, round(speed / 10 * 0.514444e0, 6) AS speed FROM features WHERE layer = 'vessel' AND speed >= 1 AND user_id % 5 <> 0")
def _s3(df: DataFrame) -> DataFrame:
    status = F.when(F.col("user_id") % 5 == 0, "Moored").otherwise("Under way")
    one = F.struct(F.col("id").alias("mmsi"), F.struct(F.col("id").alias("mmsi"), F.lit("n").alias("name"), (F.col("speed") / 10).alias("speed"), "heading", status.alias("status"), F.lit(0).cast("long").alias("timestamp")).alias("properties"), _point("lon", "lat"))
    return feeds.vessel_rows(_landed(df.where("layer = 'vessel'"), F.struct(F.array(one).alias("features")), feeds.VESSELS)).select("id", "lon", "lat", _r("speed", "speed"))


@_on("features", "s4_fire_clusters", "SELECT concat('fire:', id) AS id, lon, lat, speed AS frp, CASE WHEN user_id % 3 > 0 THEN 'VIIRS' WHEN user_id % 2 > 0 THEN 'GOES' ELSE 'MTG' END AS satellite, CASE WHEN speed > 100 THEN 360e0 WHEN speed > 50 THEN 330e0 ELSE 300e0 END AS brightness FROM features WHERE layer = 'fire'")
def _s4(df: DataFrame) -> DataFrame:
    one = F.struct("id", F.array("lon", "lat").alias("centroid"), F.col("speed").alias("maxFrp"), F.lit("h").alias("confidence"), (F.col("user_id") % 3).alias("viirsCount"), (F.col("user_id") % 2).alias("goesCount"), F.lit("t").alias("lastSeen"), F.lit(1).alias("count"))
    raw = _landed(df.where("layer = 'fire'"), F.struct(F.array(one).alias("events")), feeds.FIRE_EVENTS)
    return feeds.fire_cluster_rows(raw).select("id", "lon", "lat", "frp", "satellite", "brightness")


@_on("features", "s6_lightning", "SELECT lon, lat, epoch_us(freshness) // 1000 AS ms, CASE WHEN user_id % 4 = 0 THEN 0 ELSE CAST(user_id % 3 - 1 AS INTEGER) END AS polarity FROM features WHERE layer = 'lightning'")
def _s6(df: DataFrame) -> DataFrame:
    nano = (F.unix_micros(F.col("freshness").cast("timestamp")) * 1000).alias("time")
    one = F.struct(nano, "lat", "lon", F.when(F.col("user_id") % 4 > 0, (F.col("user_id") % 3 - 1).cast("int")).alias("pol"))
    return feeds.lightning_rows(_landed(df.where("layer = 'lightning'"), one, feeds.STRIKES)).select("lon", "lat", F.unix_millis("ts").alias("ms"), "polarity")


@_on("stations", "s9_metar", "SELECT id AS station_id, lat, lon, round(depth * 0.514444e0, 6) AS wind_speed, round(CASE WHEN depth <= 100 THEN depth * 33.8639e0 ELSE depth END, 6) AS pressure FROM stations WHERE depth > 0")
def _s9(df: DataFrame) -> DataFrame:
    none = lambda c: F.when(F.col("depth") > 0, F.col(c))
    one = F.struct(F.col("id").alias("icaoId"), "lat", "lon", F.lit(None).cast("double").alias("temp"), none("depth").alias("wspd"), F.lit(None).cast("double").alias("wdir"), none("depth").alias("altim"), F.lit(0).cast("long").alias("obsTime"))
    return feeds.metar_rows(_landed(df, one, feeds.METAR)).select("station_id", "lat", "lon", _r("wind_speed", "wind_speed"), _r("pressure", "pressure"))


_WAYS = "SELECT user_id AS way, list(lon ORDER BY event_id) AS xs, list(lat ORDER BY event_id) AS ys FROM (SELECT user_id, event_id, CAST((event_id*7919) % 36000 AS DOUBLE)/100 - 180 AS lon, CAST((event_id*10473) % 14000 AS DOUBLE)/100 - 70 AS lat FROM events) GROUP BY user_id"


def _ways(spark: SparkSession, sf_dir: str, tags: Column) -> DataFrame:
    at = lambda a, n, b: ((F.col("event_id") * a % n).cast("double") / 100 - b)
    nodes = _events(spark, sf_dir).select("user_id", "event_id", at(7919, 36000, 180).alias("lon"), at(10473, 14000, 70).alias("lat"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    ways = nodes.groupBy("user_id").agg(line.alias("geometry"))
    return _landed(ways, F.struct(F.array(F.struct(F.lit("way").alias("type"), F.col("user_id").alias("id"), tags.alias("tags"), "geometry")).alias("elements")), feeds.OSM)


@_query("s13_osm_roads", f"WITH w AS ({_WAYS}), s AS (SELECT way, xs, ys, unnest(range(1, len(xs))) AS i FROM w) SELECT way AS id, CAST(i - 1 AS INTEGER) AS segment, xs[i] AS lon1, ys[i] AS lat1, xs[i + 1] AS lon2, ys[i + 1] AS lat2, CASE way % 3 WHEN 0 THEN 0.15e0 ELSE 0.4e0 END AS cost FROM s WHERE way % 3 < 2")
def _s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 3 == 0, "motorway").when(F.col("user_id") % 3 == 1, "steps").otherwise("raceway")
    return feeds.road_segments(_ways(spark, sf_dir, F.create_map(F.lit("highway"), kind)))


@_query("s14_osm_water", f"WITH w AS ({_WAYS}) SELECT way AS id, CASE WHEN way % 3 = 0 THEN 'river' ELSE 'lake' END AS kind, CAST(len(xs) AS INTEGER) AS points FROM w WHERE way % 3 < 2")
def _s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("waterway"), F.lit("river"))).when(F.col("user_id") % 3 == 1, F.create_map(F.lit("natural"), F.lit("water"), F.lit("water"), F.lit("lake"))).otherwise(F.create_map(F.lit("highway"), F.lit("path")))
    return feeds.water_features(_ways(spark, sf_dir, tags)).select("id", "kind", F.size("coords").alias("points"))


@_query("s15_osm_infrastructure", f"WITH w AS ({_WAYS}) SELECT way AS id, 'substation' AS kind, round(list_avg(xs), 6) AS lon, round(list_avg(ys), 6) AS lat FROM w WHERE way % 2 = 0")
def _s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _ways(spark, sf_dir, F.create_map(F.lit("power"), F.when(F.col("user_id") % 2 == 0, "substation").otherwise("line")))
    return feeds.infrastructure_features(raw.union(raw)).select("id", "kind", _r("lon", "lon"), _r("lat", "lat"))


@_on("dem", "s17_mosaic", "SELECT x + 1024 AS x, y + 768 AS y, v FROM dem")
def _s17(df: DataFrame) -> DataFrame:
    pixels = df.select((F.floor(F.col("x") / 16) + 64).cast("int").alias("tx"), (F.floor(F.col("y") / 16) + 48).cast("int").alias("ty"), (F.col("y") % 16).alias("row"), (F.col("x") % 16).alias("col"), "v")
    return feeds.mosaic(pixels, 16).select("x", "y", "v")


@_on("features", "s19_radar_frames", "SELECT 'past' AS kind, CAST(floor(epoch(freshness)) AS BIGINT) AS time, id AS path FROM features WHERE user_id % 2 = 0 UNION ALL SELECT 'nowcast', CAST(floor(epoch(freshness)) AS BIGINT), id FROM features WHERE user_id % 2 = 1")
def _s19(df: DataFrame) -> DataFrame:
    frame = F.array(F.struct(F.unix_seconds(F.col("freshness").cast("timestamp")).alias("time"), F.col("id").alias("path")))
    none = F.array().cast("array<struct<time:bigint,path:string>>")
    even = F.col("user_id") % 2 == 0
    record = F.struct(F.struct(F.when(even, frame).otherwise(none).alias("past"), F.when(~even, frame).otherwise(none).alias("nowcast")).alias("radar"), F.struct(none.alias("infrared")).alias("satellite"))
    return feeds.radar_frames(_landed(df, record, feeds.RADAR))


@_on("features", "s21_scenes", "SELECT id, lon AS west, lat AS south, lon + 1 AS east, lat + 1 AS north, speed AS cloud, concat('s3/', id) AS red FROM features WHERE speed <= 100")
def _s21(df: DataFrame) -> DataFrame:
    one = F.struct("id", F.array("lon", "lat", F.col("lon") + 1, F.col("lat") + 1).alias("bbox"), F.struct(F.lit("2024-01-01T00:00:00Z").alias("datetime"), F.col("speed").alias("eo:cloud_cover")).alias("properties"), F.create_map(F.lit("red"), F.struct(F.concat(F.lit("s3/"), F.col("id")).alias("href"))).alias("assets"))
    return feeds.scene_rows(_landed(df, F.struct(F.array(one).alias("features")), feeds.SCENES)).where("cloud <= 100").select("id", "west", "south", "east", "north", "cloud", F.col("hrefs")["red"].alias("red"))


@_on("measurements", "s7_tabledap", "SELECT station_id, CAST(seq AS DOUBLE) AS seq, water_temp, air_temp FROM measurements")
def _s7(df: DataFrame) -> DataFrame:
    row = F.array(F.col("station_id"), *[F.col(c).cast("string") for c in ("seq", "water_temp", "air_temp")])
    record = F.struct(F.struct(F.array(*[F.lit(x) for x in ("station", "n", "wtmp", "atmp")]).alias("columnNames"), F.array(row).alias("rows")).alias("table"))
    return feeds.tabledap_rows(_landed(df, record, feeds.TABLEDAP), {"station_id": "station", "seq": "n", "water_temp": "wtmp", "air_temp": "atmp"})


@_on("measurements", "s18_forecast", "SELECT ts, air_temp AS temperature, wave_height AS precipitation, wind_speed AS wind FROM measurements")
def _s18(df: DataFrame) -> DataFrame:
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    hourly = F.struct(F.array(time).alias("time"), F.array("air_temp").alias("temperature"), F.array("wave_height").alias("precipitation"), F.array("wind_speed").alias("wind"))
    return feeds.forecast_rows(_landed(df, F.struct(hourly.alias("hourly")), feeds.FORECAST)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_on("dem", "s16_elevation", "SELECT x, y, v FROM dem")
def _s16(df: DataFrame) -> DataFrame:
    code = F.col("v") + 32768
    return df.select("x", "y", feeds.elevation(F.floor(code / 256), F.floor(code % 256), (code - F.floor(code)) * 256).alias("v"))


@_on("dem", "s12_depth_cells", "SELECT CAST(floor(y / 2.0 + 0.5) AS BIGINT) AS lat_cell, CAST(floor(x / 2.0 + 0.5) AS BIGINT) AS lon_cell, round(avg(greatest(0, 100 - v)), 6) AS depth FROM dem GROUP BY 1, 2")
def _s12(df: DataFrame) -> DataFrame:
    return feeds.depth_cells(df.select(F.col("y").cast("double").alias("lat"), F.col("x").cast("double").alias("lon"), (F.col("v") - 100).alias("altitude"))).select("lat_cell", "lon_cell", _r("depth", "depth"))


@_on("features", "s20_priority", "SELECT k, arg_min(id, (CASE WHEN layer = 'fire' THEN 1 WHEN layer = 'quake' THEN 2 ELSE 3 END, layer, id)) AS id FROM (SELECT *, user_id % 50 AS k FROM features) GROUP BY k")
def _s20(df: DataFrame) -> DataFrame:
    own = df.select((F.col("user_id") % 50).alias("k"), "layer", "id").groupBy("k", "layer").agg(F.min("id").alias("id"))
    return feeds.by_priority(own, "k", "layer", ["fire", "quake"]).select("k", "id")


@_on("features", "s24_coords", "SELECT id, lon AS lng1, lat AS lat1, lat AS lng2, lon AS lat2 FROM features")
def _s24(df: DataFrame) -> DataFrame:
    text = F.concat(F.col("lon"), F.lit(","), F.col("lat"), F.lit(",0 x,y \n "), F.col("lat"), F.lit(","), F.col("lon"))
    c = feeds.coords_from_text(text)
    return df.select("id", c.alias("c")).select("id", F.get("c", F.lit(0))["lng"].alias("lng1"), F.get("c", F.lit(0))["lat"].alias("lat1"), F.get("c", F.lit(1))["lng"].alias("lng2"), F.get("c", F.lit(1))["lat"].alias("lat2"))


@_query("k1_geojson_lines", f"WITH w AS ({_WAYS}) SELECT way, '{{\"type\":\"Feature\",\"id\":' || way || ',\"geometry\":{{\"type\":\"LineString\",\"coordinates\":[' || array_to_string([concat('[', CAST(xs[i] AS VARCHAR), ',', CAST(ys[i] AS VARCHAR), ']') for i in range(1, len(xs) + 1)], ',') || ']}},\"properties\":{{\"kind\":\"road\"}}}}' AS feature FROM w")
def _k1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = _ways(spark, sf_dir, F.create_map(F.lit("highway"), F.lit("path"))).select(F.explode("elements").alias("e")).select("e.id", "e.geometry", F.lit("road").alias("kind"))
    coords = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    return ways.select(F.col("id").alias("way"), exports.geojson_shape("id", "LineString", coords, ["kind"]).alias("feature"))


@_on("features", "s10_storms", "SELECT concat('nhc_', id) AS id, CASE user_id % 3 WHEN 0 THEN 'East Pacific' WHEN 1 THEN 'Atlantic' ELSE '' END AS basin, lat, lon, CASE WHEN user_id % 4 > 0 THEN speed END AS wind_kt FROM features WHERE layer = 'quake' AND user_id % 7 > 0")
def _s10(df: DataFrame) -> DataFrame:
    text = lambda c, when: F.when(when, F.col(c).cast("string"))
    n = F.col("user_id")
    bin_number = F.when(n % 3 == 0, "EP1").when(n % 3 == 1, "AT2").otherwise("CP1")
    where = [text(c, (n % 7 > 0) & (n % 2 == k)).alias(name) for c, k, name in (("lat", 0, "latitudeNumeric"), ("lat", 1, "lat"), ("lon", 0, "longitude_numeric"), ("lon", 1, "lon"))]
    one = F.struct("id", F.lit("").alias("name"), bin_number.alias("binNumber"), F.when(n % 4 > 0, F.col("speed").cast("string")).otherwise("strong").alias("intensity"), *where)
    return feeds.storm_rows(_landed(df.where("layer = 'quake'"), F.struct(F.array(one).alias("activeStorms")), feeds.STORMS)).select("id", "basin", "lat", "lon", "wind_kt")


@_on("features", "s10_warnings", "SELECT concat('nws_', id) AS id, CASE user_id % 3 WHEN 0 THEN 'tornado' WHEN 1 THEN 'tropical_cyclone' ELSE 'thunderstorm' END AS kind, round(CASE WHEN user_id % 2 = 0 THEN (lat * 4 + 2) / 4 ELSE lat END, 6) AS lat, round(CASE WHEN user_id % 2 = 0 THEN (lon * 4 + 1) / 4 ELSE lon END, 6) AS lon FROM features WHERE layer = 'lightning' AND user_id % 5 > 0")
def _s10_warnings(df: DataFrame) -> DataFrame:
    n, x, y = F.col("user_id"), F.col("lon"), F.col("lat")
    ring = F.to_json(F.array(F.array(F.array(x, y), F.array(x + 1, y + 1), F.array(x, y + 1), F.array(x, y))))
    shape = F.when(n % 2 == 0, F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))).otherwise(F.struct(F.lit("Point").alias("type"), F.to_json(F.array(x, y)).alias("coordinates")))
    event = F.when(n % 3 == 0, "Tornado Watch").when(n % 3 == 1, "Tropical Storm Warning").otherwise("Severe Thunderstorm Warning")
    one = F.struct(F.struct("id", event.alias("event"), F.lit("Severe").alias("severity"), F.lit("2024-01-01T00:00:00Z").alias("sent")).alias("properties"), F.when(n % 5 > 0, shape).alias("geometry"))
    return feeds.warning_rows(_landed(df.where("layer = 'lightning'"), F.struct(F.array(one).alias("features")), feeds.WARNINGS)).select("id", "kind", _r("lat", "lat"), _r("lon", "lon"))


@_on(
    "measurements",
    "s11_space_weather",
    ", s AS (SELECT seq, wind_speed AS v, seq % 6 AS k, seq % 4 < 2 AS enough FROM measurements) SELECT arg_max(v / 5, seq) FILTER (WHERE k = 0) AS kp, arg_max(v, seq) FILTER (WHERE k = 1) AS wind_speed, arg_max(v, seq) FILTER (WHERE k = 3 AND enough) AS proton_flux, arg_max(v, seq) FILTER (WHERE k = 4 AND enough) AS electron_flux FROM s",
)
def _s11(df: DataFrame) -> DataFrame:
    k = F.col("seq") % 6
    name = F.get(F.array(*[F.lit(x) for x in ("kp", "wind_speed", "wind_density", "proton", "electron", "xray")]), k.cast("int"))
    energy = F.when(F.col("seq") % 4 < 2, F.when(k == 3, ">=10 MeV").otherwise(">=2 MeV")).otherwise(">=1 MeV")
    value = F.when(k == 0, F.col("wind_speed") / 5).when(k == 5, F.pow(F.lit(10.0), -8 + F.col("wind_speed") / 10)).otherwise(F.col("wind_speed"))
    series = df.select(name.alias("series"), energy.alias("energy"), F.timestamp_seconds("seq").alias("ts"), value.alias("value"))
    return feeds.space_snapshot(series).select("kp", "wind_speed", "proton_flux", "electron_flux")
