"""Named queries of the library: name -> function of (spark, sf_dir), and their DuckDB statements.

Each query applies one operator to a whole view over the given tables. Real numbers are rounded to six decimals on both
sides. An oracle is written on its own, mostly as a plain join or window over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions import geo, physics
from sextant.operators import grids, network, quality, spatial
from sextant.plans.views import AS_OF, view, with_views
from sextant.sources import exports

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _r(x: Column | str, name: str) -> Column:
    return F.round(x, 6).alias(name)


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def _on(view_name: str, name: str, oracle: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a function of one view."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(view(spark, sf_dir, view_name))
        if oracle:
            _ORACLES[name] = with_views(view_name) + oracle if "UNION" not in oracle else with_views(view_name).replace("WITH", "WITH RECURSIVE", 1) + oracle
        return f

    return put


def queries() -> dict[str, Query]:
    from sextant.plans import agreement, culling, extra, lines, more, rescue, wider  # they register their own

    return dict(_QUERIES) if agreement and culling and more and extra and lines and rescue and wider else {}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(12742.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")


# -- attribute and spatial queries -------------------------------------------------------------------------------------

_FAR = _hav("10.0", "20.0", "lat", "lon")


@_on("features", "p4_scope_radius", f"SELECT id, layer, round({_FAR}, 6) AS distance_km FROM features WHERE {_FAR} <= 1500")
def _p4(df: DataFrame) -> DataFrame:
    return spatial.scope_radius(df, 10.0, 20.0, 1500.0).select("id", "layer", _r("distance_km", "distance_km"))


@_on("features", "p3_scope_box", "SELECT id, layer, lon, lat FROM features WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN -10 AND 30")
def _p3(df: DataFrame) -> DataFrame:
    return spatial.scope_box(df, -20.0, -10.0, 40.0, 30.0).select("id", "layer", "lon", "lat")


@_on("features", "p5_cull_viewport", "SELECT id FROM features WHERE (lon >= 160 OR lon <= -150) AND lat BETWEEN -30 AND 30")
def _p5(df: DataFrame) -> DataFrame:
    return spatial.scope_box(df, 160.0, -30.0, -150.0, 30.0).select("id")


@_on("features", "p1_where_attr", "SELECT id, layer, speed FROM features WHERE speed >= 200 AND layer <> 'fire' AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
def _p1(df: DataFrame) -> DataFrame:
    out = spatial.where_attr(spatial.where_attr(spatial.where_attr(df, "speed", "gte", 200), "layer", "neq", "FIRE"), "k", "gt", "50")
    return out.select("id", "layer", "speed")


@_on("features", "p2_normalise_layer", "SELECT id, CASE layer WHEN 'vessel' THEN 'vessel' ELSE layer END AS layer FROM features")
def _p2(df: DataFrame) -> DataFrame:
    other = F.when(F.col("layer") == "vessel", "Ships ").when(F.col("layer") == "quake", "Earthquakes").when(F.col("layer") == "aircraft", "planes").otherwise(F.col("layer"))
    return df.select("id", spatial.normalise_layer(other).alias("layer"))


@_on("features", "p13_coarsen", "SELECT id, floor(lon / 0.1 + 0.5) * 0.1 AS lon, floor(lat + 0.5) AS lat FROM features")
def _p13(df: DataFrame) -> DataFrame:
    return df.select("id", (geo.floor_half(F.col("lon") / 0.1) * 0.1).alias("lon"), geo.floor_half(F.col("lat")).cast("double").alias("lat"))


@_on("features", "p23_destination", """SELECT id, round(lat2, 6) AS lat2, round(CAST(lon AS DOUBLE) + degrees(atan2(sin(radians(heading)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(radians(lat2)))) + CASE WHEN lon + degrees(atan2(sin(radians(heading)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(radians(lat2)))) >= 180 THEN -360 WHEN lon + degrees(atan2(sin(radians(heading)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(radians(lat2)))) < -180 THEN 360 ELSE 0 END, 6) AS lon2
 FROM (SELECT *, speed / 6371.0 AS d, degrees(asin(sin(radians(lat)) * cos(speed / 6371.0) + cos(radians(lat)) * sin(speed / 6371.0) * cos(radians(heading)))) AS lat2 FROM features)""")
def _p23(df: DataFrame) -> DataFrame:
    lat2, lon2 = geo.destination_point(F.col("lat"), F.col("lon"), F.col("heading"), F.col("speed"))
    return df.select("id", _r(lat2, "lat2"), _r(lon2, "lon2"))


@_on("features", "p24_dead_reckon", "SELECT id, round(lat + degrees(speed * 60 / 1000.0 * cos(radians(heading)) / 6371.0), 6) AS lat, round(lon + degrees(speed * 60 / 1000.0 * sin(radians(heading)) / (6371.0 * cos(radians(lat)))), 6) AS lon FROM features")
def _p24(df: DataFrame) -> DataFrame:
    return spatial.dead_reckon(df, F.lit(60.0)).select("id", _r("lat", "lat"), _r("lon", "lon"))


@_on("features", "p25_magnitude_band", "SELECT id, CASE WHEN mag >= 70 THEN 'major' WHEN mag >= 40 THEN 'moderate' WHEN mag >= 10 THEN 'light' ELSE 'micro' END AS band, least(10, floor(1.5 * mag / 10 + 0.5)) AS priority FROM features WHERE layer = 'quake'")
def _p25(df: DataFrame) -> DataFrame:
    band = F.when(F.col("mag") >= 70, "major").when(F.col("mag") >= 40, "moderate").when(F.col("mag") >= 10, "light").otherwise("micro")
    return df.where("layer = 'quake'").select("id", band.alias("band"), F.least(F.lit(10.0), geo.floor_half(1.5 * F.col("mag") / 10).cast("double")).alias("priority"))


@_on("measurements", "p17_storm_category", "SELECT station_id, seq, CASE WHEN w >= 137 THEN 5 WHEN w >= 113 THEN 4 WHEN w >= 96 THEN 3 WHEN w >= 83 THEN 2 WHEN w >= 64 THEN 1 WHEN w >= 34 THEN 0 ELSE -1 END AS category FROM (SELECT *, wind_speed * 4 AS w FROM measurements)")
def _p17(df: DataFrame) -> DataFrame:
    return df.select("station_id", "seq", physics.storm_category(F.col("wind_speed") * 4).alias("category"))


@_on("measurements", "f_seawater_density", """SELECT station_id, seq, round(999.842594 + 6.793952e-2*t - 9.09529e-3*t*t + 1.001685e-4*pow(t,3) - 1.120083e-6*pow(t,4) + 6.536332e-9*pow(t,5)
 + (8.24493e-1 - 4.0899e-3*t + 7.6438e-5*t*t - 8.2467e-7*pow(t,3) + 5.3875e-9*pow(t,4))*s + (-5.72466e-3 + 1.0227e-4*t - 1.6546e-6*t*t)*pow(s,1.5) + 4.8314e-4*s*s, 6) AS density FROM (SELECT *, water_temp AS t, salinity AS s FROM measurements)""")
def _density(df: DataFrame) -> DataFrame:
    return df.select("station_id", "seq", _r(physics.seawater_density(F.col("water_temp"), F.col("salinity")), "density"))


@_on("measurements", "f_runoff_tobler", "SELECT station_id, seq, round(CASE WHEN p > 0.2 * s THEN pow(p - 0.2 * s, 2) / (p + 0.8 * s) ELSE 0 END, 6) AS runoff_mm, round(6 * exp(-3.5 * abs(wave_height / 10 + 0.05)), 6) AS kmh FROM (SELECT *, wind_speed * 3 AS p, 25400.0 / 75 - 254 AS s FROM measurements)")
def _runoff(df: DataFrame) -> DataFrame:
    return df.select("station_id", "seq", _r(physics.scs_runoff_mm(F.col("wind_speed") * 3, F.lit(75.0)), "runoff_mm"), _r(physics.tobler_kmh(F.col("wave_height") / 10), "kmh"))


@_on("features", "f_bearing_tile", """SELECT id, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing, CAST(floor((lon + 180) / 360 * 256) AS BIGINT) AS tx,
 CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256) AS BIGINT) AS ty
 FROM (SELECT *, degrees(atan2(sin(radians(lon - 20)) * cos(radians(lat)), cos(radians(10.0)) * sin(radians(lat)) - sin(radians(10.0)) * cos(radians(lat)) * cos(radians(lon - 20)))) AS b FROM features)""")
def _bearing(df: DataFrame) -> DataFrame:
    x, y = geo.tile_xy(F.col("lat"), F.col("lon"), 8)
    return spatial.with_bearing(df, 10.0, 20.0).select("id", _r("bearing", "bearing"), x.alias("tx"), y.alias("ty"))


@_on("features", "a1_summary", "SELECT count(*) AS n, min(speed) AS low, max(speed) AS high FROM features WHERE layer = 'vessel'")
def _a1(df: DataFrame) -> DataFrame:
    return spatial.summarise(df.where("layer = 'vessel'"), "speed")


@_on("features", "a2_layer_counts", "SELECT layer, count(*) AS n FROM features WHERE lat BETWEEN -30 AND 30 GROUP BY layer")
def _a2(df: DataFrame) -> DataFrame:
    return spatial.scope_box(df, -180, -30, 180, 30).groupBy("layer").agg(F.count("*").alias("n"))


@_on("features", "o1_sort_limit", f"SELECT id, layer, round({_FAR}, 6) AS distance_km FROM features WHERE {_FAR} <= 5000 ORDER BY {_FAR}, id LIMIT 10")
def _o1(df: DataFrame) -> DataFrame:
    return spatial.sort_and_limit(spatial.scope_radius(df, 10.0, 20.0, 5000.0), "distance_km", descending=False).select("id", "layer", _r("distance_km", "distance_km"))


@_on("features", "o3_nearest_per_layer", f"SELECT layer, id, round(d, 6) AS distance_km, r AS rank FROM (SELECT *, {_FAR} AS d, row_number() OVER (PARTITION BY layer ORDER BY {_FAR}, id) AS r FROM features) WHERE r <= 5")
def _o3(df: DataFrame) -> DataFrame:
    return spatial.nearest_per_layer(df, 10.0, 20.0, 5).select("layer", "id", _r("distance_km", "distance_km"), "rank")


@_on("features", "u1_union_layers", "SELECT id, layer AS layer_key, mag, speed FROM (SELECT id, layer, mag, NULL AS speed FROM features WHERE layer = 'quake' UNION ALL SELECT id, layer, NULL, speed FROM features WHERE layer = 'vessel')")
def _u1(df: DataFrame) -> DataFrame:
    a = df.where("layer = 'quake'").select("id", F.col("layer").alias("layer_key"), "mag")
    return a.unionByName(df.where("layer = 'vessel'").select("id", F.col("layer").alias("layer_key"), "speed"), allowMissingColumns=True)


@_on("features", "k1_geojson", """SELECT id, '{"type":"Feature","id":"' || id || '","geometry":{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']},"properties":{"layer":"' || layer || '"}}' AS feature FROM features""")
def _k1(df: DataFrame) -> DataFrame:
    return df.select("id", exports.geojson_feature("id", "lon", "lat", ["layer"]).alias("feature"))


@_on("features", "k2_kml", "SELECT id, '<Placemark id=\"' || id || '\"><name>' || layer || '</name><styleUrl>#' || layer || '</styleUrl><Point><coordinates>' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || '</coordinates></Point></Placemark>' AS placemark FROM features")
def _k2(df: DataFrame) -> DataFrame:
    return df.select("id", exports.kml_placemark("id", "layer", "lon", "lat", "layer").alias("placemark"))


@_on("features", "w1_trail", "SELECT user_id, count(*) AS points, min(id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY freshness DESC, id DESC) AS r FROM features) WHERE r <= 30 GROUP BY user_id HAVING count(*) >= 2")
def _w1(df: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("freshness"), F.desc("id")))
    trail = df.withColumn("_r", place).where(F.col("_r") <= 30).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("freshness", "id", "lon", "lat"))).alias("trail"), F.min("id").alias("first_id"))
    return trail.where(F.size("trail") >= 2).select("user_id", F.size("trail").cast("long").alias("points"), "first_id")


@_on("features", "a8_lightning_cells", "SELECT CAST(floor(lat / 5) AS BIGINT) AS cy, CAST(floor(lon / 5) AS BIGINT) AS cx, count(*) AS n, min(id) AS first_id FROM features WHERE layer = 'lightning' GROUP BY ALL HAVING count(*) >= 2")
def _a8(df: DataFrame) -> DataFrame:
    cells = df.where("layer = 'lightning'").groupBy(F.floor(F.col("lat") / 5).alias("cy"), F.floor(F.col("lon") / 5).alias("cx")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return cells.where("n >= 2")


# -- joins -------------------------------------------------------------------------------------------------------------

_D = _hav("a.lat", "a.lon", "b.lat", "b.lon")


@_on("stations", "j2_radius_self_join", f"SELECT a.id, b.id AS r_id, round({_D}, 6) AS distance_km FROM stations a JOIN stations b ON a.id <> b.id AND {_D} <= 500")
def _j2(df: DataFrame) -> DataFrame:
    return spatial.radius_self_join(df.select("id", "lat", "lon"), 500.0, decimals=6).select("id", "r_id", "distance_km")


@_on("stations", "j3_knn", f"SELECT id, r_id, round(d, 6) AS distance_km, r AS rank FROM (SELECT a.id, b.id AS r_id, {_D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.depth - b.depth), {_D}, b.id) AS r FROM stations a JOIN stations b ON a.id <> b.id AND {_D} <= 500) WHERE r <= 5")
def _j3(df: DataFrame) -> DataFrame:
    return spatial.knn(df, 500.0, 5, [F.abs(F.col("depth") - F.col("r_depth"))], by=["depth"]).select("id", "r_id", _r("distance_km", "distance_km"), "rank")


@_on("stations", "j9_nearest_links", f"SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, round(d, 6) AS distance_km FROM (SELECT a.id AS x, b.id AS y, {_D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS r FROM stations a JOIN stations b ON a.id <> b.id AND {_D} <= 400) WHERE r <= 3")
def _j9(df: DataFrame) -> DataFrame:
    return spatial.nearest_links(df, 3, 400.0).select("a", "b", _r("distance_km", "distance_km"))


@_on("stations", "j19_dedup_near", f"SELECT id, lat, lon FROM stations a WHERE NOT EXISTS (SELECT 1 FROM stations b WHERE b.id < a.id AND {_D} <= 50)")
def _j19(df: DataFrame) -> DataFrame:
    return spatial.dedup_near(df, 50.0).select("id", "lat", "lon")


@_query("j4_event_asset_join", with_views("features", "assets") + f"SELECT a.id, b.id AS r_id, round({_D}, 6) AS distance_km, CASE WHEN 1 - {_D} / (a.mag * 3) >= 0.5 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT * FROM features WHERE layer = 'quake' AND mag > 0) a JOIN assets b ON {_D} <= least(a.mag * 3, 1500)")
def _j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    quakes = view(spark, sf_dir, "features").where("layer = 'quake' AND mag > 0").select("id", "lat", "lon", "mag")
    met = spatial.radius_join(quakes, view(spark, sf_dir, "assets"), F.least(F.col("mag") * 3, F.lit(1500.0)), most_km=1500.0)
    near = 1 - F.col("distance_km") / (F.col("mag") * 3)
    return met.select("id", "r_id", _r("distance_km", "distance_km"), F.when(near >= 0.5, "critical").otherwise("warning").alias("severity"))


_REGIONS = "(VALUES ('pacific_west', 3, 120.0, -60.0, 180.0, 60.0), ('pacific_east', 4, -180.0, -60.0, -80.0, 60.0), ('dateline', 1, 170.0, -20.0, -170.0, 20.0), ('atlantic', 5, -80.0, -60.0, 20.0, 60.0), ('tropics', 9, -180.0, -23.5, 180.0, 23.5))"


@_query("j7_region_lookup", with_views("stations") + f", r(region, priority, west, south, east, north) AS (SELECT * FROM {_REGIONS} t) SELECT s.id, arg_min(region, priority) AS region FROM stations s LEFT JOIN r ON (CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END) AND lat BETWEEN south AND north GROUP BY s.id")
def _j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.sql(f"SELECT * FROM {_REGIONS} AS t(region, priority, west, south, east, north)")
    return spatial.region_of(view(spark, sf_dir, "stations"), regions).select("id", "region")


@_on("features", "j11_diff_snapshots", "SELECT id, 'added' AS change FROM features WHERE speed >= 100 AND NOT speed < 250 UNION ALL SELECT id, 'removed' FROM features WHERE speed < 250 AND NOT speed >= 100")
def _j11(df: DataFrame) -> DataFrame:
    return spatial.diff_snapshots(df.where("speed < 250"), df.where("speed >= 100"))


@_on("features", "j12_apply_delta", "SELECT id, CASE WHEN speed >= 250 THEN speed + 1 ELSE speed END AS speed FROM features WHERE NOT (speed >= 200 AND speed < 250)")
def _j12(df: DataFrame) -> DataFrame:
    delta = df.where("speed >= 200").select("id", F.when(F.col("speed") >= 250, F.col("speed") + 1).alias("speed"), F.when(F.col("speed") >= 250, "full").otherwise("removed").alias("op"))
    return spatial.apply_delta(df.select("id", "speed"), delta)


@_query("j1_station_measurements", with_views("stations", "measurements") + "SELECT id, count(m.seq) AS n, round(avg(water_temp), 6) AS mean FROM stations s LEFT JOIN measurements m ON s.id = m.station_id GROUP BY id")
def _j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # facts are summed before they meet their dimension
    sums = view(spark, sf_dir, "measurements").groupBy("station_id").agg(F.count("*").alias("n"), F.avg("water_temp").alias("mean"))
    stations = view(spark, sf_dir, "stations")
    return stations.join(sums, stations.id == sums.station_id, "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), _r("mean", "mean"))


@_query("j14_peer_compare", with_views("assets") + f"SELECT id, round(avg(peer), 6) AS peer_mean, count(*) AS peers, abs(any_value(capacity_mw) - avg(peer)) > 0.3 * avg(peer) AS off FROM (SELECT a.id, a.capacity_mw, b.capacity_mw AS peer, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS r FROM assets a JOIN assets b ON a.id <> b.id AND a.type = b.type AND {_D} <= 1500) WHERE r <= 5 GROUP BY id")
def _j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = view(spark, sf_dir, "assets").select("id", "type", "lat", "lon", "capacity_mw")
    pairs = spatial.radius_self_join(assets, 1500.0).where("type = r_type")
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance_km", "r_id"))
    top = pairs.withColumn("_r", place).where("_r <= 5").groupBy("id").agg(F.avg("r_capacity_mw").alias("m"), F.count("*").alias("peers"), F.first("capacity_mw").alias("own"))
    return top.select("id", _r("m", "peer_mean"), "peers", (F.abs(F.col("own") - F.col("m")) > 0.3 * F.col("m")).alias("off"))


@_query("j16_inbound", with_views("connections") + "SELECT conn_id, seq FROM connections WHERE state = 'Established' AND process IN (SELECT process FROM connections WHERE state = 'TimeWait' AND latency_ms = 0 GROUP BY process HAVING count(*) >= 2)")
def _j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "connections")
    waiting = rows.where("state = 'TimeWait' AND latency_ms = 0").groupBy("process").agg(F.count("*").alias("n")).where("n >= 2")
    return rows.where("state = 'Established'").join(waiting, "process", "left_semi").select("conn_id", "seq")


# -- aggregates --------------------------------------------------------------------------------------------------------


@_on("stations", "a4_station_stats", "SELECT type, source, count(*) AS n FROM stations GROUP BY GROUPING SETS ((), (type), (source))")
def _a4(df: DataFrame) -> DataFrame:
    return df.groupingSets([[], ["type"], ["source"]], "type", "source").agg(F.count("*").alias("n"))


@_on("assets", "a6_grid_stats", "SELECT type, count(*) AS n, round(sum(capacity_mw), 6) AS mw, sum(active::INT) AS active FROM assets GROUP BY type")
def _a6(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"), _r(F.sum("capacity_mw"), "mw"), F.sum(F.col("active").cast("int")).alias("active"))


@_query("a9_atmosphere_cells", with_views("stations", "measurements", "features") + """, m AS (SELECT floor(lat / 5 + 0.5) AS cy, floor(lon / 5 + 0.5) AS cx, avg(pressure) AS p, avg(water_temp) AS w, max(wind_speed) AS g FROM measurements JOIN stations ON station_id = id GROUP BY ALL),
 l AS (SELECT floor(lat / 5 + 0.5) AS cy, floor(lon / 5 + 0.5) AS cx, count(*) AS strikes FROM features WHERE layer = 'lightning' GROUP BY ALL)
 SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, round(p, 6) AS pressure, round(w, 6) AS water_temp, g AS wind, coalesce(strikes, 0) AS strikes FROM m FULL JOIN l USING (cy, cx)""")
def _a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = [geo.floor_half(F.col("lat") / 5).alias("cy"), geo.floor_half(F.col("lon") / 5).alias("cx")]
    stations = view(spark, sf_dir, "stations").select("id", *cell)
    m = view(spark, sf_dir, "measurements").join(stations, F.col("station_id") == F.col("id")).groupBy("cy", "cx").agg(_r(F.avg("pressure"), "pressure"), _r(F.avg("water_temp"), "water_temp"), F.max("wind_speed").alias("wind"))
    strikes = view(spark, sf_dir, "features").where("layer = 'lightning'").groupBy(*cell).agg(F.count("*").alias("strikes"))
    return m.join(strikes, ["cy", "cx"], "full").select("cy", "cx", "pressure", "water_temp", "wind", F.coalesce("strikes", F.lit(0)).alias("strikes"))


@_on("measurements", "a15_global_zscore", "SELECT station_id, seq, round((water_temp - m) / s, 6) AS z FROM measurements, (SELECT avg(water_temp) AS m, stddev_pop(water_temp) AS s FROM measurements WHERE water_temp BETWEEN -2.5 AND 40) WHERE abs((water_temp - m) / s) > 3")
def _a15(df: DataFrame) -> DataFrame:
    base = df.where("water_temp BETWEEN -2.5 AND 40").agg(F.avg("water_temp").alias("m"), F.stddev_pop("water_temp").alias("s"), F.count("*").alias("n")).where("n >= 5")
    z = (F.col("water_temp") - F.col("m")) / F.col("s")
    return df.crossJoin(F.broadcast(base)).where(F.abs(z) > 3).select("station_id", "seq", _r(z, "z"))


@_on("measurements", "a23_latest", "SELECT station_id, max(seq) AS seq, arg_max(water_temp, seq) AS water_temp, max(water_temp) AS peak FROM measurements GROUP BY station_id")
def _a23(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id").agg(F.max("seq").alias("seq"), F.max_by("water_temp", "seq").alias("water_temp"), F.max("water_temp").alias("peak"))


@_on("features", "a22_track_density", "SELECT CAST(floor(lat / 10) AS BIGINT) AS cy, CAST(floor(lon / 10) AS BIGINT) AS cx, count(*) AS n, round(count(*) / (SELECT count(DISTINCT user_id) FROM features), 6) AS density FROM features GROUP BY 1, 2 ORDER BY n DESC, cy, cx LIMIT 10")
def _a22(df: DataFrame) -> DataFrame:
    cells = df.groupBy(F.floor(F.col("lat") / 10).alias("cy"), F.floor(F.col("lon") / 10).alias("cx")).agg(F.count("*").alias("n"))
    tracks = df.agg(F.countDistinct("user_id").alias("tracks"))
    return cells.crossJoin(F.broadcast(tracks)).select("cy", "cx", "n", _r(F.col("n") / F.col("tracks"), "density")).orderBy(F.desc("n"), "cy", "cx").limit(10)


# -- sensor integrity --------------------------------------------------------------------------------------------------

_FIELDS = ("water_temp", "air_temp", "salinity", "pressure", "wind_speed", "wave_height")
_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT station_id, seq, ts, '{f}' AS field, {f} AS value FROM measurements WHERE {f} IS NOT NULL" for f in _FIELDS) + ")"
_STEP = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.MAX_STEP.items()) + " END"
_BOUNDS_SQL = ", limits(f, lo, hi) AS (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in quality.BOUNDS.items()) + ")"


def _long(df: DataFrame) -> DataFrame:
    return quality.to_long(df, _FIELDS)


@_on("measurements", "v7_bounds", _LONG + _BOUNDS_SQL + "SELECT station_id, field, seq, 'bounds' AS rule, 'critical' AS severity, value FROM long JOIN limits ON field = f WHERE value < lo OR value > hi")
def _v7(df: DataFrame) -> DataFrame:
    return quality.bounds_flags(_long(df))


@_on("measurements", "v8_jump", _LONG + f"SELECT station_id, field, seq, 'jump' AS rule, CASE WHEN c > 2 * {_STEP} THEN 'critical' ELSE 'warning' END AS severity, round(c, 6) AS change FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY station_id, field ORDER BY seq)) AS c FROM long) WHERE c > {_STEP}")
def _v8(df: DataFrame) -> DataFrame:
    return quality.jump_flags(_long(df)).withColumn("change", F.round("change", 6))


@_on("measurements", "v4_drift", _LONG + "SELECT station_id, field, seq, 'drift' AS rule, CASE WHEN abs(z) > 3 THEN 'critical' ELSE 'warning' END AS severity, round(z, 6) AS z FROM (SELECT *, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, count(value) OVER w AS n, stddev_pop(value) OVER w AS s FROM long WINDOW w AS (PARTITION BY station_id, field ORDER BY seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) WHERE n >= 5 AND s > 0 AND abs(z) > 2")
def _v4(df: DataFrame) -> DataFrame:
    return quality.drift_flags(_long(df)).withColumn("z", F.round("z", 6))


@_on("measurements", "v12_stuck", _LONG + "SELECT station_id, field, seq, 'stuck' AS rule, 'warning' AS severity, round(spread, 6) AS spread FROM (SELECT *, greatest(max(value) OVER w - first_value(value) OVER w, first_value(value) OVER w - min(value) OVER w) AS spread, count(*) OVER w AS n, min(abs(value)) OVER w AS a FROM long WINDOW w AS (PARTITION BY station_id, field ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3 AND spread <= 1.0 AND a > 0")
def _v12(df: DataFrame) -> DataFrame:
    return quality.stuck_flags(_long(df), tolerance=1.0).withColumn("spread", F.round("spread", 6))


@_on("measurements", "v2_regularity", "SELECT station_id, count(*) AS gaps, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS sd_gap, round(CASE WHEN count(*) >= 3 AND avg(gap) > 0 THEN greatest(0, 1 - stddev_pop(gap) / avg(gap)) END, 6) AS regularity FROM (SELECT station_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY station_id ORDER BY seq))) / 1e6 AS gap FROM measurements) WHERE gap IS NOT NULL GROUP BY station_id")
def _v2(df: DataFrame) -> DataFrame:
    out = quality.regularity(df)
    return out.select("station_id", "gaps", *[_r(c, c) for c in ("mean_gap", "sd_gap", "regularity")])


_EXPECTED = {"NOAA_NDBC": 3600.0 * 6, "ARGO": 86400.0 * 10, "NWS_WEATHER": 3600.0, "PMEL_CO2": 3600.0 * 48}


@_query("v1_liveness", with_views("stations", "measurements") + f", a AS (SELECT s.id, s.source, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(m.ts))) / 1e6 AS age_s, CASE s.source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _EXPECTED.items()) + " ELSE 3600.0 END AS expected_s FROM stations s LEFT JOIN measurements m ON s.id = m.station_id GROUP BY s.id, s.source) SELECT id, source, round(age_s, 6) AS age_s, CAST(expected_s AS DOUBLE) AS expected_s, CASE WHEN age_s IS NULL THEN 'missing' WHEN age_s > 2 * expected_s THEN 'very_late' WHEN age_s > expected_s THEN 'late' ELSE 'on_time' END AS status FROM a")
def _v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.liveness(view(spark, sf_dir, "stations"), view(spark, sf_dir, "measurements"), F.lit(AS_OF), _EXPECTED)
    return out.withColumn("age_s", F.round("age_s", 6))


@_on("measurements", "v3_completeness", "SELECT station_id, CAST(6 - n AS INT) AS absent, CAST(n AS INT) AS present FROM (SELECT station_id, " + " + ".join(f"(arg_max(CASE WHEN {f} IS NULL THEN 0 ELSE 1 END, seq))" for f in _FIELDS) + " AS n FROM measurements GROUP BY station_id)")
def _v3(df: DataFrame) -> DataFrame:
    return quality.completeness(df, _FIELDS)


@_query("a26_flag_score", with_views("stations", "measurements") + _LONG + _BOUNDS_SQL + f", flags AS (SELECT station_id, 'critical' AS severity FROM long JOIN limits ON field = f WHERE value < lo OR value > hi UNION ALL SELECT station_id, CASE WHEN c > 2 * {_STEP} THEN 'critical' ELSE 'warning' END FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY station_id, field ORDER BY seq)) AS c FROM long WHERE field = 'pressure') WHERE c > {_STEP}) SELECT id AS station_id, count(*) FILTER (severity = 'critical') AS criticals, count(*) FILTER (severity = 'warning') AS warnings, greatest(0, 100 - 25 * count(*) FILTER (severity = 'critical') - 10 * count(*) FILTER (severity = 'warning')) AS score, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warning' ELSE 'valid' END AS status FROM stations LEFT JOIN flags ON id = station_id GROUP BY id")
def _a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(view(spark, sf_dir, "measurements"))
    flags = quality.bounds_flags(long).select("station_id", "severity").union(quality.jump_flags(long.where("field = 'pressure'")).select("station_id", "severity"))
    return quality.score_flags(view(spark, sf_dir, "stations"), flags)


@_query("v14_band_outliers", with_views("stations", "measurements") + ", latest AS (SELECT station_id, arg_max(water_temp, seq) AS v FROM measurements GROUP BY station_id), b AS (SELECT station_id, floor(lat / 10) * 10 AS band, v FROM latest JOIN stations ON id = station_id), w AS (SELECT *, avg(v) OVER p AS m, stddev_pop(v) OVER p AS s, count(*) OVER p AS n FROM b WINDOW p AS (PARTITION BY band)) SELECT station_id, band, v AS value, round((v - m) / s, 6) AS z FROM w WHERE n >= 5 AND s >= 0.1 AND abs((v - m) / s) > 1.5")
def _v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = view(spark, sf_dir, "measurements").groupBy("station_id").agg(F.max_by("water_temp", "seq").alias("water_temp"))
    placed = latest.join(view(spark, sf_dir, "stations").select(F.col("id").alias("station_id"), "lat"), "station_id")
    out = quality.band_outliers(placed, "water_temp", limit=1.5)
    return out.select("station_id", F.col("band").cast("double").alias("band"), "value", _r("z", "z"))


@_on("measurements", "v15_water_air", "SELECT station_id, seq, round(water_temp - air_temp, 6) AS gap FROM measurements WHERE abs(water_temp - air_temp) > 35")
def _v15(df: DataFrame) -> DataFrame:
    gap = F.col("water_temp") - F.col("air_temp")
    return df.where(F.abs(gap) > 35).select("station_id", "seq", _r(gap, "gap"))


@_on(
    "measurements",
    "x1_anomalies",
    _LONG + ", t AS (SELECT *, regr_slope(value, epoch_us(ts) / 86400e6 - 19700) OVER l AS slope, count(*) OVER l AS held, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS s, count(value) OVER w AS n FROM long WINDOW l AS (PARTITION BY station_id, field ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w AS (PARTITION BY station_id, field ORDER BY seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))"
    ", z AS (SELECT *, (value - mean) / s AS z, sign(slope) = sign((value - mean) / s) AS amplified FROM t WHERE held = 20 AND n >= 5 AND s > 0)"
    " SELECT station_id, field, seq, round(z, 6) AS z, round(slope, 3) AS slope_per_day, amplified, CASE WHEN abs(z) > 3 AND amplified THEN 'critical' WHEN abs(z) > 3 OR amplified THEN 'warning' ELSE 'info' END AS severity, n / 100e0 AS confidence, round(value + slope, 3) AS expected FROM z WHERE abs(z) > 2",
)
def _x1_anomalies(df: DataFrame) -> DataFrame:
    out = quality.anomalies(_long(df))
    return out.select("station_id", "field", "seq", _r("z", "z"), F.round("slope_per_day", 3).alias("slope_per_day"), "amplified", "severity", "confidence", F.round("expected", 3).alias("expected"))


@_on("measurements", "x1_trend", "SELECT station_id, seq, round(s, 3) AS slope_per_day FROM (SELECT station_id, seq, regr_slope(water_temp, epoch_us(ts) / 86400e6 - 19700) OVER (PARTITION BY station_id ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY station_id ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM measurements) WHERE n = 20")
def _x1(df: DataFrame) -> DataFrame:
    return quality.trend(quality.to_long(df, ["water_temp"])).select("station_id", "seq", F.round("slope_per_day", 3).alias("slope_per_day"))


# -- network -----------------------------------------------------------------------------------------------------------


@_on("connections", "n1_connection_states", "SELECT conn_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, arg_max(state, seq) AS state FROM connections GROUP BY conn_id")
def _n1(df: DataFrame) -> DataFrame:
    return network.connection_states(df)


@_on("connections", "a3_network_stats", "SELECT count(*) AS total, count(*) FILTER (state = 'Established') AS established, count(DISTINCT remote_ip) AS ips, count(DISTINCT remote_ip) FILTER (NOT (remote_ip LIKE '10.%' OR remote_ip LIKE '192.168.%')) AS public_ips FROM connections")
def _a3(df: DataFrame) -> DataFrame:
    return network.network_stats(df)


@_on("connections", "a3_top_processes", "SELECT process, count(*) AS n FROM connections GROUP BY process ORDER BY n DESC, process LIMIT 10")
def _a3b(df: DataFrame) -> DataFrame:
    return network.top_processes(df)


_QUALITY = "q AS (SELECT remote_ip, avg(CASE WHEN latency_ms > 0 THEN latency_ms END) AS l, avg(CASE WHEN latency_ms = 0 THEN 1.0 ELSE 0.0 END) * 100 AS p FROM (SELECT *, row_number() OVER (PARTITION BY remote_ip ORDER BY seq DESC) AS r FROM connections) WHERE r <= 10 GROUP BY remote_ip), s AS (SELECT *, greatest(0, 100 - CASE WHEN l IS NULL THEN 60 WHEN l > 200 THEN 40 WHEN l > 100 THEN 20 WHEN l > 50 THEN 10 ELSE 0 END - CASE WHEN p > 10 THEN 40 WHEN p > 2 THEN 20 WHEN p > 0 THEN 5 ELSE 0 END) AS score FROM q)"


@_on("connections", "a17_endpoint_quality", f", {_QUALITY} SELECT remote_ip, round(l, 6) AS latency_ms, round(p, 6) AS loss_pct, score FROM s")
def _a17(df: DataFrame) -> DataFrame:
    return network.endpoint_quality(df).select("remote_ip", _r("latency_ms", "latency_ms"), _r("loss_pct", "loss_pct"), "score")


@_on("connections", "n10_quality_map", f", {_QUALITY} SELECT remote_ip, (split_part(remote_ip, '.', 1)::INT + split_part(remote_ip, '.', 2)::INT) % 100 AS x, (split_part(remote_ip, '.', 3)::INT + split_part(remote_ip, '.', 4)::INT) % 100 AS y, score FROM s")
def _n10(df: DataFrame) -> DataFrame:
    return network.quality_map(network.endpoint_quality(df))


@_on("connections", "a19_latency_jitter", "SELECT a.process, round(loss, 6) AS loss_pct, round(l, 6) AS latency_ms, round(j, 6) AS jitter_ms FROM (SELECT process, avg(CASE WHEN latency_ms = 0 THEN 1.0 ELSE 0.0 END) * 100 AS loss FROM connections GROUP BY process) a LEFT JOIN (SELECT process, avg(latency_ms) AS l, 0.7 * avg(d) + 0.3 * stddev_pop(latency_ms) AS j FROM (SELECT *, abs(latency_ms - lag(latency_ms) OVER (PARTITION BY process ORDER BY seq)) AS d FROM connections WHERE latency_ms > 0) GROUP BY process) b ON a.process = b.process")
def _a19(df: DataFrame) -> DataFrame:
    return network.latency_jitter(df).select("process", *[_r(c, c) for c in ("loss_pct", "latency_ms", "jitter_ms")])


@_on("connections", "n4_traffic", "SELECT date_trunc('day', ts) AS start, count(*) AS n, count(DISTINCT conn_id) AS connections FROM connections GROUP BY 1")
def _n4(df: DataFrame) -> DataFrame:
    return network.traffic(df)


@_on("connections", "n7_outage_sessions", ", b AS (SELECT process, seq, latency_ms = 0 AS bad, coalesce(lag(latency_ms = 0) OVER (PARTITION BY process ORDER BY seq), false) AS was, max(seq) OVER (PARTITION BY process) AS last_seq FROM connections), s AS (SELECT *, sum(CASE WHEN bad AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY process ORDER BY seq) AS k FROM b) SELECT process, min(seq) AS first, max(seq) AS last, count(*) AS n, max(seq) < any_value(last_seq) AS resolved FROM s WHERE bad GROUP BY process, k")
def _n7(df: DataFrame) -> DataFrame:
    return quality.sessions(df, "process", F.col("latency_ms") == 0)


# -- grids and vectors -------------------------------------------------------------------------------------------------

_N = ", n AS (SELECT c.x, c.y, " + ", ".join(f"max(CASE WHEN o.x = c.x + ({i}) AND o.y = c.y + ({j}) THEN o.v END) AS n_{i + 1}_{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1)) + ", count(*) AS k FROM dem c JOIN dem o ON abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 GROUP BY c.x, c.y), g AS (SELECT *, ((n_2_0 + 2*n_2_1 + n_2_2) - (n_0_0 + 2*n_0_1 + n_0_2)) / 240.0 AS dx, ((n_0_2 + 2*n_1_2 + n_2_2) - (n_0_0 + 2*n_1_0 + n_2_0)) / 240.0 AS dy FROM n)"


@_on("dem", "t2_slope", _N + "SELECT x, y, round(CASE WHEN k = 9 THEN degrees(atan(sqrt(dx*dx + dy*dy))) ELSE 0 END, 6) AS slope FROM g")
def _t2(df: DataFrame) -> DataFrame:
    return grids.slope_degrees(df).select("x", "y", _r("slope", "slope"))


@_on("dem", "t3_hillshade", _N + "SELECT x, y, round(CASE WHEN k = 9 THEN greatest(0, 255 * (cos(radians(45)) * cos(s) + sin(radians(45)) * sin(s) * cos(radians(135) - atan2(dy, -dx)))) ELSE 0 END, 6) AS shade FROM (SELECT *, atan(sqrt(dx*dx + dy*dy)) AS s FROM g)")
def _t3(df: DataFrame) -> DataFrame:
    return grids.hillshade(df).select("x", "y", _r("shade", "shade"))


_RES = ", r AS (SELECT c.x, c.y, any_value(c.v) AS v, any_value(c.v) - avg(o.v) AS residual FROM dem c JOIN dem o ON abs(o.x - c.x) <= 5 AND abs(o.y - c.y) <= 5 GROUP BY c.x, c.y)"


@_on("dem", "t4_box_residual", _RES + "SELECT x, y, v, round(residual, 6) AS residual FROM r")
def _t4(df: DataFrame) -> DataFrame:
    return grids.box_residual(df).select("x", "y", "v", _r("residual", "residual"))


@_on("dem", "t5_anomaly_mask", _RES + "SELECT x, y, v, round(residual, 6) AS residual FROM r WHERE abs(residual) > 1.5 * (SELECT stddev_pop(residual) FROM r)")
def _t5(df: DataFrame) -> DataFrame:
    return grids.anomaly_mask(df, k=1.5).select("x", "y", "v", _r("residual", "residual"))


@_on("dem", "t7_roughness", "SELECT c.x, c.y, round(stddev_pop(o.v), 6) AS roughness FROM dem c JOIN dem o ON abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 GROUP BY c.x, c.y HAVING count(*) >= 4")
def _t7(df: DataFrame) -> DataFrame:
    return grids.roughness(df).select("x", "y", _r("roughness", "roughness"))


_REACH = (
    with_views("dem").replace("WITH", "WITH RECURSIVE", 1)
    + ", m AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM dem WHERE v >= 120)"
    + ", reach(x, y, sx, sy) AS (SELECT x, y, x, y FROM m UNION SELECT m.x, m.y, reach.sx, reach.sy FROM reach JOIN m ON abs(m.x - reach.x) + abs(m.y - reach.y) = 1)"
    + ", c AS (SELECT x, y, min(sy * 2147483648 + sx) AS component FROM reach GROUP BY x, y) "
)


@_query("t8_components", _REACH + "SELECT x, y, component FROM c")
def _t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.components(view(spark, sf_dir, "dem").where("v >= 120"))


@_query("t9_zones", _REACH + "SELECT component, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(v), 6) AS mean FROM c JOIN dem USING (x, y) GROUP BY component HAVING count(*) >= 3")
def _t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "dem")
    out = grids.zones(grids.components(cells.where("v >= 120")), cells)
    return out.select("component", "n", "x0", "x1", "y0", "y1", _r("mean", "mean"))


_AROUND = "(VALUES (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)) AS o(dx, dy)"
#: Water leaves at cells that lack a neighbour; a level is the least over all ways there of the highest cell on the way.
_FILL = (
    with_views("dem").replace("WITH", "WITH RECURSIVE", 1)
    + f", d AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, v FROM dem), around AS (SELECT * FROM {_AROUND}),"
    + " edge AS (SELECT d.x, d.y, d.v FROM d JOIN around ON true LEFT JOIN d AS n ON n.x = d.x + dx AND n.y = d.y + dy GROUP BY d.x, d.y, d.v HAVING count(n.v) < 8),"
    + " f(x, y, w) AS (SELECT x, y, v FROM edge UNION SELECT n.x, n.y, greatest(n.v, f.w) FROM f JOIN around ON true JOIN d AS n ON n.x = f.x + dx AND n.y = f.y + dy) "
)


@_query("t11_fill", _FILL + "SELECT x, y, v, min(w) AS filled FROM f JOIN d USING (x, y) GROUP BY x, y, v")
def _t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.fill_depressions(view(spark, sf_dir, "dem"))


@_query("t16_pools", _FILL + "SELECT count(*) AS cells, max(filled - v) AS deepest, sum(filled - v) AS volume FROM (SELECT x, y, v, min(w) AS filled FROM f JOIN d USING (x, y) GROUP BY x, y, v) WHERE filled > v")
def _t16_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = grids.pools(grids.fill_depressions(view(spark, sf_dir, "dem")), least=1, least_volume=0.0, cell_area=1.0)
    return pools.agg(F.sum("cells").alias("cells"), F.max("deepest").alias("deepest"), F.sum("volume").alias("volume"))


_DROPS = ", ".join(f"(n_1_1 - n_{i + 1}_{j + 1}) / {'sqrt(2.0)' if i and j else '1.0'}" for i, j in ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)))


@_on("dem", "t12_flow_direction", _N + f"SELECT x, y, CASE WHEN best > 0 THEN list_position(d, best) - 1 ELSE -1 END AS direction FROM (SELECT x, y, d, list_max(d) AS best FROM (SELECT x, y, [{_DROPS}] AS d FROM n))")
def _t12(df: DataFrame) -> DataFrame:
    return grids.flow_direction(df)


_WAYS = _N + (
    f", dirs AS (SELECT x, y, CASE WHEN best > 0 THEN list_position(d, best) - 1 ELSE -1 END AS k FROM (SELECT x, y, d, list_max(d) AS best FROM (SELECT x, y, [{_DROPS}] AS d FROM n))),"
    " ways AS (SELECT x, y, k, x + [1, 1, 0, -1, -1, -1, 0, 1][k + 1] AS tx, y + [0, 1, 1, 1, 0, -1, -1, -1][k + 1] AS ty FROM dirs WHERE k >= 0)"
)
_DOWN = ", down(sx, sy, x, y) AS (SELECT x, y, x, y FROM dirs UNION ALL SELECT sx, sy, tx, ty FROM down JOIN ways USING (x, y)), acc AS (SELECT x, y, count(*) AS cells FROM down GROUP BY x, y)"


def _flow(oracle: str) -> str:
    return with_views("dem").replace("WITH", "WITH RECURSIVE", 1) + _WAYS.rstrip().removesuffix(",") + _DOWN + oracle


@_query("t13_accumulation", _flow(" SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(k AS INTEGER) AS direction, cells FROM acc JOIN dirs USING (x, y)"))
def _t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.flow_accumulation(grids.flow_direction(view(spark, sf_dir, "dem")))


@_query("t14_stream_heads", _flow(", s AS (SELECT * FROM acc WHERE cells >= 3) SELECT CAST(s.x AS BIGINT) AS x, CAST(s.y AS BIGINT) AS y, s.cells, count(d.x) = 0 AS head FROM s LEFT JOIN (SELECT w.tx, w.ty, w.x FROM ways w JOIN s USING (x, y)) d ON d.tx = s.x AND d.ty = s.y GROUP BY s.x, s.y, s.cells"))
def _t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = grids.flow_accumulation(grids.flow_direction(view(spark, sf_dir, "dem")))
    return grids.streams(flow, 3).select("x", "y", "cells", "head")


@_query("t14_strahler")
def _t14_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.streams(grids.flow_accumulation(grids.flow_direction(view(spark, sf_dir, "dem"))), 3)


@_query(
    "t15_flood_risk",
    _flow(
        ", sl AS (SELECT x, y, CASE WHEN k = 9 THEN sqrt(dx*dx + dy*dy) ELSE 0 END AS gradient FROM g), q AS (SELECT acc.x, acc.y, cells, gradient, cells * 900e0 * 0.5e0 / greatest(60e0, 60 * 0.0195e0 * pow(sqrt(cells * 900e0), 0.77e0) * pow(greatest(gradient, 1e-4), -0.385e0)) AS discharge FROM acc JOIN sl ON acc.x = sl.x AND acc.y = sl.y WHERE cells >= 3),"
        " r AS (SELECT *, least(1e0, discharge / 200) AS a, least(1e0, gradient / 0.5e0) AS b FROM q) SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, cells, round(discharge, 6) AS discharge, round(0.5e0 * a + 0.5e0 * b, 6) AS risk, CASE WHEN a >= b THEN 'flow' ELSE 'slope' END AS reason FROM r WHERE 0.5e0 * a + 0.5e0 * b >= 0.15e0"
    ),
)
def _t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "dem")
    rivers = grids.streams(grids.flow_accumulation(grids.flow_direction(cells)), 3)
    return grids.flood_risk(rivers, grids.slope_degrees(cells), 0.5).select("x", "y", "cells", _r("discharge", "discharge"), _r("risk", "risk"), "reason")


@_query(
    "t10_class_zones",
    with_views("dem").replace("WITH", "WITH RECURSIVE", 1)
    + ", m AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, floor(v / 90) AS c, v FROM dem), reach(x, y, sx, sy) AS (SELECT x, y, x, y FROM m UNION SELECT b.x, b.y, sx, sy FROM reach JOIN m AS a ON a.x = reach.x AND a.y = reach.y JOIN m AS b ON abs(b.x - reach.x) + abs(b.y - reach.y) = 1 AND a.c = b.c),"
    " z AS (SELECT x, y, min(sy * 2147483648 + sx) AS component FROM reach GROUP BY x, y) SELECT component, any_value(c) AS class, count(*) AS n, round(avg(v), 6) AS mean, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM z JOIN m USING (x, y) GROUP BY component HAVING count(*) >= 3",
)
def _t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "dem")
    classes = cells.select("x", "y", F.floor(F.col("v") / 90).cast("double").alias("class"))
    return grids.class_zones(cells, classes).withColumn("mean", F.round("mean", 6))


@_query("t17_basins", _flow(", e AS (SELECT sx, sy, x AS ox, y AS oy FROM down JOIN dirs USING (x, y) WHERE k < 0) SELECT CAST(sx AS BIGINT) AS x, CAST(sy AS BIGINT) AS y, CAST(oy AS BIGINT) * 2147483648 + CAST(ox AS BIGINT) AS basin FROM e"))
def _t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.basins(grids.flow_direction(view(spark, sf_dir, "dem")))


@_query("t17_divides", _flow(", e AS (SELECT sx AS x, sy AS y, CAST(y AS BIGINT) * 2147483648 + CAST(x AS BIGINT) AS basin FROM down JOIN dirs USING (x, y) WHERE k < 0) SELECT DISTINCT CAST(a.x AS BIGINT) AS x, CAST(a.y AS BIGINT) AS y, a.basin, b.basin AS other FROM e a JOIN e b ON a.basin <> b.basin AND (b.x, b.y) IN ((a.x + 1, a.y), (a.x - 1, a.y), (a.x, a.y + 1), (a.x, a.y - 1))"))
def _t17_divides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.divides(grids.basins(grids.flow_direction(view(spark, sf_dir, "dem"))))


@_query("m12_cost_distance")
def _m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "dem")
    return grids.cost_distance(cells, cells.where("v < 5")).select("x", "y", _r("seconds", "seconds"))


@_on("dem", "t7_canopy", ", o AS (SELECT a.x, a.y, count(b.v) AS n, stddev_pop(b.v) AS s FROM dem a JOIN dem b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.x, a.y) SELECT x, y, round(least(40.0, 1.5 * s), 6) AS height FROM o WHERE n >= 4")
def _t7_canopy(df: DataFrame) -> DataFrame:
    return grids.canopy_height(df).select("x", "y", _r("height", "height"))


@_query("t8_components_diagonal", _REACH.replace("abs(m.x - reach.x) + abs(m.y - reach.y) = 1", "greatest(abs(m.x - reach.x), abs(m.y - reach.y)) = 1") + "SELECT x, y, component FROM c")
def _t8_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.components(view(spark, sf_dir, "dem").where("v >= 120"), diagonal=True)


@_on("dem", "t18_band_index", "SELECT x, y, round(CASE WHEN v + x > 0 THEN (v - x) / (v + x) ELSE 0 END, 6) AS idx FROM dem")
def _t18(df: DataFrame) -> DataFrame:
    return df.select("x", "y", _r(grids.band_index(F.col("v"), F.col("x")), "idx"))


@_query("e1_similar", "SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 10")
def _e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return grids.similar(vectors, vectors.where("vec_id % 50 = 0")).select("query_id", "vec_id", "rank")
