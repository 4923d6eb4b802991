"""Named queries of search and rescue, over cases, anchors and the elevation view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import corridors, grids, rescue
from sextant.plans.registry import _on, _query, _r
from sextant.plans.views import view, with_views


def _word(column: str, values: str) -> str:
    """CASE of words: ``slow 0.56, fast 1.67`` as doubles."""
    return f"CASE {column} " + " ".join(f"WHEN '{w}' THEN {v}e0" for w, v in (p.split() for p in values.split(","))) + " END"


_UNIT = "least(1e0, greatest(0e0, {}))"
_TRIP = f"""
, a AS (SELECT *, temperature_c AS t, {_word("time_of_day", "morning 0.4, midday 1, afternoon 0.7, night 0")} AS sun, {_word("pack", "light 1, medium 0.85, heavy 0.7")} AS pk FROM cases),
b AS (SELECT *, {_UNIT.format(_UNIT.format("(t - 20) / 20") + " * sun * " + _word("age_group", "young 0.8, adult 1, elderly 1.5") + " * " + _word("pace", "slow 0.7, normal 1, fast 1.3") + " * pk / " + _word("fitness", "unfit 0.6, average 0.8, fit 1"))} AS heat_risk,
 {_UNIT.format("(t - 20) / 15")} * sun AS shade_urgency, (0.3e0 + greatest(0e0, (t - 15) / 25) * 1.5e0) * (0.7e0 + sun * 0.5e0) * {_word("pace", "slow 0.8, normal 1, fast 1.3")} * pk AS dehydration_l_h FROM a),
c AS (SELECT *, {_word("pace", "slow 0.56, normal 1.11, fast 1.67")} * pk * {_word("weather", "clear 1, cloudy 0.95, rain 0.8, snow 0.6, extreme 0.4")} * {_word("fitness", "unfit 0.75, average 1, fit 1.15")} * (1 - heat_risk * 0.4e0) AS walk_mps,
 least({_word("weather", "clear 72, cloudy 60, rain 48, snow 24, extreme 12")}, CASE WHEN heat_risk > 0.7e0 THEN 6e0 WHEN heat_risk > 0.4e0 THEN 24e0 ELSE 72e0 END, 4e0 / dehydration_l_h) AS survival_h, {_word("experience", "novice 25, experienced 35, expert 45")} AS steepest_deg FROM b),
trips AS (SELECT *, walk_mps * least(hours, 24e0) * 3600 * greatest(0.5e0, 1e0 - (day - 1) * 0.15e0) AS most_m FROM c)
"""


@_query(
    "m1_trip",
    with_views("cases") + _TRIP + f"SELECT case_id, round(walk_mps + 1e-9, 6) AS walk_mps, round(most_m, 3) AS most_m, steepest_deg, round(60 * {_word('pack', 'light 1, medium 0.75, heavy 0.5')} * (1 - shade_urgency * 0.3e0) + 1e-9, 6) AS rest_min,"
    f" round(greatest({_word('weather', 'clear 0.15, cloudy 0.2, rain 0.35, snow 0.45, extreme 0.6')}, shade_urgency * 0.5e0) + 1e-9, 6) AS shelter_weight, round(survival_h + 1e-9, 6) AS survival_h, round(heat_risk + 1e-9, 6) AS heat_risk, round(dehydration_l_h + 1e-9, 6) AS dehydration_l_h,"
    " CASE WHEN heat_risk > 0.7e0 OR survival_h < 12 THEN 'critical' WHEN heat_risk > 0.4e0 OR survival_h < 24 THEN 'high' WHEN heat_risk > 0.2e0 OR survival_h < 48 THEN 'moderate' ELSE 'low' END AS risk FROM trips",
)
def _m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = rescue.derive_trip(view(spark, sf_dir, "cases"))
    apart = lambda c: _r(F.col(c) + 1e-9, c)  # ties of the seventh digit fall one way
    return trips.select("case_id", apart("walk_mps"), F.round("most_m", 3).alias("most_m"), "steepest_deg", *[apart(c) for c in ("rest_min", "shelter_weight", "survival_h", "heat_risk", "dehydration_l_h")], "risk")


@_query("m2_radii", with_views("cases") + _TRIP + ", r AS (SELECT case_id, CAST(floor(most_m * 0.25e0 + 0.5e0) AS BIGINT) AS q, CAST(floor(most_m * 0.5e0 + 0.5e0) AS BIGINT) AS h, CAST(floor(most_m + 0.5e0) AS BIGINT) AS w FROM trips) SELECT case_id, concat('500', CASE WHEN q > 500 THEN ',' || q ELSE '' END, CASE WHEN h > q THEN ',' || h ELSE '' END, CASE WHEN w > h THEN ',' || w ELSE '' END) AS radii FROM r")
def _m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rescue.search_radii(rescue.derive_trip(view(spark, sf_dir, "cases")))
    return out.select("case_id", F.array_join(F.col("radii").cast("array<string>"), ",").alias("radii"))


@_query(
    "m3_rings",
    with_views("cases", "features") + ", e AS (SELECT DISTINCT CAST(floor(lon) AS BIGINT) AS cx, CAST(floor(lat) AS BIGINT) AS cy FROM features),"
    " p AS (SELECT case_id, radius, lon, lat, lat + radius / 111320e0 * cos(k * pi() / 8) AS plat, lon + radius / (111320e0 * cos(radians(lat))) * sin(k * pi() / 8) AS plon FROM cases, (SELECT unnest([500, 1000, 3000, 5000]) AS radius), range(16) AS ks(k)),"
    " s AS (SELECT case_id, radius, lon, lat, count(cx) AS samples FROM p LEFT JOIN e ON cx = floor(plon) AND cy = floor(plat) GROUP BY ALL)"
    " SELECT case_id, radius, samples, CASE WHEN samples > 0 THEN 1e0 ELSE 0.3e0 END AS probability, round(lon + radius / (111320e0 * cos(radians(lat))), 6) AS east, 65 AS points FROM s",
)
def _m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = view(spark, sf_dir, "features").groupBy(F.floor("lon").alias("cx"), F.floor("lat").alias("cy")).agg(F.avg("height").alias("v"))
    rings = rescue.search_rings(view(spark, sf_dir, "cases"), held, 1.0)
    return rings.select("case_id", "radius", "samples", "probability", _r(F.get("ring", F.lit(16))["lon"], "east"), F.size("ring").alias("points"))


def _metres(a: str, b: str, c: str, d: str) -> str:
    return f"12742000e0 * asin(least(1e0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_DETOUR = f"coalesce({_word('goal', 'transit 1, exploration 1.25, summit 1.2, search 1.4, lost 1.6')}, 1e0)"
_MODEL = f"""
, f AS (SELECT * FROM anchors QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY seq) = 1),
w AS (SELECT * FROM anchors WHERE NOT is_end QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY hours DESC, seq) = 1),
s AS (SELECT n.case_id, {_metres("f.lat", "f.lon", "n.lat", "n.lon")} * {_DETOUR} / (n.hours * 3600) AS speed FROM anchors n JOIN f ON n.case_id = f.case_id AND n.seq > f.seq JOIN cases k ON k.case_id = n.case_id WHERE n.hours > 0),
m AS (SELECT case_id, list_sort(list(speed))[CAST(floor(count(*) / 2) AS INT) + 1] AS speed FROM s WHERE speed > 0 AND speed < 3 GROUP BY case_id),
g AS (SELECT trips.*, m.speed, {_DETOUR} AS detour, {_word("navigation", "gps 0.02, compass-map 0.08, landmark 0.25, none 0.45")} AS lost, multi_day AND camping AND planned_days > 1 AS several, {_word("perception", "precise 1, approximate 0.9, exaggerated 0.6, unreliable 0.75")} AS ps,
 {_word("perception", "precise 0.05, approximate 0.2, exaggerated 0.35, unreliable 0.5")} AS pd, w.lat AS seen_lat, w.lon AS seen_lon, w.hours AS seen_h, w.seq = f.seq AS same, f.lat AS flat, f.lon AS flon FROM trips LEFT JOIN m USING (case_id) LEFT JOIN w USING (case_id) LEFT JOIN f USING (case_id)),
h AS (SELECT *, CASE WHEN speed IS NOT NULL THEN speed / walk_mps ELSE ps END AS scale, coalesce(speed, walk_mps) / detour / CASE WHEN lost > 0.2e0 THEN 1 + (lost - 0.2e0) * 0.5e0 ELSE 1 END AS pace_mps,
 CASE WHEN speed IS NOT NULL THEN least(pd, 0.15e0) ELSE pd END + CASE WHEN lost > 0.2e0 THEN lost * 0.3e0 ELSE 0 END AS doubt_h, greatest(15e0, least(60e0, steepest_deg + {_word("tolerance", "cautious -5, moderate 0, aggressive 8, reckless 15")})) AS slope_deg FROM g),
models AS (SELECT *, CASE WHEN several THEN CAST(16 + 14 + 12 * (planned_days - 2) AS DOUBLE) ELSE least(16e0, claimed_hours * scale) END AS total_h,
 CASE WHEN same THEN -1e0 ELSE (degrees(atan2(sin(radians(seen_lon - flon)) * cos(radians(seen_lat)), cos(radians(flat)) * sin(radians(seen_lat)) - sin(radians(flat)) * cos(radians(seen_lat)) * cos(radians(seen_lon - flon)))) + 360e0) % 360e0 END AS bearing FROM h)
"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.calibrate(rescue.derive_trip(view(spark, sf_dir, "cases")), view(spark, sf_dir, "anchors"))


@_query("m4_calibrate", with_views("cases", "anchors") + _TRIP + _MODEL + "SELECT case_id, round(pace_mps, 6) AS pace_mps, round(scale, 6) AS perception_scale, round(doubt_h, 6) AS doubt_h, slope_deg, total_h IS NOT NULL AND several AS several_days, round(total_h, 6) AS total_h, seen_h, round(CASE WHEN seen_h IS NOT NULL THEN pace_mps * greatest(0e0, total_h - seen_h) * 3600 END, 3) AS beyond_m, round(bearing, 6) AS bearing FROM models")
def _m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir).select("case_id", _r("pace_mps", "pace_mps"), _r("perception_scale", "perception_scale"), _r("doubt_h", "doubt_h"), "slope_deg", "several_days", _r("total_h", "total_h"), "seen_h", F.round("beyond_m", 3).alias("beyond_m"), _r("bearing", "bearing"))


@_query("m5_reach", with_views("cases", "anchors") + _TRIP + _MODEL + ", q AS (SELECT case_id, pace_mps * 3600 * CASE WHEN several THEN total_h ELSE hours END AS way, pace_mps * 3600 * (doubt_h + CASE WHEN several THEN 4 ELSE 0 END) AS slack FROM models) SELECT case_id, round(greatest(0e0, way - slack), 3) AS near_m, round(way, 3) AS nominal_m, round(way + slack, 3) AS far_m FROM q")
def _m5_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.reach_radius(_models(spark, sf_dir), F.col("hours")).select("case_id", *[F.round(c, 3).alias(c) for c in ("near_m", "nominal_m", "far_m")])


@_query("m5_cone", with_views("cases", "anchors") + _TRIP + _MODEL + "SELECT case_id, seen_lat AS lat, seen_lon AS lon, round(greatest(0e0, bearing), 6) AS bearing, CASE WHEN same THEN 360 WHEN lost > 0.3e0 THEN 120 WHEN lost < 0.1e0 THEN 30 ELSE 60 END AS spread_deg, round(pace_mps * greatest(0e0, total_h - seen_h) * 3600, 3) AS max_m FROM models WHERE seen_lat IS NOT NULL")
def _m5_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.search_cone(_models(spark, sf_dir)).select("case_id", "lat", "lon", _r("bearing", "bearing"), "spread_deg", F.round("max_m", 3).alias("max_m"))


@_query("m5_claim", with_views("cases", "anchors") + _TRIP + _MODEL + ", i AS (SELECT case_id, claimed_hours, pace_mps, CASE WHEN claimed_hours > 0 THEN most_m * detour / (claimed_hours * 3600) ELSE 0 END AS v FROM models) SELECT case_id, round(v, 6) AS implied_mps, claimed_hours <= 0 OR v / pace_mps BETWEEN 0.3e0 AND 1.5e0 AS credible FROM i")
def _m5_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.claim_credibility(_models(spark, sf_dir), F.col("most_m")).select("case_id", _r("implied_mps", "implied_mps"), "credible")


def _peaks(dem: DataFrame, name: str) -> DataFrame:
    return dem.where("v >= 200").select((F.col("y") * 40 + F.col("x")).alias(name), "x", "y")


@_on("dem", "m6_rest_points")
def _m6(dem: DataFrame) -> DataFrame:
    out = corridors.rest_points(dem, _peaks(dem, "case_id"), dem.where("v < 15").select("x", "y"), hours=0.5)
    return out.select("case_id", "x", "y", _r("score", "score"), F.array_join("reasons", ",").alias("reasons"))


@_on("dem", "m7_fall_zones")
def _m7(dem: DataFrame) -> DataFrame:
    return corridors.fall_zones(dem).withColumn("slope", F.round("slope", 6))


_STEPS = "d(k, i, j) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)), s(k, i, j) AS (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1), (4, 1, 1), (5, 1, -1), (6, -1, 1), (7, -1, -1))"


@_on(
    "dem",
    "m8_downhill",
    f", {_STEPS}, l AS (SELECT a.x, a.y, b.x AS tx, b.y AS ty FROM dem a, d JOIN dem b ON b.x = a.x + i AND b.y = a.y + j WHERE b.v < a.v QUALIFY row_number() OVER (PARTITION BY a.x, a.y ORDER BY a.v - b.v DESC, k) = 1),"
    " p AS (SELECT y * 40 + x AS start_id, -1 AS branch, 0 AS step, x, y FROM dem WHERE v >= 200 UNION ALL SELECT a.y * 40 + a.x, k, 0, b.x, b.y FROM dem a, s JOIN dem b ON b.x = a.x + i AND b.y = a.y + j WHERE a.v >= 200 AND b.v < a.v"
    " UNION ALL SELECT start_id, branch, step + 1, tx, ty FROM p JOIN l ON p.x = l.x AND p.y = l.y WHERE step < CASE WHEN branch < 0 THEN 500 ELSE 200 END)"
    " SELECT start_id, branch, step, x, y, n FROM (SELECT *, count(*) OVER (PARTITION BY start_id, branch) AS n FROM p) WHERE n >= CASE WHEN branch < 0 THEN 2 ELSE 3 END",
)
def _m8(dem: DataFrame) -> DataFrame:
    return corridors.downhill_paths(dem, _peaks(dem, "start_id"))


@_on("dem", "m9_deposition")
def _m9(dem: DataFrame) -> DataFrame:
    return corridors.deposition_zones(dem, corridors.downhill_paths(dem, _peaks(dem, "start_id"))).select("start_id", "branch", "step", "x", "y", "kind", "priority")


@_on("dem", "m10_choke_points")
def _m10(dem: DataFrame) -> DataFrame:
    return corridors.choke_points(dem, corridors.downhill_paths(dem, _peaks(dem, "start_id")))


@_on("dem", "m10_terminal_zones")
def _m10_end(dem: DataFrame) -> DataFrame:
    return corridors.terminal_zones(corridors.downhill_paths(dem, _peaks(dem, "start_id"))).select("start_id", "x", "y", "radius_m", _r("area_km2", "area_km2"))


@_on(
    "dem",
    "m11_road_raster",
    ", g AS (SELECT x AS ax, y AS ay, x + CAST(v AS INT) % 9 AS zx, y + CAST(v AS INT) % 5 AS zy, CASE x % 4 WHEN 0 THEN 0.15e0 WHEN 1 THEN 0.2e0 WHEN 2 THEN 0.4e0 ELSE 1e0 END AS cost FROM dem),"
    " n AS (SELECT *, greatest(zx - ax, zy - ay) AS n FROM g WHERE cost < 1), k AS (SELECT *, unnest(range(n + 1)) AS k FROM n), r AS (SELECT *, CASE WHEN n > 0 THEN CAST(k AS DOUBLE) / n ELSE 0e0 END AS f FROM k),"
    " p AS (SELECT CAST(floor(ax + (zx - ax) * f + 0.5e0) AS BIGINT) AS x, CAST(floor(ay + (zy - ay) * f + 0.5e0) AS BIGINT) AS y, cost FROM r), c AS (SELECT x, y, min(cost) AS cost FROM p WHERE x <= 39 GROUP BY x, y)"
    " SELECT x + i AS x, y + j AS y, round(min(CASE WHEN i = 0 AND j = 0 THEN cost ELSE least(1e0, cost + 0.15e0) END), 6) AS cost FROM c, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE x + i BETWEEN 0 AND 39 AND y + j >= 0 GROUP BY ALL",
)
def _m11(dem: DataFrame) -> DataFrame:
    v = F.col("v").cast("int")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cost = F.when(F.col("x") % 4 == 0, 0.15).when(F.col("x") % 4 == 1, 0.2).when(F.col("x") % 4 == 2, 0.4).otherwise(1.0)
    segments = dem.select(cost.alias("cost"), F.array(point(F.col("x"), F.col("y")), point(F.col("x") + v % 9, F.col("y") + v % 5)).alias("points"))
    return corridors.raster_roads(segments, 40, 1 << 30).select("x", "y", _r("cost", "cost"))


def _sources(dem: DataFrame) -> DataFrame:
    return dem.where("v >= 240").select("x", "y")


@_on("dem", "m12_routes")
def _m12(dem: DataFrame) -> DataFrame:
    lows = dem.where("v < 20").select((F.col("y") * 40 + F.col("x")).alias("target_id"), "x", "y")
    walked = corridors.route_profile(corridors.routes(grids.cost_distance(dem, _sources(dem)), lows))
    return walked.select("target_id", "cells", *[F.round(c, 3).alias(c) for c in ("seconds", "distance_m", "ascent_m", "descent_m")])


@_on("dem", "m13_incidents")
def _m13(dem: DataFrame) -> DataFrame:
    lows = dem.where("v < 20").select((F.col("y") * 40 + F.col("x")).alias("target_id"), "x", "y")
    out = corridors.incidents(dem, _sources(dem), lows)
    return out.withColumns({"seconds": F.round("seconds", 3), "slope": F.round("slope", 6)})
