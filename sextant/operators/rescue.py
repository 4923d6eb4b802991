"""Search and rescue over tables of cases: what a missing walker can have done, and where to look first.

A case is a row; all of it is Column expressions, joins on case_id and bounded groupings. An unknown word in one of the
factor columns gives nulls in what depends on it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import geo
from sextant.operators.classify import lookup

# Walking speeds (m/s), factors, slope limits (degrees) and survival windows (hours) by word.
PACE_SPEED = {"slow": 0.56, "normal": 1.11, "fast": 1.67}
PACE_HEAT = {"slow": 0.7, "normal": 1.0, "fast": 1.3}
PACE_THIRST = {"slow": 0.8, "normal": 1.0, "fast": 1.3}
PACK_SPEED = {"light": 1.0, "medium": 0.85, "heavy": 0.7}
PACK_REST = {"light": 1.0, "medium": 0.75, "heavy": 0.5}
FITNESS_SPEED = {"unfit": 0.75, "average": 1.0, "fit": 1.15}
FITNESS_HEAT = {"unfit": 0.6, "average": 0.8, "fit": 1.0}
EXPERIENCE_SLOPE = {"novice": 25.0, "experienced": 35.0, "expert": 45.0}
WEATHER_SHELTER = {"clear": 0.15, "cloudy": 0.2, "rain": 0.35, "snow": 0.45, "extreme": 0.6}
WEATHER_WINDOW = {"clear": 72.0, "cloudy": 60.0, "rain": 48.0, "snow": 24.0, "extreme": 12.0}
WEATHER_SPEED = {"clear": 1.0, "cloudy": 0.95, "rain": 0.8, "snow": 0.6, "extreme": 0.4}
SUN = {"morning": 0.4, "midday": 1.0, "afternoon": 0.7, "night": 0.0}
AGE_HEAT = {"young": 0.8, "adult": 1.0, "elderly": 1.5}
PERCEPTION_SCALE = {"precise": 1.0, "approximate": 0.9, "exaggerated": 0.6, "unreliable": 0.75}
PERCEPTION_DOUBT = {"precise": 0.05, "approximate": 0.2, "exaggerated": 0.35, "unreliable": 0.5}
DISORIENTATION = {"gps": 0.02, "compass-map": 0.08, "landmark": 0.25, "none": 0.45}
RISK_SLOPE = {"cautious": -5.0, "moderate": 0.0, "aggressive": 8.0, "reckless": 15.0}
DETOUR = {"transit": 1.0, "exploration": 1.25, "summit": 1.2, "search": 1.4, "lost": 1.6}
PREFERENCE = {"transit": "least-effort", "exploration": "scenic-trail", "summit": "peak-ridge", "search": "peak-ridge", "lost": "valley-contour"}
METRES_PER_DEGREE = 111320.0


def _of(table: Mapping[str, object], column: str) -> Column:
    return lookup(table)[F.col(column)]


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, which greatest and least alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def derive_trip(cases: DataFrame) -> DataFrame:
    """The cases with walk_mps, most_m, steepest_deg, rest_min, shelter_weight, survival_h, heat_risk, dehydration_l_h,
    heat_speed, shade_urgency, severe_h and risk.

    cases: hours (since last seen), day, pace, pack, experience, weather, temperature_c, time_of_day, age_group, fitness.
    """
    t, sun, pack = F.col("temperature_c").cast("double"), _of(SUN, "time_of_day"), _of(PACK_SPEED, "pack")
    body = _clamp((t - 20) / 20) * sun * _of(AGE_HEAT, "age_group") * _of(PACE_HEAT, "pace") * pack
    out = cases.withColumns({
        "heat_risk": _clamp(body / _of(FITNESS_HEAT, "fitness")),
        "shade_urgency": _clamp((t - 20) / 15) * sun,
        "dehydration_l_h": (0.3 + _clamp((t - 15) / 25, high=math.inf) * 1.5) * (0.7 + sun * 0.5) * _of(PACE_THIRST, "pace") * pack,
    })
    out = out.withColumns({"heat_speed": 1 - F.col("heat_risk") * 0.4, "severe_h": 4.0 / F.col("dehydration_l_h")})
    by_heat = F.when(F.col("heat_risk") > 0.7, 6.0).when(F.col("heat_risk") > 0.4, 24.0).otherwise(72.0)
    out = out.withColumns({
        "walk_mps": _of(PACE_SPEED, "pace") * pack * _of(WEATHER_SPEED, "weather") * _of(FITNESS_SPEED, "fitness") * F.col("heat_speed"),
        "steepest_deg": _of(EXPERIENCE_SLOPE, "experience"),
        "rest_min": 60 * _of(PACK_REST, "pack") * (1 - F.col("shade_urgency") * 0.3),
        "shelter_weight": F.when(F.col("shade_urgency").isNotNull(), F.greatest(_of(WEATHER_SHELTER, "weather"), F.col("shade_urgency") * 0.5)),
        "survival_h": F.when(F.col("severe_h").isNotNull(), F.least(_of(WEATHER_WINDOW, "weather"), by_heat, F.col("severe_h"))),
    })
    heat, window = F.col("heat_risk"), F.col("survival_h")
    risk = F.when((heat > 0.7) | (window < 12), "critical").when((heat > 0.4) | (window < 24), "high").when((heat > 0.2) | (window < 48), "moderate")
    tired = F.greatest(F.lit(0.5), 1 - (F.col("day") - 1) * 0.15)
    return out.withColumns({"most_m": F.col("walk_mps") * F.least(F.col("hours").cast("double"), F.lit(24.0)) * 3600 * tired, "risk": F.when(heat.isNotNull(), risk.otherwise("low"))})


def search_radii(trips: DataFrame, first_m: int = 500) -> DataFrame:
    """``radii``: the first ring, then a quarter, half and the whole of most_m in whole metres, each only if wider than the
    one listed before it."""
    whole = F.array(F.lit(first_m).cast("long"), *[geo.floor_half(F.col("most_m") * share).cast("long") for share in (0.25, 0.5, 1.0)])
    named = trips.withColumn("_rings", whole)
    return named.withColumn("radii", F.filter("_rings", lambda r, i: (i == 0) | (r > F.get(F.col("_rings"), i - 1)))).drop("_rings")


def search_rings(cases: DataFrame, elevation: DataFrame, degrees: float, radii: Sequence[int] | str = (500, 1000, 3000, 5000), bearings: int = 16, corners: int = 64) -> DataFrame:
    """case_id, radius, ring (closed, of ``corners`` points), samples (bearings with an elevation), probability.

    cases: case_id, lat, lon, and their own radii if ``radii`` names a column. elevation: cx, cy, v, of cells of
    ``degrees``, one row a cell. The probability is the share of sampled ground that can be walked, all of it here, or 0.3
    where nothing is known. A case meets ``bearings`` cells a ring, so no group grows.
    """
    rings = F.col(radii) if isinstance(radii, str) else F.array(*[F.lit(r) for r in radii])
    at = cases.select("case_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.explode(rings).alias("radius"))

    def point(k: Column, of: int) -> tuple[Column, Column]:
        turn = k * (2 * math.pi / of)
        north, east = F.col("radius") / METRES_PER_DEGREE, F.col("radius") / (METRES_PER_DEGREE * F.cos(F.radians("lat")))
        return F.col("lat") + north * F.cos(turn), F.col("lon") + east * F.sin(turn)

    def corner(k: Column) -> Column:
        lat, lon = point(F.when(k == corners, 0).otherwise(k), corners)
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    sampled = at.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(bearings - 1))))
    lat, lon = point(F.col("_k"), bearings)
    cell = elevation.where("v IS NOT NULL").select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), F.lit(1).alias("_held"))
    met = sampled.select("case_id", "radius", "lat", "lon", F.floor(lon / degrees).alias("cx"), F.floor(lat / degrees).alias("cy")).join(cell, ["cx", "cy"], "left")
    counted = met.groupBy("case_id", "radius", "lat", "lon").agg(F.count("_held").alias("samples"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), corner)
    return counted.select("case_id", "radius", ring.alias("ring"), "samples", F.when(F.col("samples") > 0, 1.0).otherwise(0.3).alias("probability"))


def calibrate(cases: DataFrame, anchors: DataFrame) -> DataFrame:
    """The cases with a walker's model fitted to where and when they were seen.

    cases: case_id, walk_mps and steepest_deg (``derive_trip``), perception, navigation, tolerance, goal, claimed_hours,
    multi_day, planned_days, camping. anchors: case_id, seq, lat, lon, hours, is_end.

    Adds perception_scale, doubt_h, actual_h, total_h, day_h, several_days, pace_mps, slope_deg, preference,
    disorientation, and of the last anchor before the end, if any, seen_lat, seen_lon, seen_h, beyond_m and bearing (-1 if
    it is the first anchor). Speeds count between 0 and 3 m/s; of an even number of them the upper middle one is taken.
    """
    place = F.struct("seq", "lat", "lon", "hours")
    held = anchors.where("case_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND hours IS NOT NULL")
    ends = held.groupBy("case_id").agg(
        F.min_by(place, "seq").alias("_first"),
        F.max_by(F.when(~F.col("is_end"), place), F.when(~F.col("is_end"), F.struct("hours", -F.col("seq")))).alias("_seen"),
    )
    goal = cases.select("case_id", F.coalesce(_of(DETOUR, "goal"), F.lit(1.0)).alias("_detour"))
    metres = geo.haversine_m(F.col("_first.lat"), F.col("_first.lon"), F.col("lat"), F.col("lon"))
    # the division is guarded, as a plan may move it before the filter
    speeds = held.where("hours > 0").join(ends, "case_id").where(F.col("seq") > F.col("_first.seq")).join(goal, "case_id").select("case_id", F.try_divide(metres * F.col("_detour"), F.col("hours") * 3600).alias("speed")).where("speed > 0 AND speed < 3")
    middle = speeds.groupBy("case_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY speed DESC)").alias("_speed"))
    met = cases.join(ends, "case_id", "left").join(middle, "case_id", "left")
    fitted = F.col("_speed").isNotNull() & (F.col("walk_mps") > 0)
    detour, lost = F.coalesce(_of(DETOUR, "goal"), F.lit(1.0)), _of(DISORIENTATION, "navigation")
    astray = lost > 0.2
    days, claimed = F.col("planned_days"), F.col("claimed_hours").cast("double")
    scale = F.when(fitted, F.try_divide(F.col("_speed"), F.col("walk_mps"))).otherwise(_of(PERCEPTION_SCALE, "perception"))
    doubt = F.when(fitted, F.least(_of(PERCEPTION_DOUBT, "perception"), F.lit(0.15))).otherwise(_of(PERCEPTION_DOUBT, "perception"))
    out = met.withColumns({
        "several_days": F.col("multi_day") & F.col("camping") & (days > 1),
        "disorientation": lost,
        "preference": _of(PREFERENCE, "goal"),
        "perception_scale": scale,
        "doubt_h": doubt + F.when(astray, lost * 0.3).otherwise(0.0),
        "actual_h": claimed * F.when(claimed > 0, scale).otherwise(_of(PERCEPTION_SCALE, "perception")),
        "pace_mps": F.coalesce("_speed", "walk_mps") / detour / F.when(astray, 1 + (lost - 0.2) * 0.5).otherwise(1.0),
        "slope_deg": _clamp(F.col("steepest_deg") + _of(RISK_SLOPE, "tolerance"), 15.0, 60.0),
    })
    # 16 hours on the first day, 14 on the second, 12 on each one after
    out = out.withColumns({
        "day_h": F.when(F.col("several_days"), F.when(days >= 3, 12).otherwise(14)).otherwise(16),
        "total_h": F.when(F.col("several_days"), (30 + 12 * (days - 2)).cast("double")).when(F.col("actual_h").isNotNull(), F.least(F.col("actual_h"), F.lit(16.0))),
    })
    seen, first = F.col("_seen"), F.col("_first")
    turned = geo.bearing_deg(first["lat"], first["lon"], seen["lat"], seen["lon"])
    left = F.greatest(F.lit(0.0), F.col("total_h") - seen["hours"])
    return out.withColumns({
        "seen_lat": seen["lat"], "seen_lon": seen["lon"], "seen_h": seen["hours"],
        "beyond_m": F.when(seen.isNotNull() & F.col("total_h").isNotNull(), F.col("pace_mps") * left * 3600),
        "bearing": F.when(seen.isNotNull(), F.when(seen["seq"] == first["seq"], -1.0).otherwise(turned)),
    }).drop("_first", "_seen", "_speed")


def reach_radius(models: DataFrame, hours: Column) -> DataFrame:
    """The models with near_m, nominal_m and far_m: how far in ``hours`` (in the whole trip, if it has several days)."""
    pace = F.col("pace_mps") * 3600
    way = pace * F.when(F.col("several_days"), F.col("total_h")).otherwise(hours)
    slack = pace * F.col("doubt_h") + F.when(F.col("several_days"), pace * 4).otherwise(0.0)
    return models.withColumns({"near_m": F.when(way.isNotNull(), F.greatest(F.lit(0.0), way - slack)), "nominal_m": way, "far_m": way + slack})


def search_cone(models: DataFrame) -> DataFrame:
    """case_id, lat, lon, bearing, spread_deg, max_m beyond the last place seen; no row for cases that weren't seen."""
    lost = F.col("disorientation")
    spread = F.when(F.col("bearing") < 0, 360).when(lost > 0.3, 120).when(lost < 0.1, 30).otherwise(60)
    seen = models.where("seen_lat IS NOT NULL")
    return seen.select("case_id", F.col("seen_lat").alias("lat"), F.col("seen_lon").alias("lon"), F.greatest(F.lit(0.0), F.col("bearing")).alias("bearing"), spread.alias("spread_deg"), F.col("beyond_m").alias("max_m"))


def claim_credibility(models: DataFrame, straight_m: Column) -> DataFrame:
    """The models with implied_mps, credible and verdict of the claimed hours over a straight distance: a speed of over 2
    times (``far too fast``), over 1.5 times (``too fast``) or below 0.3 times (``too slow``) the fitted one isn't
    credible; without claimed hours (``no claim``) it is."""
    claimed = F.col("claimed_hours") > 0
    implied = F.when(claimed, F.try_divide(straight_m * F.coalesce(_of(DETOUR, "goal"), F.lit(1.0)), F.col("claimed_hours") * 3600)).otherwise(0.0)
    pace = F.col("pace_mps")
    verdict = F.when(~F.coalesce(claimed, F.lit(False)), "no claim").when(implied > 2 * pace, "far too fast").when(implied > 1.5 * pace, "too fast").when(implied < 0.3 * pace, "too slow").otherwise("consistent")
    return models.withColumns({"implied_mps": implied, "verdict": verdict}).withColumn("credible", F.col("verdict").isin("no claim", "consistent"))
