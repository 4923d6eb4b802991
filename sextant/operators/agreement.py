"""Agreement between neighbours and peers: temperature and density of nearby stations, values of assets of one kind, links.

Neighbours meet in the cells of ``spatial.radius_join``; means over groups are sums joined back with the row's own share
taken off, so no group is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.geo import floor_half
from sextant.functions.physics import seawater_density
from sextant.operators import spatial

#: Sources that others are measured against.
REFERENCES = ("ARGO", "BGC_ARGO")
#: Kinds of assets that others are linked to, and those that link to them.
SUPPLY = ("substation", "power_plant", "renewable_farm", "battery_storage")
COMPUTE = ("data_center", "ai_center", "edge_node")


def nearest_reports(latest: DataFrame, km: float = 500.0, k: int = 5, references: Sequence[str] = REFERENCES, always_first: bool = False) -> DataFrame:
    """Each row's ``k`` first neighbours within ``km``, with rank and depth_gap (null depths count as 0).

    Rows of a reference source take reference neighbours first, by depth, then the others by distance; other rows go by
    distance alone, or with ``always_first`` by distance after the references. ``latest``: id, source, lat, lon, depth, ...
    """
    own, theirs = F.col("source").isin(list(references)), F.col("r_source").isin(list(references))
    gap = F.abs(F.coalesce("depth", F.lit(0.0)) - F.coalesce("r_depth", F.lit(0.0)))
    behind = (~theirs).cast("int") if always_first else F.when(own, (~theirs).cast("int")).otherwise(0)
    near = spatial.knn(latest, km, k, [behind, F.when(own & theirs, gap).otherwise(F.col("distance_km"))], by=["source", "depth"])
    return near.select("*", gap.alias("depth_gap"), own.alias("_own"), theirs.alias("_theirs"))


def _severity() -> Column:
    return F.when(F.col("_theirs"), "critical").otherwise("warning")


def _counts() -> Column:
    """A reference is only held against references of about its depth."""
    return ~F.col("_own") | (F.col("_theirs") & (F.col("depth_gap") < 50))


def temperature_mismatch(latest: DataFrame, tolerance: float = 5.0, within_km: float = 200.0, km: float = 500.0) -> DataFrame:
    """(id, r_id, gap, severity) of water temperatures too far from a neighbour's.

    Of the five first neighbours, those nearer than ``within_km``; the tolerance grows by 4 beyond 20 m and by 8 beyond
    100 m of difference in depth.
    """
    near = nearest_reports(latest.where("water_temp IS NOT NULL"), km)
    gap = F.abs(F.col("water_temp") - F.col("r_water_temp"))
    allowed = tolerance + F.when(F.col("depth_gap") > 100, 8.0).when(F.col("depth_gap") > 20, 4.0).otherwise(0.0)
    out = near.where((gap > allowed) & (F.col("distance_km") < within_km) & _counts())
    return out.select("id", "r_id", gap.alias("gap"), _severity().alias("severity"))


def density_mismatch(latest: DataFrame, tolerance: float = 2.0, within_km: float = 200.0, km: float = 500.0) -> DataFrame:
    """(id, r_id, delta, severity): the first neighbour by rank whose surface density is too far off, if it counts.

    The tolerance grows by 1.5 beyond 20 m and by 3 beyond 100 m of difference in depth, and by 1 beyond 100 m and 2 beyond
    500 m of difference in ``sea_depth`` (null: 0). Densities are those at one atmosphere, so depth itself plays no part.
    """
    known = latest.where("water_temp IS NOT NULL AND salinity IS NOT NULL").withColumn("density", seawater_density(F.col("water_temp"), F.col("salinity")))
    near = nearest_reports(known, km, always_first=True)
    floor_gap = F.abs(F.coalesce("sea_depth", F.lit(0.0)) - F.coalesce("r_sea_depth", F.lit(0.0)))
    allowed = tolerance + F.when(F.col("depth_gap") > 100, 3.0).when(F.col("depth_gap") > 20, 1.5).otherwise(0.0) + F.when(floor_gap > 500, 2.0).when(floor_gap > 100, 1.0).otherwise(0.0)
    delta = F.abs(F.col("density") - F.col("r_density"))
    off = near.withColumn("delta", delta).where((delta > allowed) & (F.col("distance_km") < within_km))
    first = off.groupBy("id").agg(F.min(F.struct("rank", "r_id", "delta", "_own", "_theirs", "depth_gap")).alias("n")).select("id", "n.*")
    return first.where(_counts()).select("id", "r_id", "delta", _severity().alias("severity"))


def peer_flags(assets: DataFrame, value: str, km: float = 300.0, share: float = 0.3, limit: float = 3.0) -> DataFrame:
    """(id, rule, amount) of assets (id, type, country, source, lat, lon, ``value``) unlike their peers; zeros take no part.

    nearby: differs from one of the five nearest of its type within ``km`` by ``share`` of the larger value, the largest
    such share. outlier: deviations from the other assets of its type, where there are more than three. sources: share by
    which it is off the mean of other sources' assets of its country and type.
    """
    x = F.col(value)
    rows = assets.where(x.isNotNull() & (x != 0))
    own = rows.select("id", "type", "lat", "lon", value)
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance_km", "r_id"))
    near = spatial.radius_self_join(own, km).where("type = r_type").withColumn("_r", place).where("_r <= 5")
    apart = F.abs(x - F.col(f"r_{value}")) / F.greatest(x, F.col(f"r_{value}"))
    nearby = near.withColumn("amount", apart).where(F.col("amount") >= share).groupBy("id").agg(F.max("amount").alias("amount")).select("id", F.lit("nearby").alias("rule"), "amount")

    kinds = rows.groupBy("type").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    n, mean = F.col("n") - 1, F.try_divide(F.col("s") - x, F.col("n") - 1)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - x * x, n) - mean * mean))
    z = F.abs(x - mean) / F.when(spread > 0, spread).otherwise(1.0)
    outlier = rows.join(kinds, "type").where("n > 4").select("id", F.lit("outlier").alias("rule"), z.alias("amount")).where(F.col("amount") > limit)

    held = rows.groupBy("country", "type", "source").agg(F.count("*").alias("sn"), F.sum(x).alias("ss"))
    whole = held.groupBy("country", "type").agg(F.sum("sn").alias("wn"), F.sum("ss").alias("ws"))
    others = held.join(whole, ["country", "type"]).where("wn > sn").select("country", "type", "source", F.try_divide(F.col("ws") - F.col("ss"), F.col("wn") - F.col("sn")).alias("_mean"))
    sources = rows.join(others, ["country", "type", "source"]).where("_mean != 0").select("id", F.lit("sources").alias("rule"), F.try_divide(F.abs(x - F.col("_mean")), F.abs("_mean")).alias("amount")).where(F.col("amount") >= share)
    return nearby.unionByName(outlier).unionByName(sources)


def asset_links(assets: DataFrame) -> DataFrame:
    """Links of assets (id, type, lat, lon): source_id, target_id, kind, distance_km, latency_ms.

    Compute sites take fibre to their three nearest supply sites nearer than 400 km, transformers lines to their two nearest
    nearer than 300 km, and any two supply sites up to 800 km apart a line, direct current from 400 km on. Equal distances
    go by id. Delay is a whole number: 1 ms per 20 km of fibre, per 30 km of line.
    """
    rows = assets.select("id", "type", "lat", "lon")
    supply = rows.where(F.col("type").isin(list(SUPPLY)))

    def nearest(kinds: Sequence[str], km: float, k: int, kind: str) -> DataFrame:
        near = spatial.knn(rows.where(F.col("type").isin(list(kinds))), math.nextafter(km, 0.0), k, of=supply)
        return near.select("id", "r_id", F.lit(kind).alias("kind"), "distance_km")

    # every pair is a row of the result, so small files are dealt to all tasks first
    dealt = supply.repartition(int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    between = spatial.radius_join(dealt, supply, 800.0).where("id < r_id")
    lines = between.select("id", "r_id", F.when(F.col("distance_km") < 400, "ac_line").otherwise("dc_line").alias("kind"), "distance_km")
    links = nearest(COMPUTE, 400.0, 3, "fiber").unionByName(lines).unionByName(nearest(["transformer"], 300.0, 2, "ac_line"))
    per = F.when(F.col("kind") == "fiber", 20.0).otherwise(30.0)
    return links.select(F.col("id").alias("source_id"), F.col("r_id").alias("target_id"), "kind", "distance_km", floor_half(F.col("distance_km") / per).alias("latency_ms"))
