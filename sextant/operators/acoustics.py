"""Outdoor sound over terrain: divergence, air, ground and barriers after ISO 9613-1 (1993) and ISO 9613-2 (1996).

Sources and receivers meet on buckets as wide as the reach, so receivers out of reach are never paired. A pair's sight line is a
few samples, each of which looks its ground up by cell (an equi-join) and gives the detour over it; what is kept of a pair
is the greatest detour, by a reduction that is partial before it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.blocks import grid_key

SOUND_M_S = 340.0


def absorption_db_per_m(hertz: float, celsius: float = 10.0, humidity: float = 70.0, kilopascal: float = 101.325) -> float:
    """Attenuation of a pure tone by air (ISO 9613-1, equations 3 to 5 and annex B)."""
    t, p = (celsius + 273.15) / 293.15, kilopascal / 101.325
    saturation = 10 ** (-6.8346 * (273.16 / (celsius + 273.15)) ** 1.261 + 4.6151)
    h = humidity * saturation / p
    oxygen = p * (24 + 4.04e4 * h * (0.02 + h) / (0.391 + h))
    nitrogen = p * t**-0.5 * (9 + 280 * h * math.exp(-4.170 * (t ** (-1 / 3) - 1)))
    kelvin = celsius + 273.15
    relaxed = 0.01275 * math.exp(-2239.1 / kelvin) / (oxygen + hertz**2 / oxygen) + 0.1068 * math.exp(-3352.0 / kelvin) / (nitrogen + hertz**2 / nitrogen)
    return 8.686 * hertz**2 * (1.84e-11 / p * t**0.5 + t**-2.5 * relaxed)


def ground_db(mean_height_m: Column, metres: Column) -> Column:
    """Ground attenuation, the alternative method for A-weighted levels over porous ground (ISO 9613-2, equation 10)."""
    return F.greatest(F.lit(0.0), 4.8 - (2 * mean_height_m / metres) * (17 + 300 / metres))


def screen_db(detour: Column, over: Column, down: Column, direct: Column, hertz: float) -> Column:
    """Diffraction over one edge (ISO 9613-2, equations 14 to 18): at most 20 dB, none far below the sight line."""
    wave = SOUND_M_S / hertz
    bend = F.when(detour > 0, F.exp(-F.sqrt(over * down * direct / (2 * detour)) / 2000)).otherwise(1.0)
    inside = 3 + 20 / wave * detour * bend
    return F.when(inside > 1, F.least(F.lit(20.0), 10 * F.log10(inside))).otherwise(0.0)


def _bucket(c: str, reach: float) -> Column:
    return F.floor(F.col(c) / reach)


def terrain_levels(sources: DataFrame, receivers: DataFrame, cells: DataFrame, reach_m: float, size: float = 30.0, hertz: float = 500.0, receiver_m: float = 1.5, samples: int = 20, celsius: float = 10.0, humidity: float = 70.0, downwind_db: float = 0.0) -> DataFrame:
    """(grid_id if any, x, y, level, n): the level at each receiver that ``n`` sources reach, their energies summed.

    sources: source_id, x, y, power_db, height_m above ground, and optionally directivity_db. receivers: x, y. cells: x, y, v
    (the ground in metres). A pair within ``reach_m`` and not on one spot has 20 lg d + 11 for divergence, absorption,
    ground, and the screen beyond the ground's share where the edge of the greatest detour among up to ``samples`` points between stands
    in the way. Samples off the grid screen nothing; sources and receivers off it are left out.
    """
    key = grid_key(cells)
    long = lambda c: F.col(c).cast("long").alias(c)
    ground = cells.where("v IS NOT NULL").select(*key, long("x"), long("y"), F.col("v").cast("double").alias("_ground"))
    directed = F.col("directivity_db") if "directivity_db" in sources.columns else F.lit(0.0)
    s = sources.select(*key, "source_id", long("x"), long("y"), (F.col("power_db") + directed).alias("power"), F.col("height_m").cast("double").alias("_up")).join(ground, [*key, "x", "y"])
    r = receivers.select(*key, long("x"), long("y")).distinct().join(ground, [*key, "x", "y"]).withColumns({"bx": _bucket("x", reach_m / size), "by": _bucket("y", reach_m / size)})
    around = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _bucket(c, reach_m / size) + d))
    s = s.select(*key, "source_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "power", "_up", (F.col("_ground") + F.col("_up")).alias("sz"), around("x").alias("bx"))
    s = s.select("*", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("sy") / (reach_m / size)) + d)).alias("by"))
    flat = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2) * float(size)
    pairs = s.join(r, [*key, "bx", "by"]).withColumn("flat", flat).where((F.col("flat") > 0) & (F.col("flat") <= reach_m))
    pairs = pairs.withColumn("z", F.col("_ground") + receiver_m).drop("bx", "by", "_ground")
    n = F.least(F.lit(samples), F.floor(F.col("flat") / size)).cast("int")
    at = pairs.withColumn("t", F.explode_outer(F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)), lambda k: k / n)))
    half_up = lambda a, b: F.floor(F.col(a) + F.col("t") * (F.col(b) - F.col(a)) + 0.5)
    looked = at.withColumns({"_x": half_up("sx", "x"), "_y": half_up("sy", "y")}).join(ground.select(*key, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_ground").alias("edge")), [*key, "_x", "_y"], "left")
    direct = F.sqrt(F.col("flat") ** 2 + (F.col("z") - F.col("sz")) ** 2)
    over, down = F.sqrt((F.col("t") * F.col("flat")) ** 2 + (F.col("edge") - F.col("sz")) ** 2), F.sqrt(((1 - F.col("t")) * F.col("flat")) ** 2 + (F.col("edge") - F.col("z")) ** 2)
    sight = F.col("sz") + F.col("t") * (F.col("z") - F.col("sz"))
    detour = F.when(F.col("edge") >= sight, over + down - direct).otherwise(direct - over - down)
    worst = F.max(F.when(F.col("edge").isNotNull(), F.struct(detour.alias("detour"), over.alias("over"), down.alias("down")))).alias("e")
    each = looked.groupBy(*key, "source_id", "sx", "sy", "sz", "power", "_up", "x", "y", "z", "flat").agg(worst).withColumn("direct", direct)
    soft = ground_db((F.col("_up") + receiver_m) / 2, F.col("direct"))
    screen = F.coalesce(F.greatest(F.lit(0.0), screen_db(F.col("e.detour"), F.col("e.over"), F.col("e.down"), F.col("direct"), hertz) - soft), F.lit(0.0))
    level = F.col("power") + downwind_db - (20 * F.log10("direct") + 11) - absorption_db_per_m(hertz, celsius, humidity) * F.col("direct") - soft - screen
    return each.groupBy(*key, "x", "y").agg((10 * F.log10(F.sum(F.pow(F.lit(10.0), level / 10)))).alias("level"), F.count("*").alias("n"))
