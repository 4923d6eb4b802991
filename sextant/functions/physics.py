"""Published hydrology, movement and atmosphere formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scs_runoff_mm(rain_mm: Column, curve_number: Column) -> Column:
    """SCS curve-number runoff depth (initial abstraction 0.2 S)."""
    s = F.lit(25400.0) / curve_number - 254.0
    return F.when(rain_mm > 0.2 * s, F.pow(rain_mm - 0.2 * s, F.lit(2.0)) / (rain_mm + 0.8 * s)).otherwise(F.lit(0.0))


def kirpich_minutes(length_m: Column, slope: Column) -> Column:
    """Kirpich (1940) time of concentration."""
    return 0.0195 * F.pow(length_m, F.lit(0.77)) * F.pow(F.greatest(slope, F.lit(1e-4)), F.lit(-0.385))


def tobler_kmh(slope: Column) -> Column:
    """Tobler's hiking function; slope as rise over run."""
    return 6.0 * F.exp(-3.5 * F.abs(slope + 0.05))


def seawater_density(temp_c: Column, salinity: Column) -> Column:
    """UNESCO (1981) one-atmosphere equation of state, kg per cubic metre."""
    t, s = temp_c, salinity
    pure = 999.842594 + 6.793952e-2 * t - 9.09529e-3 * t * t + 1.001685e-4 * F.pow(t, F.lit(3.0)) - 1.120083e-6 * F.pow(t, F.lit(4.0)) + 6.536332e-9 * F.pow(t, F.lit(5.0))
    a = 8.24493e-1 - 4.0899e-3 * t + 7.6438e-5 * t * t - 8.2467e-7 * F.pow(t, F.lit(3.0)) + 5.3875e-9 * F.pow(t, F.lit(4.0))
    b = -5.72466e-3 + 1.0227e-4 * t - 1.6546e-6 * t * t
    return pure + a * s + b * F.pow(s, F.lit(1.5)) + 4.8314e-4 * s * s


def flare_class(flux_w_m2: Column) -> Column:
    """GOES X-ray class with one decimal, such as M2.5."""
    band = F.when(flux_w_m2 >= 1e-4, "X").when(flux_w_m2 >= 1e-5, "M").when(flux_w_m2 >= 1e-6, "C").when(flux_w_m2 >= 1e-7, "B").otherwise("A")
    base = F.when(flux_w_m2 >= 1e-4, 1e-4).when(flux_w_m2 >= 1e-5, 1e-5).when(flux_w_m2 >= 1e-6, 1e-6).when(flux_w_m2 >= 1e-7, 1e-7).otherwise(1e-8)
    return F.concat(band, F.format_number(flux_w_m2 / base, 1))


def storm_scale(kp: Column) -> Column:
    """NOAA geomagnetic storm level 0 to 5 from Kp."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.floor(kp).cast("int") - 4))


def storm_category(wind_kt: Column) -> Column:
    """Saffir-Simpson: -1 depression, 0 tropical storm, 1 to 5 hurricane."""
    return F.when(wind_kt >= 137, 5).when(wind_kt >= 113, 4).when(wind_kt >= 96, 3).when(wind_kt >= 83, 2).when(wind_kt >= 64, 1).when(wind_kt >= 34, 0).otherwise(-1)


def cosine_similarity(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
