"""Spherical and tile geometry as Column expressions (degrees in, kilometres or metres out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def floor_half(x: Column) -> Column:
    """Round half up: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2.0)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360, clockwise from north; a hair west of north rounds to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def destination_point(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """(lat, lon) after a great-circle step."""
    p, t, d = F.radians(lat), F.radians(bearing), km / EARTH_KM
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    step = F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(lon + F.degrees(step) + 540.0, F.lit(360.0)) - 180.0


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    """Inclusive box; a box with west > east crosses the antimeridian."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return across & lat.between(south, north)


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile that holds a point."""
    n = float(1 << zoom)
    phi = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n)
    return F.least(F.greatest(x, F.lit(0)), F.lit(int(n) - 1)), F.least(F.greatest(y, F.lit(0)), F.lit(int(n) - 1))


def tile_box(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) of a tile."""
    n = float(1 << zoom)

    def lat_of(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * row / n))))

    return x / n * 360.0 - 180.0, lat_of(y + 1), (x + 1) / n * 360.0 - 180.0, lat_of(y)


def cell_size_m(lat: Column, zoom: int) -> Column:
    """Metres of a pixel of a 256-pixel tile at a latitude."""
    return F.cos(F.radians(lat)) * (2 * math.pi * 6378137.0 / (256 * (1 << zoom)))


def ring(lat: Column, lon: Column, radius_km: Column, corners: int = 64) -> Column:
    """A closed ring of points around a centre, as array<struct<lng, lat>>."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(corners)),
        lambda k: F.struct(*[c.alias(n) for n, c in zip(("lat", "lng"), destination_point(lat, lon, k * (360.0 / corners), radius_km), strict=True)]),
    )


def degrees_per_metre() -> float:
    return 180.0 / (math.pi * EARTH_KM * 1000.0)


def offset_point_m(lat: Column, lon: Column, east_m: Column, north_m: Column) -> tuple[Column, Column]:
    """(lat, lon) after a short way on the tangent plane; the pole's own longitude stays."""
    along = F.cos(F.radians(lat))
    return lat + north_m * degrees_per_metre(), lon + F.when(along > 1e-12, east_m * degrees_per_metre() / along).otherwise(0.0)


def dist_planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between near points on the plane that touches half way; the shorter way round in longitude."""
    turn = F.pmod(lon2 - lon1 + 540.0, F.lit(360.0)) - 180.0
    return F.hypot(turn * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1) / degrees_per_metre()


def pixel_xy(lat: Column, lon: Column, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    """Pixel of a point in its Web-Mercator tile, from the upper left."""
    n = float(1 << zoom)
    phi = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    x, y = (lon + 180.0) / 360.0 * n, (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n
    inside = lambda c: F.least(F.floor((c - F.floor(c)) * tile), F.lit(tile - 1))
    return inside(x), inside(y)


def optimal_zoom(west: Column, south: Column, east: Column, north: Column, preferred: int = 15, tiles: int = 32) -> Column:
    """The greatest zoom up to ``preferred`` at which a box takes at most ``tiles`` tiles along either side; else 0."""
    fits = []
    for zoom in range(preferred, 0, -1):
        (x0, y0), (x1, y1) = tile_xy(north, west, zoom), tile_xy(south, east, zoom)
        fits.append(F.when((x1 - x0 < tiles) & (y1 - y0 < tiles), zoom))
    return F.coalesce(*fits, F.lit(0))


def day_of_year(ts: Column) -> Column:
    """Days since the year began, with the part of the day that has passed."""
    at = ts.cast("timestamp")
    return F.dayofyear(at) - 1 + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) / 86400.0


def in_padded_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float, pad: float = 10.0, tallest: float = 170.0) -> Column:
    """Whether a point lies in a view with ``pad`` degrees around it; a view taller than ``tallest`` with its padding shows everything,
    and one that goes round the earth all longitudes."""
    if north - south + 2 * pad > tallest:
        return F.lit(True)
    width = (east - west) % 360.0 + 2 * pad
    across = F.lit(True) if width >= 360.0 else F.pmod(lon - F.lit(west - pad), F.lit(360.0)) <= width
    return lat.between(south - pad, north + pad) & across


def arrow_end(lat: Column, lon: Column, speed: Column, direction: Column, degrees_per_speed: float = 0.5, longest: float = 5.0) -> tuple[Column, Column]:
    """(lat, lon) of the point of an arrow as long as a current is fast, ``longest`` degrees at most."""
    length, towards = F.least(speed * degrees_per_speed, F.lit(longest)), F.radians(direction)
    return lat + length * F.cos(towards), lon + length * F.sin(towards) / F.cos(F.radians(lat))
