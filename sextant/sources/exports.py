"""Rows as GeoJSON features and KML placemarks, one text line each, to be written with ``df.write.text``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _xml(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def geojson_feature(id_column: str, lon: str, lat: str, properties: Sequence[str]) -> Column:
    """A point feature; null properties are left out, as JSON writers of Spark do."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_column).alias("id"), point.alias("geometry"), F.struct(*properties).alias("properties")))


def kml_placemark(id_column: str, name: str, lon: str, lat: str, style: str) -> Column:
    text = lambda c: _xml(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.concat(
        F.lit('<Placemark id="'), text(id_column), F.lit('"><name>'), text(name), F.lit("</name><styleUrl>#"), text(style),
        F.lit("</styleUrl><Point><coordinates>"), text(lon), F.lit(","), text(lat), F.lit("</coordinates></Point></Placemark>"),
    )


def geojson_shape(id_column: str, kind: str, coordinates: Column, properties: Sequence[str]) -> Column:
    """A feature of any kind, its coordinates nested as the kind asks: pairs for a LineString, rings of pairs for a Polygon."""
    shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_column).alias("id"), shape.alias("geometry"), F.struct(*properties).alias("properties")))


def closed_ring(points: Column) -> Column:
    """array<array<double>> with the first pair again at the end, as polygons ask; empty and closed ones stay."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return F.when((F.size(points) > 0) & (first != last), F.concat(points, F.array(first))).otherwise(points)


def kml_shape(id_column: str, name: str, kind: str, points: Column, style: str) -> Column:
    """A placemark of a LineString or Polygon from array<struct<lng, lat>>."""
    text = lambda c: _xml(F.coalesce(F.col(c).cast("string"), F.lit("")))
    coords = F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["lng"].cast("string"), p["lat"].cast("string"))), " ")
    body = F.concat(F.lit("<coordinates>"), coords, F.lit("</coordinates>"))
    if kind == "Polygon":
        body = F.concat(F.lit("<outerBoundaryIs><LinearRing>"), body, F.lit("</LinearRing></outerBoundaryIs>"))
    return F.concat(F.lit('<Placemark id="'), text(id_column), F.lit('"><name>'), text(name), F.lit("</name><styleUrl>#"), text(style), F.lit(f"</styleUrl><{kind}>"), body, F.lit(f"</{kind}></Placemark>"))
