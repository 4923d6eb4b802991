"""Readers of landed feed files: nested or columnar JSON, CSV, text and XML into typed tables.

Collectors land files; these functions only read them, with schemas given, so that no pass over the data infers them.
Each has a transform of its own (``*_rows``) that works on a batch or a streaming DataFrame alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.geo import floor_half

QUAKES = "features array<struct<id:string,properties:struct<mag:double,place:string,time:long,tsunami:int>,geometry:struct<coordinates:array<double>>>>"
VESSELS = "features array<struct<mmsi:string,properties:struct<mmsi:string,name:string,speed:double,heading:double,status:string,timestamp:long>,geometry:struct<coordinates:array<double>>>>"
STATES = "time long, states array<array<string>>"
TABLEDAP = "table struct<columnNames:array<string>,rows:array<array<string>>>"
FORECAST = "hourly struct<time:array<string>,temperature:array<double>,precipitation:array<double>,wind:array<double>>"
FIRE_EVENTS = "events array<struct<id:string,centroid:array<double>,maxFrp:double,confidence:string,viirsCount:long,goesCount:long,lastSeen:string,count:long>>"
STRIKES = "time long, lat double, lon double, pol int"
METAR = "icaoId string, lat double, lon double, temp double, wspd double, wdir double, altim double, obsTime long"
OSM = "elements array<struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>,members:array<struct<role:string,geometry:array<struct<lon:double,lat:double>>>>>>"
RADAR = "radar struct<past:array<struct<time:long,path:string>>,nowcast:array<struct<time:long,path:string>>>, satellite struct<infrared:array<struct<time:long,path:string>>>"
SCENES = "features array<struct<id:string,bbox:array<double>,properties:struct<datetime:string,`eo:cloud_cover`:double>,assets:map<string,struct<href:string>>>>"
STORMS = "activeStorms array<struct<id:string,name:string,binNumber:string,classification:string,intensity:string,pressure:string,latitudeNumeric:string,latitude_numeric:string,lat:string,longitudeNumeric:string,longitude_numeric:string,lon:string,movementDir:string,movementSpeed:string,lastUpdate:string>>"
WARNINGS = "features array<struct<properties:struct<id:string,event:string,severity:string,sent:string>,geometry:struct<type:string,coordinates:string>>>"
#: Fixed value: hectopascals of an inch of mercury.
INCH_OF_MERCURY = 33.8639
MOORED = "(?i)moored|anchor"
KNOT = 0.514444


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_quakes(spark: SparkSession, path: str) -> DataFrame:
    return quake_rows(_json(spark, path, QUAKES))


def quake_rows(raw: DataFrame) -> DataFrame:
    """Earthquake features: depth in kilometres becomes a negative height in metres."""
    f = raw.select(F.explode("features").alias("f"))
    at = lambda k: F.get("f.geometry.coordinates", F.lit(k))
    rows = f.select(F.col("f.id").alias("id"), at(0).alias("lon"), at(1).alias("lat"), (-1000 * at(2)).alias("height"), F.col("f.properties.mag").alias("mag"), F.timestamp_millis("f.properties.time").alias("freshness"))
    return rows.where("lon IS NOT NULL AND lat IS NOT NULL")


def aircraft_rows(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Positional state arrays: address, callsign, lon, lat, height, speed and heading at places 0 1 5 6 7 9 10."""
    s = raw.select("time", F.explode("states").alias("s"))
    at = lambda k: F.get("s", F.lit(k))
    number = lambda k: at(k).try_cast("double")
    rows = s.select(at(0).alias("id"), F.trim(at(1)).alias("callsign"), number(5).alias("lon"), number(6).alias("lat"), number(7).alias("height"), number(9).alias("speed"), number(10).alias("heading"), F.timestamp_seconds("time").alias("freshness"))
    rows = rows.where("lon IS NOT NULL AND lat IS NOT NULL")
    return rows.limit(limit) if limit else rows


def vessel_rows(raw: DataFrame) -> DataFrame:
    """Vessels under way: not below 0.1 knots, not moored or at anchor; speed in metres a second."""
    f = raw.select(F.explode("features").alias("f"))
    p = F.col("f.properties")
    rows = f.select(F.coalesce("f.mmsi", p["mmsi"]).alias("id"), p["name"].alias("name"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), p["speed"].alias("knots"), p["heading"].alias("heading"), F.coalesce(p["status"], F.lit("")).alias("status"))
    return rows.where((F.coalesce("knots", F.lit(0.0)) >= 0.1) & ~F.col("status").rlike(MOORED)).withColumn("speed", F.col("knots") * KNOT).drop("knots")


def read_fires(spark: SparkSession, path: str) -> DataFrame:
    """Header-driven CSV of fire pixels; the brightness column has one of two names."""
    raw = spark.read.option("header", True).csv(path)
    bright = [F.col(c).try_cast("double") for c in ("bright_ti4", "brightness") if c in raw.columns]
    rows = raw.select(
        F.concat_ws(":", "acq_date", "acq_time", F.col("latitude"), F.col("longitude")).alias("id"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"),
        (F.coalesce(*bright) if bright else F.lit(None).cast("double")).alias("brightness"), F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-dd HHmm")).alias("freshness"),
    )
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL")


def to_time(x: Column) -> Column:
    """ISO text, epoch seconds or epoch milliseconds (from 10^11 on) as a timestamp."""
    n = x.cast("string").try_cast("double")
    return F.when(n.isNull(), F.try_to_timestamp(x.cast("string"))).when(n >= 1e11, F.timestamp_millis(n.cast("long"))).otherwise(F.timestamp_seconds(n))


def tabledap_rows(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columnar JSON {columnNames, rows}: output name -> source name, numbers or numeric strings as doubles, "time" as time,
    names that end in "id" as text. A source column that is missing gives nulls."""
    t = raw.select(F.col("table.columnNames").alias("names"), F.explode("table.rows").alias("row"))

    def pick(out: str, source: str) -> Column:
        x = F.when(F.array_position("names", source) > 0, F.get("row", F.array_position("names", source).cast("int") - 1))
        return to_time(x) if source == "time" else x if out.endswith("id") else x.try_cast("double")

    return t.select(*[pick(o, s).alias(o) for o, s in columns.items()])


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")


def forecast_rows(raw: DataFrame) -> DataFrame:
    """Parallel hourly arrays as rows."""
    h = raw.select(F.explode(F.arrays_zip("hourly.time", "hourly.temperature", "hourly.precipitation", "hourly.wind")).alias("h"))
    return h.select(to_time(F.col("h.time")).alias("ts"), F.col("h.temperature").alias("temperature"), F.col("h.precipitation").alias("precipitation"), F.col("h.wind").alias("wind"))


def elevation(r: Column, g: Column, b: Column) -> Column:
    """Metres from the three channels of a Terrarium pixel."""
    return r * 256 + g + b / 256 - 32768


def depth_cells(rows: DataFrame, degrees: float = 2.0) -> DataFrame:
    """Mean depth of each cell of a grid; land counts as 0."""
    cell = [floor_half(F.col(c) / degrees).alias(f"{c}_cell") for c in ("lat", "lon")]
    return rows.groupBy(*cell).agg(F.avg(F.greatest(F.lit(0.0), -F.col("altitude"))).alias("depth"))


def by_priority(rows: DataFrame, key: str, source: str, order: list[str]) -> DataFrame:
    """One row of each key, from the source that stands first in ``order``."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source)), F.lit(0)), F.lit(len(order) + 1))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(place, source))).where("_r = 1").drop("_r")


def coords_from_text(x: Column) -> Column:
    """"lng,lat[,z] lng,lat ..." as array<struct<lng, lat>>; parts that are no numbers are left out."""
    parts = F.transform(F.split(F.trim(x), r"\s+"), lambda p: F.split(p, ","))
    points = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("lng"), F.get(p, F.lit(1)).try_cast("double").alias("lat")))
    return F.filter(points, lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """KML placemarks (points and lines) with their coordinates."""
    schema = "name string, _id string, Point struct<coordinates:string>, LineString struct<coordinates:string>"
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    kind = F.when(F.col("LineString").isNotNull(), "line").otherwise("point")
    return raw.select(F.col("_id").alias("id"), "name", kind.alias("type"), coords_from_text(F.coalesce("LineString.coordinates", "Point.coordinates")).alias("coords"))


def read_orbit_elements(spark: SparkSession, path: str) -> DataFrame:
    """Element sets of three lines in a text file: name, satellite number and both lines, where they begin with 1 and 2."""
    triple = F.transform(F.sequence(F.lit(0), F.floor(F.size("lines") / 3).cast("int") - 1), lambda k: F.slice("lines", k * 3 + 1, 3))
    raw = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda v: F.trim(v) != "").alias("lines")).where(F.size("lines") >= 3)
    t = raw.select(F.explode(triple).alias("t"))
    rows = t.select(F.trim(F.get("t", F.lit(0))).alias("name"), F.get("t", F.lit(1)).alias("line1"), F.get("t", F.lit(2)).alias("line2"))
    return rows.where("line1 LIKE '1 %' AND line2 LIKE '2 %'").withColumn("satnum", F.trim(F.substring("line1", 3, 5)))


def fire_cluster_rows(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Fire clusters: the sensor is the first of VIIRS, GOES and MTG that counted it, the brightness a band of its power."""
    e = raw.select(F.explode("events").alias("e")).select("e.*")
    satellite = F.when(F.col("viirsCount") > 0, "VIIRS").when(F.col("goesCount") > 0, "GOES").otherwise("MTG")
    bright = F.when(F.col("maxFrp") > 100, 360.0).when(F.col("maxFrp") > 50, 330.0).otherwise(300.0)
    at = lambda k: F.get("centroid", F.lit(k))
    rows = e.select(F.concat(F.lit("fire:"), F.col("id")).alias("id"), at(0).alias("lon"), at(1).alias("lat"), F.col("maxFrp").alias("frp"), satellite.alias("satellite"), bright.alias("brightness"), "confidence", "count")
    rows = rows.where("lon IS NOT NULL AND lat IS NOT NULL")
    return rows.limit(limit) if limit else rows


def lightning_rows(raw: DataFrame) -> DataFrame:
    """Strikes with nanoseconds as a timestamp of milliseconds; an unknown polarity is 0. Batch and streaming alike."""
    millis = F.expr("(time - pmod(time, 1000000)) div 1000000")  # doubles step by 256 ns at today's times
    rows = raw.select(F.timestamp_millis(millis).alias("ts"), "lat", "lon", F.coalesce("pol", F.lit(0)).alias("polarity"))
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL")


def metar_rows(raw: DataFrame) -> DataFrame:
    """Airport reports, one a station: wind in metres a second, pressure in hectopascals (up to 100 means inches of
    mercury). Reports without temperature, wind and pressure go; of a station's others the latest stays, of equal times the
    greatest by its values, so that reruns agree."""
    pressure = F.when(F.col("altim") <= 100, F.col("altim") * INCH_OF_MERCURY).otherwise(F.col("altim"))
    rows = raw.where("icaoId IS NOT NULL").select(F.col("icaoId").alias("station_id"), F.col("obsTime").alias("at"), "lat", "lon", F.col("temp").alias("air_temp"), (F.col("wspd") * KNOT).alias("wind_speed"), F.col("wdir").alias("wind_dir"), pressure.alias("pressure"))
    values = ["lat", "lon", "air_temp", "wind_speed", "wind_dir", "pressure"]
    some = rows.where("air_temp IS NOT NULL OR wind_speed IS NOT NULL OR pressure IS NOT NULL")
    return some.groupBy("station_id").agg(F.max(F.struct("at", *values)).alias("r")).select("station_id", *[f"r.{c}" for c in values])


def _elements(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("elements").alias("e")).select("e.*")


def road_segments(raw: DataFrame) -> DataFrame:
    """Segments of OpenStreetMap ways that can be followed: id, segment, both ends and the cost of their class."""
    from sextant.operators.classify import road_cost

    ways = road_cost(_elements(raw).where("type = 'way'").withColumn("highway", F.col("tags")["highway"]))
    line = F.expr("transform(sequence(0, size(geometry) - 2), i -> struct(i AS segment, geometry[i] AS a, geometry[i + 1] AS b))")
    s = ways.where(F.size("geometry") >= 2).select("id", "cost", F.explode(line).alias("s"))
    return s.select("id", "s.segment", F.col("s.a.lon").alias("lon1"), F.col("s.a.lat").alias("lat1"), F.col("s.b.lon").alias("lon2"), F.col("s.b.lat").alias("lat2"), "cost")


def water_features(raw: DataFrame) -> DataFrame:
    """Rivers, lakes and springs of OpenStreetMap: nodes as points, ways as lines, relations by their outer members."""
    e = _elements(raw)
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    kind = F.coalesce(tag("waterway"), tag("water"), F.when(tag("natural").isin("water", "spring"), tag("natural")))
    outer = F.flatten(F.transform(F.filter("members", lambda m: m["role"] == "outer"), lambda m: m["geometry"]))
    point = F.when(F.col("lon").isNotNull(), F.array(F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat"))))
    coords = F.when(F.col("type") == "node", point).when(F.col("type") == "way", F.col("geometry")).otherwise(outer)
    return e.select("id", "type", kind.alias("kind"), tag("name").alias("name"), coords.alias("coords")).where("kind IS NOT NULL AND size(coords) > 0").dropDuplicates(["type", "id"])


def infrastructure_features(raw: DataFrame) -> DataFrame:
    """Infrastructure of OpenStreetMap with its kind, position (a way's mean vertex) and voltage; an id counts once however
    many passes returned it."""
    from sextant.operators.classify import infrastructure_kind, largest_voltage

    mean = lambda c: F.aggregate("geometry", F.lit(0.0), lambda s, p: s + p[c]) / F.size("geometry")
    e = _elements(raw).withColumn("kind", infrastructure_kind(F.col("tags")))
    rows = e.select("id", "kind", F.coalesce("lon", F.when(F.size("geometry") > 0, mean("lon"))).alias("lon"), F.coalesce("lat", F.when(F.size("geometry") > 0, mean("lat"))).alias("lat"), largest_voltage(F.try_element_at("tags", F.lit("voltage"))).alias("voltage"))
    return rows.where("kind IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL").dropDuplicates(["id"])


def mosaic(pixels: DataFrame, size: int = 256) -> DataFrame:
    """Pixels of tiles (tx, ty, row, col, v) at their places in the whole mosaic."""
    return pixels.select((F.col("tx") * size + F.col("col")).alias("x"), (F.col("ty") * size + F.col("row")).alias("y"), "v")


def radar_frames(raw: DataFrame) -> DataFrame:
    """(kind, time, path) of past, nowcast and infrared frames."""
    parts = [raw.select(F.lit(k).alias("kind"), F.explode(c).alias("f")) for k, c in (("past", "radar.past"), ("nowcast", "radar.nowcast"), ("infrared", "satellite.infrared"))]
    return parts[0].union(parts[1]).union(parts[2]).select("kind", "f.time", "f.path")


def scene_rows(raw: DataFrame) -> DataFrame:
    """Catalogue items: box, time, cloud cover in percent and the address of each asset."""
    f = raw.select(F.explode("features").alias("f"))
    box = [F.get("f.bbox", F.lit(k)).alias(n) for k, n in enumerate(("west", "south", "east", "north"))]
    return f.select(F.col("f.id").alias("id"), *box, to_time(F.col("f.properties.datetime")).alias("ts"), F.col("f.properties.`eo:cloud_cover`").alias("cloud"), F.transform_values("f.assets", lambda k, v: v["href"]).alias("hrefs"))


def storm_rows(raw: DataFrame) -> DataFrame:
    """Active cyclones: id, name, basin, kind, class, lat, lon, wind_kt, pressure_hpa, movement_deg, movement_kt, ts. Positions come under
    any of three names, numbers as numbers or text; a storm without a position is left out."""
    s = raw.select(F.explode("activeStorms").alias("s")).select("s.*")
    number = lambda c: F.col(c).try_cast("double")
    basin = F.when(F.col("binNumber").startswith("EP"), "East Pacific").when(F.col("binNumber").startswith("AT"), "Atlantic").otherwise("")
    rows = s.select(
        F.concat(F.lit("nhc_"), "id").alias("id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")).alias("name"), basin.alias("basin"), F.lit("tropical_cyclone").alias("kind"), F.coalesce("classification", F.lit("")).alias("class"),
        F.coalesce(*[number(c) for c in ("latitudeNumeric", "latitude_numeric", "lat")]).alias("lat"), F.coalesce(*[number(c) for c in ("longitudeNumeric", "longitude_numeric", "lon")]).alias("lon"),
        number("intensity").alias("wind_kt"), number("pressure").alias("pressure_hpa"), number("movementDir").alias("movement_deg"), number("movementSpeed").alias("movement_kt"), to_time(F.col("lastUpdate")).alias("ts"),
    )
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL")


def warning_rows(raw: DataFrame) -> DataFrame:
    """Weather warnings with the columns of ``storm_rows``: a point's position or the mean vertex of a polygon's outer ring (its closing
    point counts again); those without a geometry are left out."""
    f = raw.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.*")
    ring = F.get(F.from_json("coordinates", "array<array<array<double>>>"), F.lit(0))
    point = F.from_json("coordinates", "array<double>")

    def middle(k: int) -> Column:
        total = F.aggregate(ring, F.lit(0.0), lambda sum_, c: sum_ + F.get(c, F.lit(k)))
        return F.when(F.col("type") == "Polygon", F.try_divide(total, F.size(ring))).when(F.col("type") == "Point", F.get(point, F.lit(k)))

    event = F.coalesce(F.nullif("event", F.lit("")), F.lit("Severe Weather"))
    kind = F.when(event.contains("Tornado"), "tornado").when(event.contains("Tropical") | event.contains("Hurricane"), "tropical_cyclone").otherwise("thunderstorm")
    none = [F.lit(None).cast("double").alias(c) for c in ("wind_kt", "pressure_hpa", "movement_deg", "movement_kt")]
    rows = f.select(F.concat(F.lit("nws_"), "id").alias("id"), event.alias("name"), F.lit("").alias("basin"), kind.alias("kind"), F.coalesce("severity", F.lit("Minor")).alias("class"), middle(1).alias("lat"), middle(0).alias("lon"), *none, to_time(F.col("sent")).alias("ts"))
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL")


def space_snapshot(series: DataFrame) -> DataFrame:
    """One row of the latest value of each series: kp, wind_speed, wind_density, proton_flux, electron_flux, flare, aurora, as_of.

    series: series (kp, wind_speed, wind_density, proton, electron, xray), energy, ts, value. Protons count from 10 MeV,
    electrons from 2 MeV. A series that is missing gives null; of equal times the greatest value counts.
    """
    from sextant.functions.physics import flare_class

    known = series.where("value IS NOT NULL AND ts IS NOT NULL")

    def last(name: str, *energies: str) -> Column:
        mine = F.col("series") == name
        mine = mine & F.col("energy").isin(*energies) if energies else mine
        return F.max(F.when(mine, F.struct("ts", "value")))["value"]

    out = known.agg(
        last("kp").alias("kp"), last("wind_speed").alias("wind_speed"), last("wind_density").alias("wind_density"), last("proton", ">=10 MeV", "10").alias("proton_flux"), last("electron", ">=2 MeV", "2").alias("electron_flux"),
        last("xray").alias("_flux"), F.max("ts").alias("as_of"),
    )
    aurora = F.when(F.col("kp") >= 7, "high").when(F.col("kp") >= 5, "moderate").when(F.col("kp") >= 3, "low").when(F.col("kp").isNotNull(), "minimal")
    return out.withColumns({"flare": F.when(F.col("_flux").isNotNull(), flare_class(F.col("_flux"))), "aurora": aurora}).drop("_flux")
