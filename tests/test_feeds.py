import json

from pyspark.sql import functions as F

from sextant.sources import feeds


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_quakes(spark, tmp_path):
    body = {"features": [{"id": "q1", "properties": {"mag": 4.5, "time": 1700000000000}, "geometry": {"coordinates": [10.0, -5.5, 12.0]}}, {"id": "q2", "properties": {"mag": None}, "geometry": {"coordinates": []}}]}
    rows = feeds.read_quakes(spark, _file(tmp_path, "q.json", json.dumps(body, indent=1))).collect()
    assert [(r.id, r.lon, r.lat, r.height, r.mag) for r in rows] == [("q1", 10.0, -5.5, -12000.0, 4.5)]


def test_aircraft_and_vessels(spark, tmp_path):
    state = ["abc", "KLM1 ", "NL", 1, 2, "4.5", "52.1", "1000", False, "200.5", "90"]
    raw = spark.read.schema(feeds.STATES).json(_file(tmp_path, "a.json", json.dumps({"time": 1700000000, "states": [state, ["x", None, "y", 0, 0, None, "1"]]})))
    rows = feeds.aircraft_rows(raw).collect()
    assert [(r.id, r.callsign, r.lon, r.speed) for r in rows] == [("abc", "KLM1", 4.5, 200.5)]
    ship = lambda m, v, s: {"properties": {"mmsi": m, "speed": v, "status": s}, "geometry": {"coordinates": [1, 2]}}
    raw = spark.read.schema(feeds.VESSELS).json(_file(tmp_path, "v.json", json.dumps({"features": [ship("1", 10.0, "under way"), ship("2", 0.05, ""), ship("3", 4.0, "Moored"), ship("4", None, None)]})))
    assert [(r.id, round(r.speed, 4)) for r in feeds.vessel_rows(raw).collect()] == [("1", 5.1444)]


def test_fires(spark, tmp_path):
    text = "latitude,longitude,brightness,acq_date,acq_time\n1.5,2.5,330.1,2024-01-02,45\nx,2,1,2024-01-02,1\n"
    rows = feeds.read_fires(spark, _file(tmp_path, "f.csv", text)).collect()
    assert len(rows) == 1 and rows[0].id == "2024-01-02:45:1.5:2.5" and rows[0].brightness == 330.1 and str(rows[0].freshness) == "2024-01-02 00:45:00"


def test_tabledap(spark, tmp_path):
    body = {"table": {"columnNames": ["station", "time", "wtmp"], "rows": [["a", "2024-01-01T00:00:00Z", "12.5"], ["a", 1704153600, None], ["b", 1704153600000, "bad"]]}}
    raw = spark.read.schema(feeds.TABLEDAP).json(_file(tmp_path, "t.json", json.dumps(body)))
    rows = feeds.tabledap_rows(raw, {"station_id": "station", "ts": "time", "water_temp": "wtmp", "salinity": "none"})
    assert [(r.station_id, str(r.ts)[:10], r.water_temp, r.salinity) for r in rows.collect()] == [("a", "2024-01-01", 12.5, None), ("a", "2024-01-02", None, None), ("b", "2024-01-02", None, None)]
    assert {r.station_id: r.water_temp for r in feeds.latest_by(rows, "station_id", "ts").collect()} == {"a": None, "b": None}


def test_forecast_elevation_priority(spark, tmp_path):
    raw = spark.read.schema(feeds.FORECAST).json(_file(tmp_path, "w.json", json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature": [1, 2], "precipitation": [0, 0.5], "wind": [3]}})))
    assert [(r.temperature, r.precipitation, r.wind) for r in feeds.forecast_rows(raw).collect()] == [(1.0, 0.0, 3.0), (2.0, 0.5, None)]
    assert spark.range(1).select(feeds.elevation(F.lit(128), F.lit(10), F.lit(64))).first()[0] == 10.25
    rows = spark.createDataFrame([("v1", "catalogue", 1), ("v1", "live", 2), ("v2", "other", 3)], "id string, src string, x int")
    assert {(r.id, r.x) for r in feeds.by_priority(rows, "id", "src", ["live", "catalogue"]).collect()} == {("v1", 2), ("v2", 3)}


def test_placemarks_and_elements(spark, tmp_path):
    kml = '<kml><Document><Placemark id="p"><name>A</name><Point><coordinates>1,2,3</coordinates></Point></Placemark><Placemark id="l"><name>B</name><LineString><coordinates> 1,2 3,4,0\n x,y </coordinates></LineString></Placemark></Document></kml>'
    rows = {r.id: r for r in feeds.read_placemarks(spark, _file(tmp_path, "p.kml", kml)).collect()}
    assert rows["p"].type == "point" and [(c.lng, c.lat) for c in rows["l"].coords] == [(1.0, 2.0), (3.0, 4.0)]
    tle = "SAT A\n1 25544U 98067A\n2 25544 51.6\nBAD\n3 x\n2 y\n"
    rows = feeds.read_orbit_elements(spark, _file(tmp_path, "s.txt", tle)).collect()
    assert [(r.name, r.satnum) for r in rows] == [("SAT A", "25544")]


def test_space_snapshot(spark):
    rows = [("kp", "", 1, 2.0), ("kp", "", 2, 6.0), ("kp", "", 3, None), ("proton", ">=1 MeV", 9, 50.0), ("proton", "10", 4, 3.0), ("xray", "", 1, 2.5e-5)]
    series = spark.createDataFrame(rows, "series string, energy string, ts int, value double")
    got = feeds.space_snapshot(series).first()
    assert (got.kp, got.aurora, got.proton_flux, got.electron_flux, got.flare, got.as_of) == (6.0, "moderate", 3.0, None, "M2.5", 9)
    none = feeds.space_snapshot(series.limit(0)).first()
    assert none.kp is None and none.aurora is None and none.flare is None
