import datetime as dt
import math

from pyspark.sql import functions as F

from sextant.operators import agreement, health, rollups

DAY = dt.datetime(2024, 1, 1)
_REPORT = "station_id string, seq long, ts timestamp_ntz, water_temp double, salinity double"


def _reports(spark, rows):
    return spark.createDataFrame([(s, i, DAY + dt.timedelta(seconds=t), w, p) for s, i, t, w, p in rows], _REPORT)


def test_station_penalties_and_scores(spark):
    stations = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", "other"), ("d", None)], "id string, source string")
    steady = [("a", i, i * 60, 1.0, 35.0) for i in range(6)]
    # b: gaps of 1 and 1000 s before its last report, NaN and null in that one
    uneven = [("b", 0, 0, 1.0, 1.0), ("b", 1, 1, 1.0, 1.0), ("b", 2, 1001, 1.0, 1.0), ("b", 3, 1002, math.nan, None)]
    reports = _reports(spark, steady + uneven + [("c", 0, 0, None, None)])
    misses = spark.createDataFrame([("c", 3)], "station_id string, consecutive long")
    as_of = F.lit("2024-01-01 00:10:00")
    got = health.station_penalties(stations, reports, as_of, {"S": 100.0, "other": 100.0}, {"S": ["water_temp", "salinity"]}, misses)
    # b reported in the future, so it isn't late
    want = {("a", "very_late", 25), ("b", "irregular", 15), ("b", "incomplete", 10), ("c", "very_late", 25), ("c", "offline", 20), ("d", "missing", 30)}
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in health.health_scores(stations, got).collect()} == {("a", 25, 75, "warning"), ("b", 25, 75, "warning"), ("c", 45, 55, "warning"), ("d", 30, 70, "warning")}


def test_missing_stations_lack_all_fields_and_empty_tables_are_empty(spark):
    stations, none = spark.createDataFrame([("a", "S")], "id string, source string"), _reports(spark, [])
    got = health.station_penalties(stations, none, F.lit("2024-01-01"), {"S": 1.0}, {"S": ["water_temp", "salinity"]})
    assert {tuple(r) for r in got.collect()} == {("a", "missing", 30), ("a", "incomplete", 10)}
    assert health.health_scores(stations.limit(0), got).count() == 0 and health.recent_regularity(none).count() == 0


def test_regularity_leaves_the_latest_report_out(spark):
    rows = [("a", i, i * 60, 1.0, 1.0) for i in range(5)] + [("a", 5, 9999, 1.0, 1.0), ("b", 0, 0, 1.0, 1.0), ("b", 1, 1, 1.0, 1.0), ("b", 2, 2, 1.0, 1.0)]
    assert {tuple(r) for r in health.recent_regularity(_reports(spark, rows)).collect()} == {("a", 1.0), ("b", None)}
    assert [tuple(r) for r in health.recent_regularity(_reports(spark, rows), 2).where("station_id = 'a'").collect()] == [("a", None)]


def test_fetch_scores(spark):
    log = spark.createDataFrame(
        [("s", 1, 100.0, 1000.0, 2, 2, True), ("s", 5, 6000.0, 1000.0, 0, 20, False), ("s", 7, 2500.0, 9000.0, 19, 20, True), ("t", 1, 1.0, 0.0, 0, 0, True)],
        "source string, fetch_no long, latency_ms double, payload double, received long, expected long, ok boolean",
    )
    at = lambda s: DAY + dt.timedelta(seconds=s)
    packets = [("s", 1, f"p{i}", at(10)) for i in range(8)] + [("s", 5, f"p{i}", at(10)) for i in range(6)] * 2 + [("s", 7, f"p{i}", at(9)) for i in range(4)] + [("s", 7, "p7", at(10))]
    got = {(r.source, r.fetch_no): r for r in health.fetch_scores(log, spark.createDataFrame(packets, "source string, fetch_no long, station_id string, ts timestamp_ntz")).collect()}
    seen = {k: (r.duplicates, r.out_of_order, r.score, r.status) for k, r in got.items()}
    # fetch 5: not ok 40, slow 15, empty 20, 6 duplicates 10, gaps 15, success 0.5 15; fetch 7: slow 5, 4 late packets 10, success 15, payload 10
    assert seen == {("s", 1): (0, 0, 100, "verified"), ("s", 5): (6, 0, 0, "failed"), ("s", 7): (0, 4, 60, "warning"), ("t", 1): (0, 0, 80, "verified")}


def test_connectivity(spark):
    rows = [("f", "fiber", True, True, True, 20.0, 0.0), ("l", "fiber", True, True, True, 20.0, 1.0), ("x", "pigeon", True, True, True, 250.0, 0.0), ("o", "copper", None, True, True, None, None), ("c", "copper", True, False, True, 0.0, 0.0)]
    got = health.connectivity(spark.createDataFrame(rows, "id string, medium string, local boolean, dns boolean, internet boolean, latency_ms double, loss_pct double"))
    assert {(r.id, r.status, r.score) for r in got.collect()} == {("f", "healthy", 100), ("l", "healthy", 50), ("x", "degraded", 90), ("o", "offline", 50), ("c", "critical", 50)}


def test_first_offending_neighbour_only(spark):
    rows = [("a", "X", 0.0, 0.0, 0.0, 0.0, 10.0, 35.0), ("b", "X", 0.0, 0.1, 0.0, 0.0, 10.0, 30.0), ("c", "ARGO", 0.0, 0.5, 0.0, 0.0, 10.0, 28.0), ("n", "X", 0.0, 0.2, 0.0, 0.0, None, 28.0)]
    latest = spark.createDataFrame(rows, "id string, source string, lat double, lon double, depth double, sea_depth double, water_temp double, salinity double")
    got = {(r.id, r.r_id, r.severity) for r in agreement.density_mismatch(latest, tolerance=3.0).collect()}
    # the reference comes first; c itself has no reference to be held against; b and c are within 3
    assert got == {("a", "c", "critical"), ("b", "a", "warning")}
    assert agreement.temperature_mismatch(latest).count() == 0 and agreement.density_mismatch(latest.limit(0)).count() == 0


def test_peers_and_links(spark):
    rows = [(f"a{i}", "t", "N", "s" if i % 2 else "r", 0.0, i * 0.001, 10.0 if i < 9 else 100.0) for i in range(10)] + [("z", "t", "N", "s", 0.0, 0.0, 0.0), ("u", "v", "N", "s", 0.0, 0.0, None)]
    assets = spark.createDataFrame(rows, "id string, type string, country string, source string, lat double, lon double, w double")
    got = {(r.id, r.rule, round(r.amount, 6)) for r in agreement.peer_flags(assets, "w").collect()}
    assert ("a9", "outlier", 90.0) in got and ("a9", "nearby", 0.9) in got and ("a9", "sources", 9.0) in got and not any(i in ("z", "u") for i, _, _ in got)
    sites = spark.createDataFrame([("d", "data_center", 0.0, 0.0), ("p", "power_plant", 0.0, 1.0), ("q", "substation", 0.0, 6.0), ("t", "transformer", 0.0, 1.5), ("n", "substation", None, None)], "id string, type string, lat double, lon double")
    assert {(r.source_id, r.target_id, r.kind, r.latency_ms) for r in agreement.asset_links(sites).collect()} == {("d", "p", "fiber", 6), ("t", "p", "ac_line", 2), ("p", "q", "dc_line", 19)}


def test_summaries_of_empty_tables(spark):
    none = spark.createDataFrame([], "type string, severity string, start timestamp_ntz, duration_s double")
    (row,) = rollups.outage_kinds(none).collect()
    assert (row.outages, row.mean_s, row.type, sum(row.hours)) == (0, None, None, 0)
    stations = spark.createDataFrame([], "type string, source string, on boolean")
    assert rollups.station_activity(stations, F.col("on")).count() <= 1
