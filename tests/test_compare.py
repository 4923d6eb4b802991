"""The comparator itself: what must not pass."""

import duckdb
import pytest

from tests.compare import same_rows


@pytest.mark.parametrize(("sql", "same"), [("SELECT 1700000000123 AS n", True), ("SELECT 1700000000124 AS n", False), ("SELECT '1700000000123' AS n", True), ("SELECT 1700000000123 AS m", False)])
def test_integers_are_exact(spark, sql, same):
    df = spark.range(1).selectExpr("1700000000123L AS n")
    if same:
        same_rows(df, duckdb.connect(), sql)
    else:
        with pytest.raises(AssertionError):
            same_rows(df, duckdb.connect(), sql)


def test_floats_are_not(spark):
    same_rows(spark.range(1).selectExpr("0.1D + 0.2D AS x"), duckdb.connect(), "SELECT 0.3e0 AS x")


def test_nanoseconds_keep_their_millisecond(spark):
    from sextant.sources import feeds

    times = [1_700_000_000_000_000_000 + k * 1_000_000 for k in range(1000)] + [-1, -1_000_000]
    raw = spark.createDataFrame([(t, 1.0, 2.0, None) for t in times], "time long, lat double, lon double, pol int")
    got = [r.ms for r in feeds.lightning_rows(raw).selectExpr("unix_millis(ts) AS ms").collect()]
    assert got == [t // 1_000_000 for t in times]


def test_the_latest_report_of_a_station_stays(spark):
    from sextant.sources import feeds

    rows = [("A", 1.0, 2.0, t, 10.0, 90.0, 29.9, at) for t, at in ((5.0, 1), (7.0, 3), (9.0, 2), (6.0, 3))]
    got = feeds.metar_rows(spark.createDataFrame(rows, feeds.METAR).repartition(3)).collect()
    assert [r.air_temp for r in got] == [7.0]
