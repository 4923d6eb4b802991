"""Geographic views over the driver's tables, in SQL that Spark and DuckDB both read; see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

FEATURES = """SELECT concat('ev:', CAST(event_id AS STRING)) AS id,
 CASE event_type WHEN 'click' THEN 'aircraft' WHEN 'view' THEN 'vessel' WHEN 'purchase' THEN 'fire' WHEN 'error' THEN 'quake' ELSE 'lightning' END AS layer,
 CAST((event_id*7919) % 36000 AS DOUBLE)/CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
 CAST((event_id*10473) % 14000 AS DOUBLE)/CAST(100 AS DOUBLE) - CAST(70 AS DOUBLE) AS lat,
 value*CAST(10 AS DOUBLE) AS height, CAST(event_id % 300 AS DOUBLE) AS speed,
 CAST((event_id*37) % 360 AS DOUBLE) AS heading, ts AS freshness, user_id, props, value AS mag
FROM events"""

STATIONS = """SELECT concat('st:', CAST(user_id AS STRING)) AS id, concat('Station ', CAST(user_id AS STRING)) AS name,
 CASE user_id % 5 WHEN 0 THEN 'buoy' WHEN 1 THEN 'argo_float' WHEN 2 THEN 'weather_station' WHEN 3 THEN 'carbon_station' ELSE 'buoy' END AS type,
 CASE user_id % 5 WHEN 0 THEN 'NOAA_NDBC' WHEN 1 THEN 'ARGO' WHEN 2 THEN 'NWS_WEATHER' WHEN 3 THEN 'PMEL_CO2' ELSE 'TAO_PIRATA' END AS source,
 CAST((user_id % 8)*20 - 70 AS DOUBLE) + CAST((user_id*13) % 30 AS DOUBLE)/CAST(10 AS DOUBLE) AS lat,
 CAST((user_id % 8)*44 - 175 AS DOUBLE) + CAST((user_id*29) % 30 AS DOUBLE)/CAST(10 AS DOUBLE) AS lon,
 CAST((user_id*17) % 500 AS DOUBLE) AS depth, max(ts) AS last_update
FROM events GROUP BY user_id"""

MEASUREMENTS = """SELECT concat('st:', CAST(user_id AS STRING)) AS station_id, event_id AS seq, ts,
 CAST((event_id*37) % 200 AS DOUBLE)/CAST(10 AS DOUBLE) + CAST(5 AS DOUBLE) + CASE WHEN event_type='error' AND value > 100 THEN CAST(40 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS water_temp,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST((event_id*53) % 300 AS DOUBLE)/CAST(10 AS DOUBLE) END AS air_temp,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(30 AS DOUBLE) + CAST((event_id*11) % 80 AS DOUBLE)/CAST(10 AS DOUBLE) END AS salinity,
 CAST(980 AS DOUBLE) + CAST((event_id*7) % 50 AS DOUBLE) AS pressure,
 CAST((event_id*3) % 40 AS DOUBLE) AS wind_speed, CAST((event_id*5) % 90 AS DOUBLE)/CAST(10 AS DOUBLE) AS wave_height
FROM events"""

ASSETS = """SELECT concat('as:', CAST(s_suppkey AS STRING)) AS id, s_name AS name,
 CASE s_suppkey % 8 WHEN 0 THEN 'power_plant' WHEN 1 THEN 'substation' WHEN 2 THEN 'transformer' WHEN 3 THEN 'renewable_farm' WHEN 4 THEN 'battery_storage' WHEN 5 THEN 'data_center' WHEN 6 THEN 'ai_center' ELSE 'edge_node' END AS type,
 n_name AS country, CAST((s_nationkey % 5)*25 - 50 AS DOUBLE) + CAST((s_suppkey*7) % 40 AS DOUBLE)/CAST(10 AS DOUBLE) AS lat,
 CAST(s_nationkey*14 - 170 AS DOUBLE) + CAST((s_suppkey*11) % 40 AS DOUBLE)/CAST(10 AS DOUBLE) AS lon,
 abs(s_acctbal) AS capacity_mw, s_suppkey % 10 <> 9 AS active
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

DEM = """SELECT CAST(p_partkey % 40 AS INT) AS x, CAST(floor(CAST(p_partkey AS DOUBLE)/CAST(40 AS DOUBLE)) AS INT) AS y,
 CAST((p_partkey*p_partkey + p_partkey*31) % 211 AS DOUBLE) + CAST(p_size AS DOUBLE) AS v FROM part"""

# ground of hills and hollows, wider than a block of cells, and lines drawn over it
RELIEF = """SELECT x, y, CAST(abs(x % 60 - 30) + abs(y % 44 - 22) AS DOUBLE) + CAST((x*7919 + y*104729) % 13 AS DOUBLE)/CAST(2 AS DOUBLE) AS v
FROM (SELECT CAST(o_orderkey % 400 AS INT) AS x, CAST(floor(CAST(o_orderkey AS DOUBLE)/CAST(400 AS DOUBLE)) AS INT) AS y FROM orders) AS o"""

# the same values where x and y are beyond what 32-bit products hold
_WIDE_RELIEF = RELIEF.replace("x*7919 + y*104729", "CAST(x AS BIGINT)*7919 + CAST(y AS BIGINT)*104729")

DRAWN = """SELECT o_custkey % 50 AS line_id, o_orderkey AS seq, CAST((o_orderkey*7919) % 1590 AS DOUBLE)/CAST(4 AS DOUBLE) AS x, CAST((o_orderkey*10473) % 120 AS DOUBLE)/CAST(4 AS DOUBLE) AS y FROM orders WHERE o_orderkey % 5 = 0"""

CONNECTIONS = """SELECT concat('c:', CAST(user_id AS STRING), ':', CAST(event_id % 7 AS STRING)) AS conn_id, concat('proc', CAST(user_id % 12 AS STRING)) AS process,
 concat(CASE event_id % 4 WHEN 0 THEN '10.0.' WHEN 1 THEN '192.168.' ELSE '93.184.' END, CAST(user_id % 200 AS STRING), '.', CAST(event_id % 7 AS STRING)) AS remote_ip,
 CASE WHEN event_type='error' THEN 'TimeWait' ELSE 'Established' END AS state, ts, event_id AS seq,
 CASE WHEN event_type='error' THEN CAST(0 AS DOUBLE) ELSE value END AS latency_ms FROM events"""

# walkers gone missing, and where and when they were seen
CASES = """SELECT c_custkey AS case_id, CAST((c_custkey*7919) % 14000 AS DOUBLE)/CAST(100 AS DOUBLE) - CAST(70 AS DOUBLE) AS lat, CAST((c_custkey*10473) % 36000 AS DOUBLE)/CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
 CAST(c_custkey % 40 AS DOUBLE) AS hours, CAST(c_custkey % 5 + 1 AS INT) AS day, CAST(c_custkey % 45 AS DOUBLE) AS temperature_c, CAST(c_custkey % 31 AS DOUBLE) AS claimed_hours,
 CASE c_custkey % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'normal' ELSE 'fast' END AS pace, CASE c_custkey % 7 WHEN 0 THEN 'light' WHEN 1 THEN 'medium' ELSE 'heavy' END AS pack,
 CASE c_custkey % 4 WHEN 0 THEN 'novice' WHEN 1 THEN 'experienced' ELSE 'expert' END AS experience, CASE c_custkey % 11 WHEN 0 THEN 'clear' WHEN 1 THEN 'cloudy' WHEN 2 THEN 'rain' WHEN 3 THEN 'snow' WHEN 4 THEN 'extreme' ELSE 'clear' END AS weather,
 CASE c_nationkey % 4 WHEN 0 THEN 'morning' WHEN 1 THEN 'midday' WHEN 2 THEN 'afternoon' ELSE 'night' END AS time_of_day, CASE c_nationkey % 3 WHEN 0 THEN 'young' WHEN 1 THEN 'adult' ELSE 'elderly' END AS age_group,
 CASE c_custkey % 5 WHEN 0 THEN 'unfit' WHEN 1 THEN 'average' ELSE 'fit' END AS fitness, CASE c_custkey % 13 WHEN 0 THEN 'precise' WHEN 1 THEN 'approximate' WHEN 2 THEN 'exaggerated' ELSE 'unreliable' END AS perception,
 CASE c_nationkey % 5 WHEN 0 THEN 'gps' WHEN 1 THEN 'compass-map' WHEN 2 THEN 'landmark' ELSE 'none' END AS navigation, CASE c_nationkey % 7 WHEN 0 THEN 'cautious' WHEN 1 THEN 'moderate' WHEN 2 THEN 'aggressive' ELSE 'reckless' END AS tolerance,
 CASE c_custkey % 6 WHEN 0 THEN 'transit' WHEN 1 THEN 'exploration' WHEN 2 THEN 'summit' WHEN 3 THEN 'search' WHEN 4 THEN 'lost' ELSE 'other' END AS goal,
 c_custkey % 4 < 2 AS multi_day, CAST(c_custkey % 6 AS INT) AS planned_days, c_custkey % 8 < 5 AS camping FROM customer"""

ANCHORS = """SELECT o_custkey AS case_id, o_orderkey AS seq, CAST((o_custkey*7919) % 14000 AS DOUBLE)/CAST(100 AS DOUBLE) - CAST(70 AS DOUBLE) + CAST(o_orderkey % 21 - 10 AS DOUBLE)/CAST(100 AS DOUBLE) AS lat,
 CAST((o_custkey*10473) % 36000 AS DOUBLE)/CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) + CAST(o_orderkey % 17 - 8 AS DOUBLE)/CAST(100 AS DOUBLE) AS lon, CAST(o_orderkey % 30 AS DOUBLE)/CAST(2 AS DOUBLE) AS hours, o_orderkey % 4 = 0 AS is_end FROM orders"""

VIEWS = {"features": FEATURES, "stations": STATIONS, "measurements": MEASUREMENTS, "assets": ASSETS, "dem": DEM, "relief": RELIEF, "drawn": DRAWN, "connections": CONNECTIONS, "cases": CASES, "anchors": ANCHORS}
#: Views that Spark reads with wider integers than the oracles' text has.
_SPARK = {"relief": _WIDE_RELIEF}
_TABLES = ("events", "supplier", "nation", "part", "customer", "orders")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables in ``sf_dir``."""
    sql, frames = _SPARK.get(name, VIEWS[name]), {}
    for table in _TABLES:
        for word in (f"FROM {table}", f"JOIN {table}"):
            if word in sql:
                sql = sql.replace(word, f"{word.split()[0]} {{{table}}}")
                frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql, **frames)


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views for an oracle statement, open for more."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
