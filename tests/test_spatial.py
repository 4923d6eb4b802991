import math
import random

from pyspark.sql import functions as F

from sextant.functions import geo
from sextant.operators import grids, selection, spatial


def _km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 12742.0 * math.asin(min(1.0, math.sqrt(h)))


def test_radius_join_at_poles_and_antimeridian(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), rng.uniform(-90, -85)]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -178)])) for i in range(300)]
    rows += [(300, 90.0, 0.0), (301, 0.0, 180.0), (302, 0.0, -180.0), (303, -90.0, 12.0), (304, 10.0, 179.99)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    for km in (80.0, 700.0, 3000.0):
        got = {(r.id, r.r_id) for r in spatial.radius_self_join(df, km).select("id", "r_id").collect()}
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and _km(a, b) <= km}
        assert got == want
        n = spatial.radius_self_join(df, km).count()
        assert n == len(want)  # no pair twice


def test_null_positions_meet_nothing(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.1)], "id long, lat double, lon double")
    assert spatial.radius_self_join(df, 100.0).count() == 2


def test_floor_half_on_negative_halves(spark):
    row = spark.range(1).select(geo.floor_half(F.lit(-2.5)).alias("a"), geo.floor_half(F.lit(2.5)).alias("b")).first()
    assert (row.a, row.b) == (-2, 3)


def test_components_equal_flood_fill(spark):
    rng = random.Random(5)
    cells = {(x, y) for x in range(24) for y in range(24) if rng.random() < 0.55}
    got = {(r.x, r.y): r.component for r in grids.components(spark.createDataFrame(sorted(cells), "x int, y int")).collect()}
    seen = {}
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        if start in seen:
            continue
        todo = [start]
        while todo:
            c = todo.pop()
            if c in cells and c not in seen:
                seen[c] = start[1] * (1 << 31) + start[0]
                todo += [(c[0] + i, c[1] + j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    assert got == seen


def test_where_attr_unknown_operator_and_missing_field(spark):
    df = spark.createDataFrame([("a", 1.0, None, "{\"k\":3}"), ("b", None, 2.0, "{}")], "id string, speed double, heading double, props string")
    assert spatial.where_attr(df, "speed", "like", 1).count() == 2
    assert spatial.where_attr(df, "k", "gt", 1).count() == 1
    assert spatial.where_attr(df, "speed", "lte", 0).count() == 1


def test_deltas_count_once_and_the_last_wins(spark):
    state = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    delta = spark.createDataFrame([("a", 2, 1, "full"), ("a", 3, 2, "full"), ("b", 9, 1, "full"), ("b", 9, 2, "removed"), ("d", 4, 1, "full"), ("d", 4, 1, "full")], "id string, v int, seq int, op string")
    got = sorted((r.id, r.v) for r in spatial.apply_delta(state, delta, order="seq").collect())
    assert got == [("a", 3), ("c", 1), ("d", 4)]


def test_regions_wrap_and_the_first_priority_wins(spark):
    regions = spark.createDataFrame([("all", 5, -180.0, -90.0, 180.0, 90.0), ("pacific", 1, 150.0, -10.0, -90.0, 10.0), ("dot", 0, 10.0, 10.0, 10.0, 10.0)], "region string, priority int, west double, south double, east double, north double")
    points = spark.createDataFrame([("a", 0.0, 170.0), ("b", 0.0, -100.0), ("c", 0.0, 0.0), ("d", 10.0, 10.0), ("e", None, 1.0), ("f", 10.0, 150.0)], "id string, lat double, lon double")
    got = {r.id: r.region for r in spatial.region_of(points, regions).collect()}
    assert got == {"a": "pacific", "b": "pacific", "c": "all", "d": "dot", "e": None, "f": "pacific"}


def test_cooldown_runs_from_the_last_alert(spark):
    rows = spark.createDataFrame([("p", k, k * 20) for k in range(10)] + [("q", 100, 5), ("q", 101, None)], "process string, seq int, s int")
    events = rows.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = sorted((r.process, r.seq) for r in selection.cooldown_alerts(events, "process", 30.0).collect())
    assert got == [("p", 0), ("p", 2), ("p", 4), ("p", 6), ("p", 8), ("q", 100)]
