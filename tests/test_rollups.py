import math
import random

from sextant.operators import rollups


def _km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 12742.0 * math.asin(min(1.0, math.sqrt(h)))


def test_thinning_equals_going_in_order(spark):
    rng = random.Random(3)
    rows = [(f"p{i:03d}", rng.uniform(-3, 3), rng.uniform(-3, 3), float(rng.randrange(6))) for i in range(150)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(_km(r, k) > 90 for k in kept):
            kept.append(r)
    got = rollups.thin(spark.createDataFrame(rows, "id string, lat double, lon double, score double"), 90.0)
    assert {r.id for r in got.collect()} == {k[0] for k in kept}


def test_hulls(spark):
    rows = [("a", float(x), float(y)) for x in range(5) for y in range(5)] + [("b", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 0.0, 0.0), ("c", 2.0, 2.0)]
    got = {}
    for r in rollups.hulls(spark.createDataFrame(rows, "k string, x double, y double"), "k").collect():
        got.setdefault(r.k, {})[r.corner] = (r.x, r.y)
    assert set(got["a"].values()) == {(0, 0), (4, 0), (4, 4), (0, 4)} and len(got["a"]) == 4
    assert list(got["b"].values()) == [(1, 1)] and len(got["c"]) == 2


def test_thinning_of_a_long_chain(spark):
    rows = [(f"p{i:03d}", 0.0, i * 0.5, float(i)) for i in range(70)]
    got = rollups.thin(spark.createDataFrame(rows, "id string, lat double, lon double, score double"), 60.0)
    assert {r.id for r in got.collect()} == {f"p{i:03d}" for i in range(69, -1, -2)}


def test_hulls_of_real_coordinates_equal_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(200)]
    rows = [("a", *p) for p in points] + [("a", None, 1.0), (None, 0.5, 0.5)]
    got = {(r.x, r.y) for r in rollups.hulls(spark.createDataFrame(rows, "k string, x double, y double"), "k").where("k = 'a'").collect()}

    def corner(p):
        angles = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for q in points if q != p)
        return any((b - a) > math.pi for a, b in zip(angles, [*angles[1:], angles[0] + 2 * math.pi]))

    assert got == {p for p in points if corner(p)}


def test_weather_codes():
    assert len(rollups.WEATHER_CODES) == 28 and rollups.WEATHER_CODES[99].startswith("thunderstorm")
