"""Sound over terrain against published tables, a barrier worked out by hand, and a plain loop."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sextant.operators import acoustics


@pytest.mark.parametrize(("hertz", "published"), [(250, 1.0), (500, 1.9), (1000, 3.7), (2000, 9.7), (4000, 32.8), (8000, 117.0)])
def test_absorption_is_that_of_the_table(hertz, published):
    """ISO 9613-2, table 2: dB a kilometre at 10 degrees and 70 per cent."""
    assert 1000 * acoustics.absorption_db_per_m(hertz) == pytest.approx(published, rel=0.03, abs=0.06)


def test_a_wall_half_way(spark):
    """Source and receiver 10 m up, 600 m apart, a wall of 40 m half way: 30 m above the line."""
    cells = spark.createDataFrame([(x, 0, 40.0 if x == 10 else 0.0) for x in range(21)], "x int, y int, v double")
    sources = spark.createDataFrame([(1, 0, 0, 100.0, 10.0)], "source_id int, x int, y int, power_db double, height_m double")
    (got,) = acoustics.terrain_levels(sources, spark.createDataFrame([(20, 0)], "x int, y int"), cells, 700.0, receiver_m=10.0).collect()
    leg = math.hypot(300.0, 30.0)
    detour = 2 * leg - 600.0
    screen = min(20.0, 10 * math.log10(3 + 20 / (340 / 500) * detour * math.exp(-math.sqrt(leg * leg * 600.0 / (2 * detour)) / 2000)))
    ground = max(0.0, 4.8 - 2 * 10 / 600 * (17 + 300 / 600))
    assert detour == pytest.approx(2.9925, abs=1e-3) and screen == pytest.approx(13.51, abs=0.01)
    assert got.level == pytest.approx(100 - (20 * math.log10(600) + 11) - 600 * acoustics.absorption_db_per_m(500) - ground - max(0, screen - ground), abs=1e-6)


def test_levels_equal_a_plain_loop(spark):
    ground = {(x, y): 6 * math.sin(x / 2) + 4 * math.cos(y / 3) for x in range(30) for y in range(14) if (x, y) != (9, 6)}
    cells = spark.createDataFrame([(x, y, v) for (x, y), v in ground.items()], "x int, y int, v double")
    sources = [(1, 4, 4, 90.0, 2.0, 3.0), (2, 25, 9, 95.0, 1.0, 0.0), (3, 9, 6, 99.0, 1.0, 0.0)]
    receivers = [(x, y) for x in range(0, 30, 3) for y in range(0, 14, 2)] + [(4, 4), (100, 100)]
    df = acoustics.terrain_levels(spark.createDataFrame(sources, "source_id int, x int, y int, power_db double, height_m double, directivity_db double"), spark.createDataFrame(receivers * 2, "x int, y int"), cells, 250.0, hertz=1000.0)
    got = {(r.x, r.y): (round(r.level, 6), r.n) for r in df.collect()}
    energy = defaultdict(list)
    for _, sx, sy, power, up, directed in sources:
        for x, y in set(receivers):
            flat = 30 * math.dist((sx, sy), (x, y))
            if (sx, sy) in ground and (x, y) in ground and 0 < flat <= 250:
                sz, z, n, worst = ground[sx, sy] + up, ground[x, y] + 1.5, min(20, int(flat // 30)), None
                direct = math.hypot(flat, z - sz)
                for k in range(1, n):
                    t = k / n
                    edge = ground.get((math.floor(sx + t * (x - sx) + 0.5), math.floor(sy + t * (y - sy) + 0.5)))
                    if edge is not None:
                        a, b = math.hypot(t * flat, edge - sz), math.hypot((1 - t) * flat, edge - z)
                        own = ((a + b - direct) * (1 if edge >= sz + t * (z - sz) else -1), a, b)
                        worst = own if worst is None else max(worst, own)
                soft, screen = max(0.0, 4.8 - (up + 1.5) / direct * (17 + 300 / direct)), 0.0
                if worst:
                    d, a, b = worst
                    inside = 3 + 20 / 0.34 * d * (math.exp(-math.sqrt(a * b * direct / (2 * d)) / 2000) if d > 0 else 1)
                    screen = max(0.0, (min(20.0, 10 * math.log10(inside)) if inside > 1 else 0.0) - soft)
                energy[x, y].append(power + directed - 20 * math.log10(direct) - 11 - acoustics.absorption_db_per_m(1000.0) * direct - soft - screen)
    assert got == {p: (round(10 * math.log10(sum(10 ** (e / 10) for e in own)), 6), len(own)) for p, own in energy.items()} and len(got) > 20
    assert acoustics.terrain_levels(df.limit(0).select(F.lit(1).alias("source_id"), "x", "y", F.lit(1.0).alias("power_db"), F.lit(1.0).alias("height_m")), cells.select("x", "y"), cells, 100.0).count() == 0
