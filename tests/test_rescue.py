"""Corridors and routes against plain Python on a small grid; models of cases with nulls and empty tables."""

import math

import numpy as np
import pytest

from sextant.operators import corridors, grids, rescue

SIDE = 30
SIZE = 30.0


@pytest.fixture(scope="module")
def surface():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    z = np.round(500 - 9.0 * y - 2.0 * x + 9 * np.abs(np.sin(x / 2.0)) * 3 + rng.integers(0, 8, (SIDE, SIDE)), 1)
    z[12, 4:7] = np.nan
    return z


@pytest.fixture(scope="module")
def cells(spark, surface):
    rows = [(x, y, float(surface[y, x])) for y in range(SIDE) for x in range(SIDE) if not np.isnan(surface[y, x])]
    return spark.createDataFrame(rows, "x int, y int, v double")


STARTS = [(1, 2, 2), (2, 20, 1), (3, 15, 8), (4, 5, 12), (5, 99, 99)]


@pytest.fixture(scope="module")
def starts(spark):
    return spark.createDataFrame(STARTS, "start_id int, x int, y int")


@pytest.fixture(scope="module")
def made(cells, starts):
    return corridors.downhill_paths(cells, starts)


def at(z, x, y):
    return z[y, x] if 0 <= x < z.shape[1] and 0 <= y < z.shape[0] and not np.isnan(z[y, x]) else None


def walk(z, x, y, most):
    path = [(x, y)]
    while len(path) <= most:
        x, y = path[-1]
        lower = [(at(z, x + i, y + j), -k) for k, (i, j) in enumerate(grids.STEPS) if at(z, x + i, y + j) is not None and at(z, x + i, y + j) < z[y, x]]
        if not lower:
            break
        i, j = grids.STEPS[-min(lower, key=lambda t: (t[0], -t[1]))[1]]
        path.append((x + i, y + j))
    return path


def all_paths(z):
    out = {}
    for s, x, y in STARTS:
        if at(z, x, y) is None:
            continue
        tries = [(-1, x, y, 500, 2)] + [(k, x + i, y + j, 200, 3) for k, (i, j) in enumerate(corridors.SIDES) if at(z, x + i, y + j) is not None and at(z, x + i, y + j) < z[y, x]]
        for k, a, b, most, least in tries:
            path = walk(z, a, b, most)
            if len(path) >= least:
                out[s, k] = path
    return out


def test_downhill_paths(spark, surface, cells, starts, made):
    got = {}
    for r in made.collect():
        got.setdefault((r.start_id, r.branch), {})[r.step] = (r.x, r.y)
    want = all_paths(surface)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want and max(map(len, want.values())) > 8
    short = corridors.downhill_paths(cells, starts, most=5, side_most=3).collect()
    assert max(r.step for r in short if r.branch < 0) == 5 and max(r.step for r in short if r.branch >= 0) == 3
    assert corridors.downhill_paths(cells.limit(0), starts).count() == 0


def test_deposition_zones(spark, surface, cells, made):
    z, paths, found = surface, all_paths(surface), []
    for (s, k), path in sorted(paths.items()):
        every = max(3, len(path) // 20)
        for i in range(every, len(path) - 1, every):
            x, y = path[i]
            around = [(math.hypot(a, b), at(z, x + a, y + b)) for a, b in grids.STEPS if at(z, x + a, y + b) is not None]
            slope = max(math.degrees(math.atan2(abs(v - z[y, x]), d * SIZE)) for d, v in around)
            rough = np.std([z[y, x], *[v for _, v in around]])
            kind = None
            if all(v >= z[y, x] for _, v in around):
                kind, p = "basin", 0.8
            elif slope < 5 and i > len(path) * 0.7:
                kind, p = "fan", 0.9
            elif 5 < slope < 10:
                kind, p = "shelf", 0.6
            elif rough > 15:
                kind, p = "snag", 0.5
            elif any((x - a) ** 2 + (y - b) ** 2 < 9 for (s2, k2), other in paths.items() if s2 == s and k2 != k for a, b in other):
                kind, p = "confluence", 0.7
            if kind:
                found.append((s, -p, k, i, x, y, kind))
    kept = []
    for f in sorted(found):
        if all(g[0] != f[0] or (g[4] - f[4]) ** 2 + (g[5] - f[5]) ** 2 >= 25 for g in kept):
            kept.append(f)
    got = {(r.start_id, -r.priority, r.branch, r.step, r.x, r.y, r.kind) for r in corridors.deposition_zones(cells, made, SIZE, limit=None).collect()}
    assert got == set(kept) and len(kept) > 3


def test_choke_points_and_ends(spark):
    gully = np.array([[400.0 - 5 * y + 8 * abs(x - 10) for x in range(21)] for y in range(40)])
    rows = [(x, y, float(gully[y, x])) for y in range(40) for x in range(21)]
    ground = spark.createDataFrame(rows, "x int, y int, v double")
    made = corridors.downhill_paths(ground, spark.createDataFrame([(1, 10, 0)], "start_id int, x int, y int"))
    path = walk(gully, 10, 0, 500)
    want, i = [], 5
    while i < len(path) - 5:
        (x, y), (px, py), (nx, ny) = path[i], path[i - 1], path[i + 1]
        if 2 <= x <= 18 and 2 <= y <= 37:
            dx, dy = nx - px, ny - py
            long = math.hypot(dx, dy)
            walls = set()
            for s in (-3, -2, -1, 1, 2, 3):
                v = at(gully, math.floor(x - s * dy / long + 0.5), math.floor(y + s * dx / long + 0.5))
                if v is not None and v - gully[y, x] > 5:
                    walls.add(s > 0)
            if len(walls) == 2:
                want.append((i, x, y))
                i += 10
        i += 3
    got = [(r.step, r.x, r.y) for r in corridors.choke_points(ground, made).orderBy("step").collect()]
    assert got == want and len(want) == 3
    end = corridors.terminal_zones(made, SIZE).collect()
    assert [(r.x, r.y, r.radius_m) for r in end] == [(*path[-1], 150.0)]


def test_fall_zones(spark, surface, cells):
    z, steep = surface, {}
    for y in range(0, SIDE, 4):
        for x in range(0, SIDE, 4):
            if at(z, x, y) is None:
                continue
            e, w, s, n = (at(z, x + a, y + b) if at(z, x + a, y + b) is not None else z[y, x] for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
            slope = math.degrees(math.atan(math.hypot((e - w) / SIZE, (s - n) / SIZE)))
            if slope >= 20:
                steep[x, y] = slope
    want, left = set(), set(steep)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            group.add((x, y))
            for p in ((x + 4, y), (x - 4, y), (x, y + 4), (x, y - 4)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        if len(group) >= 3:
            mean = sum(steep[p] for p in group) / len(group)
            want.add((len(group), min(p[0] for p in group), min(p[1] for p in group), round(mean, 6), "high" if mean > 30 else "moderate"))
    got = {(r.cells, r.west, r.north, round(r.slope, 6), r.risk) for r in corridors.fall_zones(cells, SIZE, moderate=20.0, high=30.0).collect()}
    assert got == want and want


def test_routes_cost_what_the_field_says(spark, surface, cells):
    field = grids.cost_distance(cells, spark.createDataFrame([(0, 0), (29, 0)], "x int, y int"), SIZE)
    targets = spark.createDataFrame([("a", 10, 28), ("b", 0, 0), ("c", 5, 12), ("d", 25, 20)], "target_id string, x int, y int")
    rows = {}
    for r in corridors.routes(field, targets, SIZE).collect():
        rows.setdefault(r.target_id, {})[r.step] = r
    assert set(rows) == {"a", "b", "d"}
    for way in rows.values():
        assert (way[0].x, way[0].y) in {(0, 0), (29, 0)} and sorted(way) == list(range(len(way)))
        total = 0.0
        for i in range(1, len(way)):
            a, b = way[i - 1], way[i]
            run = SIZE * math.hypot(a.x - b.x, a.y - b.y)
            assert max(abs(a.x - b.x), abs(a.y - b.y)) == 1
            total += run / (6000 / 3600 * math.exp(-3.5 * abs((b.v - a.v) / run + 0.05)))
        assert total == pytest.approx(way[len(way) - 1].seconds)
    made = {r.target_id: r for r in corridors.route_profile(corridors.routes(field, targets, SIZE), SIZE).collect()}
    first, last = rows["a"][0], rows["a"][len(rows["a"]) - 1]
    assert made["a"].ascent_m - made["a"].descent_m == pytest.approx(last.v - first.v) and made["b"].distance_m == 0


def test_incidents(spark, surface, cells):
    targets = spark.createDataFrame([("a", 10, 28), ("d", 25, 20), ("x", 90, 90)], "target_id string, x int, y int")
    got = {r.target_id: r for r in corridors.incidents(cells, spark.createDataFrame([(0, 0)], "x int, y int"), targets, SIZE, steep=20.0).collect()}
    assert set(got) == {"a", "d"}
    for r in got.values():
        assert r.slope >= 20 and (r.end_x is None or (r.end_x, r.end_y) == walk(surface, r.fall_x, r.fall_y, 500)[-1])


def test_rest_points(spark, surface, cells):
    z, wet, reach, step = surface, [(9, 9), (20, 25)], 0.25 * 3600 * 0.8, 2
    last, found = int(reach // (SIZE * step)), []
    for i in range(-last, last + 1):
        for j in range(-last, last + 1):
            x, y, m = 14 + i * step, 14 + j * step, math.hypot(i, j) * SIZE * step
            if m > reach or at(z, x, y) is None:
                continue
            e, w, s, n = (at(z, x + a, y + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
            slope = max([0.0] + [math.degrees(math.atan2(abs(p - q), 60)) for p, q in ((e, w), (s, n)) if p is not None and q is not None])
            near = [v for v in (e, w, s, n) if v is not None]
            if slope > 25:
                continue
            lee = min(1, max(0, 0.5 + (sum(near) / len(near) - z[y, x]) / 10)) if near else 0.5
            d = min(math.hypot(x - a, y - b) * SIZE for a, b in wet)
            damp = 1.0 if d < 50 else 1 - d / 500 * 0.8 if d <= 500 else 0.0
            far = 0.3 if m < 200 else 0.9
            score = (1 - slope / 25) * 0.3 + damp * 0.18 + lee * 0.12 + far * 0.18 + 0.22
            if (slope < 12.5) + (damp > 0.5) + (lee > 0.55) + (far > 0.6) >= 2:
                found.append((-score, y, x))
    kept = []
    for f in sorted(found):
        if all(math.hypot(f[1] - k[1], f[2] - k[2]) * SIZE >= 150 for k in kept):
            kept.append(f)
    case = spark.createDataFrame([("k", 14, 14)], "case_id string, x int, y int")
    got = corridors.rest_points(cells, case, spark.createDataFrame(wet, "x int, y int"), SIZE, step, hours=0.25, thin_m=150.0).collect()
    assert {(r.y, r.x, round(r.score, 9)) for r in got} == {(k[1], k[2], round(-k[0], 9)) for k in kept} and len(kept) > 3


def test_road_raster(spark):
    segments = spark.createDataFrame([(0.2, [(0.5, 0.5), (6.2, 2.9)]), (0.4, [(3.0, 1.0)]), (1.0, [(0.0, 5.0), (9.0, 5.0)]), (0.5, [(2.0, 2.0), (2.0, 2.0)])], "cost double, points array<struct<x: double, y: double>>")
    got = {(r.x, r.y): round(r.cost, 6) for r in corridors.raster_roads(segments, 8, 8).collect()}
    line = {(k, math.floor(2 * k / 6 + 0.5)) for k in range(7)}
    want = {}
    for c, on in ((0.2, line), (0.5, {(2, 2)})):
        for x, y in on:
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    if 0 <= x + i < 8 and 0 <= y + j < 8:
                        want[x + i, y + j] = min(want.get((x + i, y + j), 9), round(c if i == j == 0 else c + 0.15, 6))
    assert got == want


def test_cases_with_nulls_and_unknown_words(spark):
    schema = "case_id int, hours double, day int, pace string, pack string, experience string, weather string, temperature_c double, time_of_day string, age_group string, fitness string"
    cases = spark.createDataFrame([(1, 12.0, 1, "normal", "medium", "experienced", "clear", 20.0, "midday", "adult", "average"), (2, 12.0, 1, "crawl", "medium", "novice", "clear", 30.0, "midday", "adult", "fit"), (3, *[None] * 10)], schema)
    trips = {r.case_id: r for r in rescue.search_radii(rescue.derive_trip(cases)).collect()}
    assert trips[1].walk_mps == pytest.approx(1.11 * 0.85) and trips[1].risk == "critical" and trips[1].heat_risk == 0
    assert trips[1].radii == [500, 10190, 20380, 40759]
    assert trips[2].walk_mps is None and trips[2].risk is None and trips[3].survival_h is None
    extra = "perception string, navigation string, tolerance string, goal string, claimed_hours double, multi_day boolean, planned_days int, camping boolean"
    profile = spark.createDataFrame([(1, "precise", "gps", "cautious", "transit", 10.0, False, 1, False), (2, "precise", "none", "cautious", "lost", 0.0, True, 3, True)], "case_id int, " + extra)
    anchors = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, False), (1, 2, 0.0, 0.1, 4.0, False), (1, 3, 0.0, 0.2, 5.0, True), (1, 4, None, 0.0, 1.0, False)], "case_id int, seq int, lat double, lon double, hours double, is_end boolean")
    models = rescue.calibrate(rescue.derive_trip(cases).join(profile, "case_id"), anchors)
    got = {r.case_id: r for r in models.collect()}
    fast = 6371000 * math.radians(0.2) / (5 * 3600)
    assert got[1].pace_mps == pytest.approx(fast) and got[1].bearing == pytest.approx(90) and got[1].seen_h == 4
    assert got[2].pace_mps is None and got[2].total_h == 42 and got[2].bearing is None
    assert [r.case_id for r in rescue.search_cone(models).collect()] == [1]
    claims = {r.case_id: (r.verdict, r.credible) for r in rescue.claim_credibility(models, models.case_id * 100000.0).collect()}
    assert claims == {1: ("far too fast", False), 2: ("no claim", True)}
    assert rescue.calibrate(rescue.derive_trip(cases).join(profile, "case_id"), anchors.limit(0)).where("case_id = 1").first().pace_mps == pytest.approx(1.11 * 0.85)
