"""Outlines, divides, streams and profiles against plain walks, with blocks much smaller than the grid."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sextant.operators import grids, lines

SIDE, SMALL = 40, 8
TAIL = ((0, 0), (1, 0), (1, 1), (0, 1))
BEYOND = ((0, -1), (1, 0), (0, 1), (-1, 0))


@pytest.fixture(scope="module")
def surface():
    rng = random.Random(8)
    return {(x, y): 3 * math.sin(x / 4) + 2 * math.cos(y / 5) + 0.05 * x + rng.random() / 3 for x in range(SIDE) for y in range(SIDE) if (x, y) not in {(5, 5), (6, 5), (20, 0)}}


@pytest.fixture(scope="module")
def cells(spark, surface):
    return spark.createDataFrame([(x, y, v) for (x, y), v in surface.items()], "x int, y int, v double")


def test_lists_and_rings_are_ranked(spark):
    rng = random.Random(1)
    names = list(range(300))
    rng.shuffle(names)
    prev, at, want = {}, 0, {}
    for size, ring in ((1, False), (37, False), (64, True), (2, True), (1, True), (5, False), (100, True)):
        own, at = names[at : at + size], at + size
        own = own[own.index(min(own)) :] + own[: own.index(min(own))] if ring else own
        for k, n in enumerate(own):
            prev[n] = own[k - 1] if k or ring else None
            want[n] = (own[0], k, ring)
    got = lines.ranked(spark.createDataFrame(list(prev.items()), "node long, prev long"))
    assert {r.node: (r.head, r.step, r.closed) for r in got.collect()} == want
    assert lines.ranked(spark.createDataFrame([], "node long, prev long")).count() == 0


@pytest.mark.parametrize("diagonal", [False, True])
def test_outlines_enclose_their_cells(spark, surface, cells, diagonal):
    mask = cells.where("v > 0.6").select("x", "y")
    of = grids.components(mask, diagonal, block=SMALL)
    label = {(r.x, r.y): r.component for r in of.collect()}
    rows = lines.zone_outlines(of, block=SMALL).collect()
    rings = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.step):
        rings[r.component, r.ring].append(r)
    areas, crossings = Counter(), defaultdict(Counter)
    for (component, _), own in rings.items():
        corners = [(r.x, r.y) for r in own]
        pairs = list(zip(corners, corners[1:] + corners[:1], strict=True))
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in pairs)
        assert all((a[0] == b[0]) != (b[0] == c[0]) for (a, b), c in zip(pairs, corners[2:] + corners[:2], strict=True))
        assert own[0].sides == sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in pairs)
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs) / 2
        assert area == own[0].area and own[0].hole == (area < 0)
        areas[component] += area
        for a, b in pairs:
            if a[1] == b[1]:
                for x in range(min(a[0], b[0]), max(a[0], b[0])):
                    crossings[component][x, a[1]] += 1
    assert areas == Counter(label.values()) and any(r.hole for r in rows)
    for component in areas:
        for x in range(SIDE):
            inside = False
            for y in range(SIDE + 1):
                inside ^= crossings[component][x, y] % 2 == 1
                assert inside == (label.get((x, y)) == component)


def test_outlines_of_several_grids_and_of_none(spark):
    rows = [(g, x, y, 5) for g in ("a", "b") for x, y in ((0, 0), (1, 0), (1, 1))]
    out = lines.zone_outlines(spark.createDataFrame(rows, "grid_id string, x int, y int, component long")).orderBy("grid_id", "step").collect()
    assert [(r.grid_id, r.x, r.y, r.area) for r in out] == [(g, x, y, 3) for g in ("a", "b") for x, y in ((0, 0), (2, 0), (2, 2), (1, 2), (1, 1), (0, 1))]
    assert lines.zone_outlines(spark.createDataFrame([], "x int, y int, component long")).count() == 0


def _walked(basin):
    """{(lesser, greater): {lines as tuples of corners}} by a plain walk along the sides."""
    sides = defaultdict(list)
    for (x, y), own in basin.items():
        for k, (i, j) in enumerate(BEYOND):
            other = basin.get((x + i, y + j))
            if other is not None and own < other:
                corner = lambda n: (x + TAIL[n % 4][0], y + TAIL[n % 4][1])  # noqa: B023, E731
                sides[own, other].append((corner(k), corner(k + 1), (y, x, k)))
    out = {}
    for pair, own in sides.items():
        starts, ends = defaultdict(list), defaultdict(list)
        for s in own:
            starts[s[0]].append(s)
            ends[s[1]].append(s)
        through = {c for c in starts if len(starts[c]) == len(ends[c]) == 1}
        left, found = set(own), set()
        for s in sorted(own, key=lambda s: (s[0] in through, s[2])):
            if s in left:
                line = [s[0]]
                while s in left:
                    left.remove(s)
                    line.append(s[1])
                    if s[1] in through:
                        (s,) = starts[s[1]]
                found.add(tuple(line))
        out[pair] = found
    return out


def test_divide_lines_equal_a_plain_walk(spark, cells):
    of = grids.basins(grids.flow_direction(cells), block=SMALL)
    basin = {(r.x, r.y): r.basin for r in of.collect()}
    size = Counter(basin.values())
    want = {(pair, line) for pair, found in _walked(basin).items() for line in found if len(line) > 5}
    rows = lines.divide_lines(of, 10.0, block=SMALL).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.step):
        got[(r.basin, r.other), r.line].append(r)
    assert {(pair, tuple((r.x, r.y) for r in own)) for (pair, _), own in got.items()} == want and len(want) > 5
    for (pair, _), own in got.items():
        assert {r.metres for r in own} == {10.0 * (len(own) - 1)} and {r.area for r in own} == {100.0 * (size[pair[0]] + size[pair[1]])}
        assert own[0].closed == ((own[0].x, own[0].y) == (own[-1].x, own[-1].y) and own[0].closed)
    longest = lines.divide_lines(of, 10.0, longest=3, block=SMALL).select("line", "metres").distinct().collect()
    best = sorted(((-own[0].metres, line) for (_, line), own in got.items()))[:3]
    assert sorted((-r.metres, r.line) for r in longest) == best


def test_an_island_basin_has_a_closed_divide(spark):
    basin = {(x, y): 1 if 2 <= x <= 4 and 3 <= y <= 4 else 9 for x in range(9) for y in range(9)}
    rows = lines.divide_lines(spark.createDataFrame([(x, y, b) for (x, y), b in basin.items()], "x long, y long, basin long")).orderBy("step").collect()
    assert all(r.closed for r in rows) and [(r.x, r.y) for r in rows][:4] == [(2, 3), (3, 3), (4, 3), (5, 3)] and len(rows) == 11


def test_stream_lines_equal_a_plain_walk(spark, cells):
    flow = grids.flow_accumulation(grids.flow_direction(cells), block=SMALL)
    rows = lines.stream_lines(flow, 4, 10.0, block=SMALL).collect()
    wet = {(r.x, r.y): r for r in flow.where("cells >= 4").collect()}
    down = {p: (p[0] + grids.STEPS[r.direction][0], p[1] + grids.STEPS[r.direction][1]) for p, r in wet.items() if r.direction >= 0}
    donors = Counter(q for q in down.values() if q in wet)

    def order(p):
        above = [order(q) for q in down if down[q] == p]
        return max(above) + (above.count(max(above)) > 1) if above else 1

    want = {}
    for p in wet:
        if donors[p] != 1:
            step, metres, q = 0, 0.0, p
            while True:
                after = down.get(q)
                ends = after is None or after not in wet or donors[after] != 1
                want[q] = (p[1] * 2**31 + p[0], step, round(metres, 6))
                if ends:
                    parent = after[1] * 2**31 + after[0] if after in wet else None
                    break
                metres += 10.0 * math.dist(q, after)
                step, q = step + 1, after
            for k, v in want.items():
                if v[0] == p[1] * 2**31 + p[0]:
                    want[k] = (*v, order(k), parent)
    assert {(r.x, r.y): (r.path, r.step, round(r.metres, 6), r.strahler, r.parent) for r in rows} == want and max(r.strahler for r in rows) > 1


def test_sampled_lines(spark, surface, cells):
    vertices = [(1, 0, 0.0, 0.0), (1, 1, 7.5, 3.25), (1, 2, 7.5, 3.25), (1, 3, 2.0, 30.0), (2, 0, 3.0, 4.0), (3, 0, 18.0, 0.0), (3, 1, 22.0, 0.0), (4, 0, 90.0, 90.0), (4, 1, 91.0, 90.0), (1, None, 5.0, 5.0)]
    df = lines.sampled_lines(spark.createDataFrame(vertices, "line_id long, seq long, x double, y double"), cells, 25.0, 10.0)
    got = {(r.line_id, r.sample): (r.metres, r.x, r.y, r.v) for r in df.collect()}
    want = {}
    for line in (1, 2, 3, 4):
        own = [v[2:] for v in vertices if v[0] == line and v[1] is not None]
        total = [0.0]
        for a, b in zip(own, own[1:], strict=False):
            total.append(total[-1] + 10.0 * math.dist(a, b))
        metres = [k * 25.0 for k in range(math.ceil(total[-1] / 25.0))] + [total[-1]]
        for k, m in enumerate(metres):
            n = next((n for n in range(len(own) - 1) if total[n] <= m < total[n + 1]), None)
            part = 0 if n is None else (m - total[n]) / (total[n + 1] - total[n])
            x, y = own[-1] if n is None else (own[n][0] + part * (own[n + 1][0] - own[n][0]), own[n][1] + part * (own[n + 1][1] - own[n][1]))
            x, y = round(x, 9), round(y, 9)
            parts = [((1 - abs(x - cx)) * (1 - abs(y - cy)), surface.get((cx, cy))) for cx in {math.floor(x), math.ceil(x)} for cy in {math.floor(y), math.ceil(y)}]
            held = [(w, v) for w, v in parts if w > 0 and v is not None]
            want[line, k] = (m, x, y, sum(w * v for w, v in held) / sum(w for w, _ in held) if held else None)
    assert got.keys() == want.keys()
    for k, (m, x, y, v) in want.items():
        assert got[k][:3] == pytest.approx((m, x, y), abs=1e-6) and (got[k][3] is None if v is None else got[k][3] == pytest.approx(v, abs=1e-6))
    profile = {r.line_id: r for r in lines.line_profiles(df).collect()}
    values = [want[1, k][3] for k in range(len([k for k in want if k[0] == 1]))]
    assert profile[1].ascent == pytest.approx(sum(max(0, b - a) for a, b in zip(values, values[1:], strict=False))) and profile[1].points == len(values)
    assert profile[4].lowest is None and profile[2].length_m == 0 and profile[2].points == 1
    several = lines.sampled_lines(spark.createDataFrame([("a", 1, 0, 0.5, 0.0)], "grid_id string, line_id long, seq long, x double, y double"), cells.withColumn("grid_id", F.lit("a")), 25.0)
    assert [(r.grid_id, round(r.v, 6)) for r in several.collect()] == [("a", round((surface[0, 0] + surface[1, 0]) / 2, 6))]


def test_flow_lengths_equal_a_plain_walk(spark, cells):
    directions = grids.flow_direction(cells)
    step = {(r.x, r.y): r.direction for r in directions.collect()}
    want = dict.fromkeys(step, 0.0)
    for p in step:
        q, length = p, 0.0
        while step[q] >= 0:
            way = grids.STEPS[step[q]]
            q, length = (q[0] + way[0], q[1] + way[1]), length + 10.0 * math.hypot(*way)
            want[q] = max(want[q], length)
    got = {(r.x, r.y): r.length for r in grids.flow_lengths(directions, 10.0, SMALL).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
