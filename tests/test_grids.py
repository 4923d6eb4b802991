"""Block kernels against NumPy and plain Python on whole small grids, with blocks far smaller than the grid."""

import heapq
import math

import numpy as np
import pytest

from sextant.operators import grids

SIDE = 40


@pytest.fixture(scope="module")
def surface():
    rng = np.random.default_rng(1)
    z = rng.integers(0, 60, (SIDE, SIDE)).astype(float)
    z[5:9, 20:23] = np.nan
    return z


def cells(spark, z, grid=None):
    rows = [(int(x), int(y), float(z[y, x])) for y in range(z.shape[0]) for x in range(z.shape[1]) if not np.isnan(z[y, x])]
    return spark.createDataFrame(rows, "x int, y int, v double")


def as_array(df, column, shape, missing=np.nan):
    out = np.full(shape, missing)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def neighbours(z, y, x):
    for k, (i, j) in enumerate(grids.STEPS):
        if 0 <= y + j < z.shape[0] and 0 <= x + i < z.shape[1] and not np.isnan(z[y + j, x + i]):
            yield k, y + j, x + i, math.sqrt(2) if i and j else 1.0


def test_fill_equals_priority_flood(spark, surface):
    z = surface
    level = np.full(z.shape, np.inf)
    heap = [(z[y, x], y, x) for y in range(SIDE) for x in range(SIDE) if not np.isnan(z[y, x]) and len(list(neighbours(z, y, x))) < 8]
    for v, y, x in heap:
        level[y, x] = v
    heapq.heapify(heap)
    while heap:
        at, y, x = heapq.heappop(heap)
        for _, b, a, _ in neighbours(z, y, x):
            if max(at, z[b, a]) < level[b, a]:
                level[b, a] = max(at, z[b, a])
                heapq.heappush(heap, (level[b, a], b, a))
    got = as_array(grids.fill_depressions(cells(spark, z), block=8), "filled", z.shape, np.inf)
    assert np.array_equal(got, level)


def test_directions_accumulation_and_order(spark, surface):
    z = surface
    directions = grids.flow_direction(cells(spark, z))
    to = {}
    for r in directions.collect():
        drops = [((z[r.y, r.x] - z[b, a]) / d, -k, b, a) for k, b, a, d in neighbours(z, r.y, r.x)]
        best = max((d for d in drops if d[0] > 0), default=None)
        assert r.direction == (-best[1] if best else -1)
        if best:
            to[r.y, r.x] = best[2:]
    n = np.zeros(z.shape)
    for y in range(SIDE):
        for x in range(SIDE):
            at = (y, x) if not np.isnan(z[y, x]) else None
            while at:
                n[at] += 1
                at = to.get(at)
    out = grids.flow_accumulation(directions, block=8)
    assert np.array_equal(as_array(out, "cells", z.shape, 0), n)
    stream = {(int(y), int(x)) for y, x in zip(*np.nonzero(n >= 4), strict=True)}
    order = {}
    for at in sorted(stream, key=lambda p: n[p]):
        donors = [order[p] for p in stream if to.get(p) == at]
        order[at] = 1 if not donors else max(donors) + (donors.count(max(donors)) >= 2)
    got = {(r.y, r.x): r for r in grids.streams(out, 4, block=8).collect()}
    assert {p: r.strahler for p, r in got.items()} == order
    assert {p for p, r in got.items() if r.head} == {p for p in stream if not any(to.get(q) == p for q in stream)}


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_equal_flood_fill(spark, surface, diagonal):
    mask = surface >= 28
    steps = grids.STEPS if diagonal else [(1, 0), (0, 1), (-1, 0), (0, -1)]
    want = np.full(mask.shape, -1, np.int64)
    for y in range(SIDE):
        for x in range(SIDE):
            if mask[y, x] and want[y, x] < 0:
                todo = [(y, x)]
                want[y, x] = y * (1 << 31) + x
                while todo:
                    b, a = todo.pop()
                    for i, j in steps:
                        if 0 <= b + j < SIDE and 0 <= a + i < SIDE and mask[b + j, a + i] and want[b + j, a + i] < 0:
                            want[b + j, a + i] = y * (1 << 31) + x
                            todo.append((b + j, a + i))
    df = cells(spark, np.where(mask, surface, np.nan))
    got = as_array(grids.components(df, diagonal, block=8), "component", mask.shape, -1)
    assert np.array_equal(got, want)
    two = df.withColumn("grid_id", df.x * 0 + 1).union(df.withColumn("grid_id", df.x * 0 + 2))
    rows = grids.components(two, diagonal, block=8).collect()
    assert len(rows) == 2 * mask.sum() and all(want[r.y, r.x] == r.component for r in rows)


def test_components_of_classes(spark):
    z = np.array([[1.0, 1, 2], [2, 1, 2], [1, 2, 2]])
    got = as_array(grids.components(cells(spark, z), class_column="v", block=2), "component", z.shape, -1)
    assert len(np.unique(got)) == 4 and got[0, 2] == got[2, 1] and got[2, 0] != got[0, 0]


def test_cost_distance_equals_dijkstra(spark, surface):
    z = surface
    best = np.full(z.shape, np.inf)
    heap = [(0.0, 0, 0), (0.0, 30, 33)]
    for c, y, x in heap:
        best[y, x] = c
    while heap:
        c, y, x = heapq.heappop(heap)
        for _, b, a, d in neighbours(z, y, x):
            run = 30.0 * d
            cost = c + run / (6000 / 3600 * math.exp(-3.5 * abs((z[b, a] - z[y, x]) / run + 0.05)))
            if cost < best[b, a]:
                best[b, a] = cost
                heapq.heappush(heap, (cost, b, a))
    sources = spark.createDataFrame([(0, 0), (33, 30)], "x int, y int")
    got = as_array(grids.cost_distance(cells(spark, z), sources, block=8), "seconds", z.shape, np.inf)
    assert np.allclose(got, best)


def test_windows_cross_blocks(spark, surface):
    z, r = surface, 5
    df = cells(spark, z)
    got = as_array(grids.box_residual(df, r), "residual", z.shape)
    small = as_array(grids.blockwise(df, 1, lambda a, there: {"s": np.nansum([grids.shifted(a["v"], i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)}, "s double", block=8), "s", z.shape)
    for y in range(SIDE):
        for x in range(SIDE):
            if not np.isnan(z[y, x]):
                window = z[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
                assert abs(got[y, x] - (z[y, x] - np.nanmean(window))) < 1e-9
                assert abs(small[y, x] - np.nansum(z[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2])) < 1e-9
    assert grids.slope_degrees(df.limit(0)).count() == 0
