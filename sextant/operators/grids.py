"""Raster operators on long cell tables (x, y, v; grid_id where a table holds several grids), and vector search.

Neighbourhoods are NumPy on blocks with a halo (``blocks``): one shuffle of the cells, each to a block or a few. What
travels over a grid (components, fills, accumulation, costs) settles inside blocks first, then between them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.physics import kirpich_minutes
from sextant.operators import graph
from sextant.operators.blocks import BLOCK, blockwise, grid_key, labels, meet, settle, shifted, window_sums
from sextant.storage import cut

Arrays = Mapping[str, np.ndarray]
#: The eight directions in the order of D8 codes, E SE S SW W NW N NE; y grows southward.
STEPS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
_INFINITE = float("inf")


def _gradients(z: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether all nine values are there, and Horn's (1981) slopes along x and y."""
    v = {(i, j): shifted(z, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    dx = ((v[1, -1] + 2 * v[1, 0] + v[1, 1]) - (v[-1, -1] + 2 * v[-1, 0] + v[-1, 1])) / (8 * size)
    dy = ((v[-1, 1] + 2 * v[0, 1] + v[1, 1]) - (v[-1, -1] + 2 * v[0, -1] + v[1, -1])) / (8 * size)
    return ~np.isnan(sum(v.values())), dx, dy


def slope_degrees(cells: DataFrame, size: float = 30.0) -> DataFrame:
    """Horn (1981) slope in degrees; 0 where a neighbour is missing."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        whole, dx, dy = _gradients(a["v"], size)
        return {"slope": np.where(whole, np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy))), 0.0)}

    return blockwise(cells, 1, kernel, "slope double")


def hillshade(cells: DataFrame, size: float = 30.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Lambertian shade 0 to 255 of the Horn gradients (y grows southward); 0 where a neighbour is missing."""
    zenith, turn = math.radians(90 - altitude), math.radians(360 - azimuth + 90)

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        whole, dx, dy = _gradients(a["v"], size)
        slope, aspect = np.arctan(np.sqrt(dx * dx + dy * dy)), np.arctan2(dy, -dx)
        shade = 255 * (math.cos(zenith) * np.cos(slope) + math.sin(zenith) * np.sin(slope) * np.cos(turn - aspect))
        return {"shade": np.where(whole, np.maximum(0.0, shade), 0.0)}

    return blockwise(cells, 1, kernel, "shade double")


def box_residual(cells: DataFrame, r: int = 5) -> DataFrame:
    """Each value less the mean of the window of radius r (of the cells there are)."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z = a["v"]
        own, held = z[r:-r, r:-r], ~np.isnan(z)
        n = np.maximum(1, window_sums(held.astype(np.float64), r))
        return {"v": own, "residual": own - window_sums(np.where(held, z, 0.0), r) / n, "held": ~np.isnan(own)}

    return blockwise(cells, r, kernel, "v double, residual double", keep="held")


def anomaly_mask(cells: DataFrame, r: int = 5, k: float = 2.5) -> DataFrame:
    """Cells whose box residual is over k deviations of their grid's residuals; none where the deviation is below 0.1."""
    res, key = box_residual(cells, r), grid_key(cells)
    sd = res.groupBy(*key).agg(F.stddev_pop("residual").alias("sd")).where("sd >= 0.1")
    met = res.join(sd, key) if key else res.crossJoin(F.broadcast(sd))
    return met.where(F.abs("residual") > k * F.col("sd")).drop("sd")


def roughness(cells: DataFrame, r: int = 1) -> DataFrame:
    """Population deviation of the window of radius r, where it holds four values or more."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z = a["v"]
        held = ~np.isnan(z)
        z = np.where(held, z - (z[held].mean() if held.any() else 0.0), 0.0)  # about the block's mean, to keep digits
        n, total, squares = window_sums(held.astype(np.float64), r), window_sums(z, r), window_sums(z * z, r)
        n1 = np.maximum(n, 1)
        return {"roughness": np.sqrt(np.maximum(0.0, squares / n1 - (total / n1) ** 2)), "enough": n >= 4}

    return blockwise(cells, r, kernel, "roughness double", keep="enough")


def canopy_height(cells: DataFrame, r: int = 2, factor: float = 1.5, most: float = 40.0) -> DataFrame:
    """Height of cover guessed from the roughness of a surface model: ``factor`` times it, at most ``most`` metres."""
    rough = roughness(cells, r)
    return rough.select(*grid_key(cells), "x", "y", F.least(F.lit(most), factor * F.col("roughness")).alias("height"))


def flow_direction(cells: DataFrame) -> DataFrame:
    """D8: the neighbour of steepest drop (diagonals over root 2) among E SE S SW W NW N NE, the first of equals; -1 in a pit."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z = a["v"]
        drops = np.stack([(shifted(z, 0, 0) - shifted(z, i, j)) / (math.sqrt(2) if i and j else 1.0) for i, j in STEPS])
        drops = np.where(np.isnan(drops), -_INFINITE, drops)
        return {"direction": np.where(drops.max(axis=0) > 0, drops.argmax(axis=0), -1).astype(np.int32)}

    return blockwise(cells, 1, kernel, "direction int")


def band_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum isn't positive."""
    return F.when(a + b > 0, (a - b) / (a + b)).otherwise(0.0)


def components(mask: DataFrame, diagonal: bool = False, class_column: str | None = None, block: int = BLOCK) -> DataFrame:
    """(x, y, component) of connected cells: 4-connected, or 8-connected if ``diagonal``; of one class only, if a column of
    classes (numbers) is named. A component is named by its least y * 2^31 + x.

    Blocks label their own cells in one pass; then only cells at the borders of blocks meet, as edges between labels.
    """
    key = grid_key(mask)
    named = mask.withColumn("_c", F.col(class_column).cast("double") if class_column else F.lit(0.0)).withColumn("_x", F.col("x").cast("double")).withColumn("_y", F.col("y").cast("double"))
    named = named.withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")})

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        at = labels(there, a["_c"], diagonal)
        least = np.where(at >= 0, at, 0).reshape(-1)
        code = (np.nan_to_num(a["_y"]).astype(np.int64) * (1 << 31) + np.nan_to_num(a["_x"]).astype(np.int64)).reshape(-1)
        return {"label": code[least].reshape(at.shape), "class": np.nan_to_num(a["_c"])}

    local = blockwise(named, 0, kernel, "label long, class double", ("_c", "_x", "_y"), block=block)
    local = cut(local, "labels")
    side = lambda c: F.pmod(F.col(c), F.lit(block))
    border = local.where((side("x") == 0) | (side("x") == block - 1) | (side("y") == 0) | (side("y") == block - 1))
    ways = [(1, 0), (0, 1), *(((1, 1), (-1, 1)) if diagonal else ())]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ways])).alias("s")
    sent = border.select(*key, "x", "y", "label", "class", step).select(*key, (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), F.col("label").alias("_from"), F.col("class").alias("_class"))
    met = meet(border, sent, [*key, "x", "y"]).where((F.col("_class") == F.col("class")) & (F.col("_from") != F.col("label")))
    if not key:
        merged = graph.components(met.select(F.col("label").alias("u"), F.col("_from").alias("v"))).select(F.col("node").alias("label"), F.col("label").alias("group"))
        return meet(local, merged, ["label"], "left").select("x", "y", F.coalesce("group", "label").alias("component"))
    # labels of several grids: nodes are numbered by grid and label
    node = lambda c: F.xxhash64(*key, F.col(c))
    merged = graph.components(met.select(node("label").alias("u"), node("_from").alias("v")))
    joined = local.join(merged.select("node", F.col("label").alias("group")), node("label") == F.col("node"), "left").withColumn("group", F.coalesce("group", node("label")))
    least = joined.groupBy(*key, "group").agg(F.min("label").alias("component"))
    return joined.join(least, [*key, "group"]).select(*key, "x", "y", "component")


def zones(components_of: DataFrame, values: DataFrame, least: int = 3) -> DataFrame:
    """Box, cells and mean value of each component of at least ``least`` cells, grid by grid where there are several."""
    key = grid_key(components_of)
    met = meet(components_of, values.select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "v"), [*key, "x", "y"])
    out = met.groupBy(*key, "component").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("v").alias("mean"))
    return out.where(F.col("n") >= least)


def fill_depressions(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """x, y, v and filled: the least surface above v from which water leaves the grid (Barnes et al. 2014).

    Water leaves at cells that lack a neighbour. Inside a block the lowest known level spreads first; what lies beyond the
    block counts with its level of the round before, and rounds end when no block lowers a level.
    """

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z, known = a["v"], a["filled"]
        held = ~np.isnan(z)
        h, w = z.shape
        level = np.full(z.shape, _INFINITE)
        rim = np.ones(z.shape, bool)
        rim[1:-1, 1:-1] = ~np.logical_and.reduce([shifted(held, i, j) for i, j in STEPS])
        heap = []
        for i, j in zip(*np.nonzero(held & rim), strict=True):
            inside = 0 < i < h - 1 and 0 < j < w - 1
            start = z[i, j] if inside else known[i, j]
            if start < _INFINITE:
                level[i, j] = start
                heap.append((start, int(i), int(j)))
        heapq.heapify(heap)
        while heap:
            at, i, j = heapq.heappop(heap)
            if at > level[i, j]:
                continue
            for dx, dy in STEPS:
                y, x = i + dy, j + dx
                if 0 < y < h - 1 and 0 < x < w - 1 and held[y, x]:
                    next_level = max(at, z[y, x])
                    if next_level < level[y, x]:
                        level[y, x] = next_level
                        heapq.heappush(heap, (next_level, y, x))
        inner = level[1:-1, 1:-1]
        return {"filled": inner, "moved": held[1:-1, 1:-1] & (inner < known[1:-1, 1:-1])}

    return settle(cells.where("v IS NOT NULL").withColumn("filled", F.lit(_INFINITE)), kernel, ["filled"], ["v"], block)


def _follow(direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row by row, with the halo) of the cells that flow on, and of those that they flow to."""
    h, w = direction.shape
    place = np.arange(h * w).reshape(h, w)
    ok = direction >= 0
    code = np.where(ok, direction, 0).astype(int)
    dx, dy = np.array([s[0] for s in STEPS])[code], np.array([s[1] for s in STEPS])[code]
    y, x = np.mgrid[0:h, 0:w]
    ok &= (y + dy >= 0) & (y + dy < h) & (x + dx >= 0) & (x + dx < w)
    return place[ok], (place + dy * w + dx)[ok]


def _core(shape: tuple[int, int]) -> np.ndarray:
    core = np.zeros(shape, bool)
    core[1:-1, 1:-1] = True
    return core.reshape(-1)


def flow_accumulation(directions: DataFrame, block: int = BLOCK) -> DataFrame:
    """x, y, direction and cells: how many cells drain through each, itself included.

    Inside a block sums go down from the cells without donors; flow from beyond comes in with its sum of the round before.
    """

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        d, before = a["direction"], np.nan_to_num(a["cells"]).reshape(-1)
        core = _core(d.shape)
        source, target = _follow(np.where(there, d, -1))
        total = np.where(core & there.reshape(-1), 1.0, 0.0)
        outside = ~core[source] & core[target]
        np.add.at(total, target[outside], before[source[outside]])
        inside = core[source] & core[target]
        source, target = source[inside], target[inside]
        to = np.full(len(total), -1)
        to[source] = target
        waiting = np.bincount(target, minlength=len(total))
        ready = source[waiting[source] == 0]
        while len(ready):
            np.add.at(total, to[ready], total[ready])
            np.subtract.at(waiting, to[ready], 1)
            ready = np.unique(to[ready])
            ready = ready[(waiting[ready] == 0) & (to[ready] >= 0)]
        inner = total.reshape(d.shape)[1:-1, 1:-1]
        return {"cells": inner, "moved": there[1:-1, 1:-1] & (inner != a["cells"][1:-1, 1:-1])}

    start = directions.withColumn("direction", F.col("direction").cast("double")).withColumn("cells", F.lit(0.0))
    out = settle(start, kernel, ["cells"], ["direction"], block)
    return out.withColumn("direction", F.col("direction").cast("int")).withColumn("cells", F.col("cells").cast("long"))


def flow_lengths(directions: DataFrame, size: float = 30.0, block: int = BLOCK) -> DataFrame:
    """x, y and length: metres along the flow from the farthest cell that drains through each, 0 where none does.

    As ``flow_accumulation``, with the greatest of the donors' lengths and ways in place of their sum.
    """
    ways = np.array([math.hypot(*s) for s in STEPS]) * size

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        d, before = np.where(there, a["direction"], -1), a["length"].reshape(-1)
        core = _core(d.shape)
        source, target = _follow(d)
        real = there.reshape(-1)[source] & core[target]
        source, target = source[real], target[real]
        way = np.zeros(d.size)
        way[source] = ways[d.reshape(-1)[source].astype(int)]
        far = np.zeros(d.size)
        outside = ~core[source]
        np.maximum.at(far, target[outside], before[source[outside]] + way[source[outside]])
        source, target = source[~outside], target[~outside]
        to = np.full(d.size, -1)
        to[source] = target
        waiting = np.bincount(target, minlength=d.size)
        ready = source[waiting[source] == 0]
        while len(ready):
            np.maximum.at(far, to[ready], far[ready] + way[ready])
            np.subtract.at(waiting, to[ready], 1)
            ready = np.unique(to[ready])
            ready = ready[(waiting[ready] == 0) & (to[ready] >= 0)]
        inner = far.reshape(d.shape)[1:-1, 1:-1]
        return {"length": inner, "moved": there[1:-1, 1:-1] & (inner != a["length"][1:-1, 1:-1])}

    start = directions.withColumn("direction", F.col("direction").cast("double")).withColumn("length", F.lit(0.0))
    return settle(start, kernel, ["length"], ["direction"], block).drop("direction")


def streams(accumulated: DataFrame, least_cells: int, block: int = BLOCK) -> DataFrame:
    """The cells that drain ``least_cells`` or more, with ``head`` (no donor among them) and their Strahler order.

    A cell has its donors' largest order, one more if two or more donors have it, and 1 at a head.
    """
    chosen = accumulated.where(F.col("cells") >= least_cells)

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        d, before = a["direction"], np.nan_to_num(a["order"]).reshape(-1)
        core, there_ = _core(d.shape), there.reshape(-1)
        source, target = _follow(np.where(there, d, -1))
        real = there_[source] & there_[target] & core[target]
        source, target = source[real], target[real]
        best, count, donors = np.zeros(len(there_)), np.zeros(len(there_)), np.bincount(target, minlength=len(there_))

        def give(s: np.ndarray, t: np.ndarray, order: np.ndarray) -> None:
            for at, to, o in zip(s.tolist(), t.tolist(), order.tolist(), strict=True):
                if o > best[to]:
                    best[to], count[to] = o, 1
                elif o == best[to] and o > 0:
                    count[to] += 1

        outside = ~core[source]
        give(source[outside], target[outside], before[source[outside]])
        source, target = source[~outside], target[~outside]
        to = np.full(len(there_), -1)
        to[source] = target
        waiting = np.bincount(target, minlength=len(there_))
        ready = np.flatnonzero(core & there_ & (waiting == 0))
        order = np.zeros(len(there_))
        while len(ready):
            order[ready] = np.where(donors[ready] == 0, 1, best[ready] + (count[ready] >= 2))
            flows = ready[to[ready] >= 0]
            give(flows, to[flows], order[flows])
            np.subtract.at(waiting, to[flows], 1)
            ready = np.unique(to[flows])
            ready = ready[waiting[ready] == 0]
        inner = order.reshape(d.shape)[1:-1, 1:-1]
        return {"order": inner, "head": (donors == 0).reshape(d.shape)[1:-1, 1:-1].astype(float), "moved": there[1:-1, 1:-1] & (inner != a["order"][1:-1, 1:-1])}

    start = chosen.withColumn("order", F.lit(0.0)).withColumn("head", F.lit(0.0)).withColumn("direction", F.col("direction").cast("double")).withColumn("cells", F.col("cells").cast("double"))
    out = settle(start, kernel, ["order", "head"], ["direction", "cells"], block)
    return out.select(*grid_key(accumulated), "x", "y", F.col("cells").cast("long").alias("cells"), (F.col("head") > 0).alias("head"), F.col("order").cast("int").alias("strahler"))


def flood_risk(streams_of: DataFrame, slopes: DataFrame, runoff_m: float, size: float = 30.0, full_flow: float = 200.0, full_slope: float = 0.5, least: float = 0.15) -> DataFrame:
    """Stream cells with discharge (cubic metres a second: drained area times runoff over Kirpich's (1940) time of
    concentration, at least 60 s, for a path as long as the column ``length`` says, or where there is none as the area's side) and
    risk, half by discharge and half by slope (rise over run), each up to its full value; cells of a risk of at least
    ``least``, with what weighs more, and with ``length`` where there is one."""
    key = grid_key(streams_of)
    length = ["length"] if "length" in streams_of.columns else []
    met = meet(streams_of, slopes.select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.tan(F.radians("slope")).alias("gradient")), [*key, "x", "y"])
    area = F.col("cells") * (size * size)
    seconds = F.greatest(F.lit(60.0), 60 * kirpich_minutes(F.col("length") if length else F.sqrt(area), F.col("gradient")))
    out = met.withColumn("discharge", area * runoff_m / seconds)
    by_flow, by_slope = F.least(F.lit(1.0), F.col("discharge") / full_flow), F.least(F.lit(1.0), F.col("gradient") / full_slope)
    out = out.withColumn("risk", 0.5 * by_flow + 0.5 * by_slope).withColumn("reason", F.when(by_flow >= by_slope, "flow").otherwise("slope"))
    return out.where(F.col("risk") >= least).select(*key, "x", "y", "cells", *length, "discharge", "risk", "reason")


def class_zones(cells: DataFrame, classes: DataFrame, least: int = 3, limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """Connected zones of one class, with ``limit`` the largest (classes: x, y, class as a number; cells: x, y, v): component,
    class, cells, mean value and box; the larger first, then the component."""
    key = grid_key(classes)
    long = lambda c: F.col(c).cast("long").alias(c)
    placed = meet(meet(components(classes, class_column="class", block=block), classes.select(*key, long("x"), long("y"), "class"), [*key, "x", "y"]), cells.select(*key, long("x"), long("y"), "v"), [*key, "x", "y"])
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    out = placed.groupBy(*key, "component").agg(F.first("class").alias("class"), F.count("*").alias("n"), F.avg("v").alias("mean"), *box)
    out = out.where(F.col("n") >= least)
    return out if limit is None else out.orderBy(F.desc("n"), *key, "component").limit(limit)


def basins(directions: DataFrame, block: int = BLOCK) -> DataFrame:
    """x, y and basin: the cell (y * 2^31 + x) that each cell's water ends in. Paths inside a block are followed by jumping
    to a path's path, and between blocks round by round."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        d = np.where(there, a["direction"], -1)
        core, before = _core(d.shape), a["basin"].reshape(-1)
        source, target = _follow(d)
        real = core[source] & there.reshape(-1)[target]
        to = np.arange(d.size)
        to[source[real]] = target[real]
        to[~core] = np.flatnonzero(~core)
        while not np.array_equal(further := to[to], to):
            to = further
        inner = before[to].reshape(d.shape)[1:-1, 1:-1]
        return {"basin": inner, "moved": there[1:-1, 1:-1] & (inner != a["basin"][1:-1, 1:-1])}

    # names stay below 2^53, so doubles hold them
    start = directions.select(*grid_key(directions), "x", "y", F.col("direction").cast("double").alias("direction"), (F.col("y").cast("double") * (1 << 31) + F.col("x")).alias("basin"))
    return settle(start, kernel, ["basin"], ["direction"], block).withColumn("basin", F.col("basin").cast("long")).drop("direction")


def divides(of_basins: DataFrame) -> DataFrame:
    """Cells beside another basin (4-connected): x, y, basin, other; a cell comes once for each basin that it touches."""
    key = grid_key(of_basins)
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")
    sent = of_basins.select(*key, "x", "y", F.col("basin").alias("other"), step).select(*key, (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), "other")
    return meet(of_basins, sent, [*key, "x", "y"]).where("basin <> other").select(*key, "x", "y", "basin", "other").distinct()


def pools(filled: DataFrame, least: int = 3, least_volume: float = 0.5, cell_area: float = 900.0, block: int = BLOCK) -> DataFrame:
    """Standing water where the filled surface lies above v: component (8-connected), cells, deepest, volume and box, for
    pools of at least ``least`` cells and ``least_volume``."""
    key = grid_key(filled)
    wet = filled.where("filled > v")
    met = meet(components(wet.select(*key, "x", "y"), diagonal=True, block=block), wet.select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), (F.col("filled") - F.col("v")).alias("depth")), [*key, "x", "y"])
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    out = met.groupBy(*key, "component").agg(F.count("*").alias("cells"), F.max("depth").alias("deepest"), (F.sum("depth") * cell_area).alias("volume"), *box)
    return out.where((F.col("cells") >= least) & (F.col("volume") >= least_volume))


def cost_distance(cells: DataFrame, sources: DataFrame, size: float = 30.0, block: int = BLOCK) -> DataFrame:
    """x, y, v and seconds: the least walking time from any of ``sources`` (x, y), by Tobler's (1993) hiking function over
    8-connected steps, times the mean ``factor`` of the two cells if the table has that column; infinite if out of reach.

    Costs spread inside a block from the nearest cell on (Dijkstra 1959), and into other blocks round by round.
    """
    key = grid_key(cells)
    factor = F.col("factor").cast("double") if "factor" in cells.columns else F.lit(1.0)
    marked = sources.select(*[c for c in key if c in sources.columns], F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct().withColumn("_zero", F.lit(0.0))
    start = cells.where("v IS NOT NULL").withColumn("factor", factor).join(marked, [c for c in marked.columns if c != "_zero"], "left").withColumn("seconds", F.coalesce("_zero", F.lit(_INFINITE))).drop("_zero")

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z, slow, known = a["v"], a["factor"], a["seconds"]
        h, w = z.shape
        best = np.where(there, known, _INFINITE)
        heap = [(best[i, j], int(i), int(j)) for i, j in zip(*np.nonzero(best < _INFINITE), strict=True)]
        heapq.heapify(heap)
        while heap:
            at, i, j = heapq.heappop(heap)
            if at > best[i, j]:
                continue
            for dx, dy in STEPS:
                y, x = i + dy, j + dx
                if 0 < y < h - 1 and 0 < x < w - 1 and there[y, x]:
                    run = size * (math.sqrt(2) if dx and dy else 1.0)
                    speed = 6000 / 3600 * math.exp(-3.5 * abs((z[y, x] - z[i, j]) / run + 0.05))
                    cost = at + run / speed * (slow[i, j] + slow[y, x]) / 2
                    if cost < best[y, x]:
                        best[y, x] = cost
                        heapq.heappush(heap, (cost, y, x))
        inner = best[1:-1, 1:-1]
        return {"seconds": inner, "moved": there[1:-1, 1:-1] & (inner < known[1:-1, 1:-1])}

    return settle(start, kernel, ["seconds"], ["v", "factor"], block).drop("factor")


def similar(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """The k rows of the largest cosine for each query vector (vec_id, embedding), itself left out, ties (to nine decimals)
    by vec_id. Null vectors, and those of another length than a block's first query, have no part.

    Queries and rows are dealt into blocks of a bounded size; each pair of blocks is a matrix product that keeps k rows a
    query, and only those meet.
    """
    parts = max(1, math.ceil(vectors.count() / block))
    chunks = max(1, math.ceil(queries.count() / query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    held = vectors.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.lit(False).alias("asks"), mine(parts).alias("part"), each(chunks).alias("chunk"))
    asked = queries.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.lit(True).alias("asks"), each(parts).alias("part"), mine(chunks).alias("chunk"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        q, rows = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(rows):
            return none
        width = len(q["e"].iloc[0])
        q, rows = q[q["e"].map(len) == width], rows[rows["e"].map(len) == width]
        if not len(rows):
            return none
        a, b = np.stack(q["e"].to_list()), np.stack(rows["e"].to_list())
        near = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        near, ids = np.round(near, 9), rows["vec_id"].to_numpy()
        out = []
        for name, s in zip(q["vec_id"], near, strict=True):
            first = np.lexsort((ids, -s))
            first = first[(ids[first] != name) & ~np.isnan(s[first])][:k]
            out.append(pd.DataFrame({"query_id": name, "vec_id": ids[first], "score": s[first]}))
        return pd.concat(out)

    found = held.union(asked).groupBy("part", "chunk").applyInPandas(score, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
