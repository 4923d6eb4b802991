"""Paths over a raster (x, y, v; y grows southward): downhill corridors, walked routes, and what lies along them.

Paths are rows (their ids, step, x, y), made for all starting points at once by doubling: the table of pointers says where a
cell leads after 1, 2, 4 ... steps, and rows known up to step n give those up to 2n by one join. So a path of a thousand
steps takes ten rounds, whatever the number of paths. Distances between cells are in cells unless in metres by name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators import grids, rollups
from sextant.operators.blocks import blockwise, grid_key, shifted
from sextant.storage import cut, discard

Arrays = Mapping[str, np.ndarray]
#: The order of side branches, E W S N SE NE SW NW.
SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))
#: What each factor of a resting place weighs, from which value it counts as strong and is named, and its name;
#: every place has REST_BASE besides.
REST_FACTORS = {"flat": (0.3, 0.5, 0.5), "water": (0.18, 0.5, 0.4), "sheltered": (0.12, 0.55, 0.55), "interval": (0.18, 0.6, 0.6)}
REST_BASE, REST_LEAST = 0.22, 0.25
_INFINITE = float("inf")


def _whole(rows: DataFrame, *others: str) -> list[Column]:
    return [*[F.col(c) for c in others], F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")]


def _pointers(directions: DataFrame, key: Sequence[str]) -> DataFrame:
    """(x, y, to_x, to_y) of directions by number, of the cells that lead on."""
    to = lambda c, k: (F.col(c) + F.get(F.array(*[F.lit(s[k]) for s in grids.STEPS]), F.col("direction"))).alias(f"to_{c}")
    return directions.where("direction >= 0").select(*key, "x", "y", to("x", 0), to("y", 1))


def steepest(cells: DataFrame) -> DataFrame:
    """(x, y, to_x, to_y): the neighbour that lies deepest below a cell, the first of E SE S SW W NW N NE; pits lead nowhere."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        drops = np.stack([shifted(a["v"], 0, 0) - shifted(a["v"], i, j) for i, j in grids.STEPS])
        drops = np.where(np.isnan(drops), -_INFINITE, drops)
        return {"direction": np.where(drops.max(axis=0) > 0, drops.argmax(axis=0), -1).astype(np.int32)}

    return _pointers(blockwise(cells, 1, kernel, "direction int"), grid_key(cells))


def follow(pointers: DataFrame, starts: DataFrame, ids: Sequence[str], most: int | None = None) -> DataFrame:
    """``ids``, step, x, y: the cells that each start comes through, itself at step 0, for ``most`` steps or to the end.

    starts: the columns ``ids``, x, y (and grid_id, where the pointers have it). Pointers must not go in circles.
    """
    key = grid_key(pointers)
    # a grid's pointers pack into small files, from whose size Spark would broadcast them
    known = [cut(starts.select(*ids, F.lit(0).cast("long").alias("step"), *_whole(starts, *key)), "follow")]
    jump, span = cut(pointers, "jump"), 1
    while most is None or span <= most:
        so_far = known[0]
        for part in known[1:]:
            so_far = so_far.union(part)
        further = so_far.join(jump.hint("merge"), [*key, "x", "y"]).select(*ids, (F.col("step") + span).alias("step"), *key, F.col("to_x").alias("x"), F.col("to_y").alias("y"))
        part = cut(further if most is None else further.where(F.col("step") <= most), "follow")
        if part.isEmpty():
            break
        known.append(part)
        then = jump.select(*key, F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("to_x").alias("_x"), F.col("to_y").alias("_y"))
        former, jump = jump, cut(jump.join(then.hint("merge"), [*key, "to_x", "to_y"]).select(*key, "x", "y", F.col("_x").alias("to_x"), F.col("_y").alias("to_y")), "jump")
        discard(former)
        span *= 2
    discard(jump)
    out = known[0]
    for part in known[1:]:
        out = out.union(part)
    return out


def downhill_paths(cells: DataFrame, starts: DataFrame, most: int = 500, side_most: int = 200, least: int = 2, side_least: int = 3) -> DataFrame:
    """start_id, branch, step, x, y, n (the path's cells), grid_id if any: always to the deepest neighbour, on the surface as
    it is. Branch -1 begins at the start; branches 0 to 7 (``SIDES``) at its lower neighbours. Short paths are left out.

    starts: start_id, x, y. A start off the grid gives nothing.
    """
    key = grid_key(cells)
    z = cells.where("v IS NOT NULL").select(*_whole(cells, *key), F.col("v").cast("double").alias("_v"))
    at = starts.select(*_whole(starts, "start_id", *key)).join(z, [*key, "x", "y"])
    side = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(SIDES)])).alias("s")
    near = at.select("start_id", *key, F.col("_v").alias("_top"), "x", "y", side).select("start_id", F.col("s.k").alias("branch"), *key, "_top", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"))
    lower = near.join(z, [*key, "x", "y"]).where(F.col("_v") < F.col("_top"))
    begin = at.select("start_id", F.lit(-1).alias("branch"), *key, "x", "y").union(lower.select("start_id", "branch", *key, "x", "y")).distinct()
    rows = follow(steepest(cells), begin, ["start_id", "branch"], max(most, side_most)).where((F.col("step") <= side_most) | ((F.col("branch") < 0) & (F.col("step") <= most)))
    path = ["start_id", "branch", *key]
    long_enough = rows.groupBy(*path).agg((F.max("step") + 1).alias("n")).where(F.col("n") >= F.when(F.col("branch") < 0, least).otherwise(side_least))
    return rows.join(long_enough, path)


def fall_slopes(cells: DataFrame, size: float = 30.0) -> DataFrame:
    """x, y, slope (degrees): the difference of the two neighbours along x and along y over one cell's width; a neighbour
    that is missing counts as level."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z = a["v"]
        own = shifted(z, 0, 0)
        n = {s: np.where(np.isnan(shifted(z, *s)), own, shifted(z, *s)) for s in ((1, 0), (-1, 0), (0, 1), (0, -1))}
        dx, dy = (n[1, 0] - n[-1, 0]) / size, (n[0, 1] - n[0, -1]) / size
        return {"slope": np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy))), "held": ~np.isnan(own)}

    return blockwise(cells, 1, kernel, "slope double", keep="held")


def fall_zones(cells: DataFrame, size: float = 30.0, stride: int = 4, moderate: float = 35.0, high: float = 45.0, least: int = 3) -> DataFrame:
    """zone, cells, west, north, east, south (cells), slope (mean) and risk (``high`` above that mean, else ``moderate``): the
    steep cells of a lattice of every ``stride``-th cell, 4-connected on it, in groups of ``least`` or more."""
    key = grid_key(cells)
    steep = fall_slopes(cells, size).where((F.pmod("x", F.lit(stride)) == 0) & (F.pmod("y", F.lit(stride)) == 0) & (F.col("slope") >= moderate))
    lattice = cut(steep.select(*key, F.floor(F.col("x") / stride).alias("x"), F.floor(F.col("y") / stride).alias("y"), "slope"), "lattice")
    met = grids.components(lattice).join(lattice, [*key, "x", "y"])
    bounds = [(f(F.col(c)) * stride).alias(n) for n, f, c in (("west", F.min, "x"), ("north", F.min, "y"), ("east", F.max, "x"), ("south", F.max, "y"))]
    found = met.groupBy(*key, F.col("component").alias("zone")).agg(F.count("*").alias("cells"), *bounds, F.avg("slope").alias("slope")).where(F.col("cells") >= least)
    return found.withColumn("risk", F.when(F.col("slope") > high, "high").otherwise("moderate"))


def _ground(cells: DataFrame, size: float) -> DataFrame:
    """x, y, slope (steepest to a neighbour, degrees), rough (deviation of 3 x 3) and lowest (no neighbour is lower)."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z = a["v"]
        own = shifted(z, 0, 0)
        around = np.stack([shifted(z, i, j) for i, j in grids.STEPS])
        run = np.array([math.hypot(i, j) for i, j in grids.STEPS])[:, None, None] * size
        rise = np.where(np.isnan(around), 0.0, np.abs(around - own))
        every = np.concatenate([around, own[None]])
        n = (~np.isnan(every)).sum(axis=0)
        mean = np.nansum(every, axis=0) / np.maximum(n, 1)
        rough = np.sqrt(np.nansum((every - mean) ** 2, axis=0) / np.maximum(n, 1))
        return {"slope": np.degrees(np.arctan2(rise, run)).max(axis=0), "rough": np.where(n > 1, rough, 0.0), "lowest": ~(around < own).any(axis=0), "held": ~np.isnan(own)}

    return blockwise(cells, 1, kernel, "slope double, rough double, lowest boolean", keep="held")


def _near(rows: DataFrame, others: DataFrame, cells: float, by: Sequence[str]) -> DataFrame:
    """Rows beside others (columns o_...) of the same ``by`` less than ``cells`` away; they meet on squares of that width."""
    square = lambda c: F.floor(F.col(c) / cells)
    spread = rows
    for c in ("x", "y"):
        spread = spread.withColumn(f"_s{c}", F.explode(F.array(square(c) - 1, square(c), square(c) + 1)))
    named = others.select(*by, *[F.col(c).alias(f"o_{c}") for c in others.columns if c not in by], square("x").alias("_sx"), square("y").alias("_sy"))
    met = spread.join(named, [*by, "_sx", "_sy"])
    return met.where((F.col("x") - F.col("o_x")) ** 2 + (F.col("y") - F.col("o_y")) ** 2 < cells * cells).drop("_sx", "_sy")


def _distances(places: DataFrame, others: DataFrame, cells: float) -> DataFrame:
    """x, y, distance: how far the nearest of ``others`` (x, y) lies from each place, in cells, where that is less than ``cells``."""
    reach = math.ceil(cells)
    ways = sorted((i * i + j * j, i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j < cells * cells)

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        other = a["_other"] == 1
        best = np.full(shifted(other, 0, 0, reach).shape, _INFINITE)
        for square, i, j in ways:
            found = shifted(other, i, j, reach)
            best[found & (best > square)] = square
        return {"distance": np.sqrt(best), "held": (best < _INFINITE) & (shifted(a["_place"], 0, 0, reach) == 1)}

    flag = lambda rows, place: rows.select(*_whole(rows), F.lit(place).alias("_place"), F.lit(1.0 - place).alias("_other"))
    both = flag(places, 1.0).union(flag(others, 0.0)).groupBy("x", "y").agg(F.max("_place").alias("_place"), F.max("_other").alias("_other"))
    return blockwise(both, reach, kernel, "distance double", ("_place", "_other"), keep="held")


def deposition_zones(cells: DataFrame, paths: DataFrame, size: float = 30.0, limit: int | None = None) -> DataFrame:
    """start_id, branch, step, x, y, kind, priority: where what slides down the paths comes to rest.

    Every n-th cell of a path is looked at (a twentieth of it, at least 3): basin (no lower neighbour), fan (below 5 degrees
    in the last 30 %), shelf (5 to 10), snag (deviation above 15), confluence (another path of the start within 3 cells).
    Of zones within 5 cells the one of higher priority stays, then the earlier one; ``limit`` of a start are returned. A
    start has at most nine paths and some twenty zones on each, which bounds the pairs.
    """
    key = [*grid_key(cells), "start_id"]
    every = F.greatest(F.lit(3), F.floor(F.col("n") / 20))
    looked = paths.where((F.col("step") > 0) & (F.col("step") % every == 0) & (F.col("step") < F.col("n") - 1))
    ground = looked.join(_ground(cells, size), [*grid_key(cells), "x", "y"])
    slope = F.col("slope")
    kind = F.when(F.col("lowest"), "basin").when((slope < 5) & (F.col("step") > F.col("n") * 0.7), "fan").when((slope > 5) & (slope < 10), "shelf").when(F.col("rough") > 15, "snag")
    at = cut(ground.select(*key, "branch", "step", "x", "y", kind.alias("kind")), "zones")
    others = paths.select(*key, "branch", "x", "y")
    place = [*key, "branch", "step"]
    met = _near(at.where("kind IS NULL"), others, 3.0, key).where(F.col("branch") != F.col("o_branch")).select(*place).distinct().withColumn("_met", F.lit("confluence"))
    # Priorities by kind.
    priority = F.when(F.col("kind") == "fan", 0.9).when(F.col("kind") == "basin", 0.8).when(F.col("kind") == "confluence", 0.7).when(F.col("kind") == "shelf", 0.6).otherwise(0.5)
    zones = at.join(met, place, "left").withColumn("kind", F.coalesce("kind", "_met")).drop("_met").where("kind IS NOT NULL").withColumn("priority", priority)
    zones = cut(zones.withColumn("id", F.concat_ws(":", *[F.col(c).cast("string") for c in place])), "zones")
    discard(at)
    order = lambda p: F.struct(-F.col(f"{p}priority"), F.col(f"{p}branch"), F.col(f"{p}step"))
    gone = rollups.outranked(_near(zones, zones, 5.0, key).where(order("o_") < order("")).select("id", F.col("o_id").alias("rival")))
    kept = zones if gone is None else zones.join(gone, "id", "left_anti")
    if limit is not None:
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("priority"), "branch", "step"))).where(F.col("_n") <= limit).drop("_n")
    return kept.drop("id")


def choke_points(cells: DataFrame, paths: DataFrame, rise: float = 5.0, limit: int | None = None) -> DataFrame:
    """start_id, step, x, y: where the ground rises more than ``rise`` within 3 cells on both sides of a primary path.

    Looked at: every third step from the fifth to the fifth last, 13 steps on after a find, at least 2 cells inside the grid.
    A start's finds are put in order in one array of at most as many steps as the longest path has.
    """
    key, grid = [*grid_key(cells), "start_id"], grid_key(cells)
    z = cells.where("v IS NOT NULL").select(*_whole(cells, *grid), F.col("v").cast("double").alias("_v"))
    edges = z.groupBy(*grid).agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("_low_", F.min), ("_high_", F.max))])
    main = paths.where("branch = -1")
    step = lambda by, name: main.select(*key, (F.col("step") + by).alias("step"), F.col("x").alias(f"_{name}x"), F.col("y").alias(f"_{name}y"))
    turned = main.where("step >= 5 AND step < n - 5").join(step(1, "a"), [*key, "step"]).join(step(-1, "b"), [*key, "step"])
    inside = turned.join(edges, grid) if grid else turned.crossJoin(F.broadcast(edges))
    for c in ("x", "y"):
        inside = inside.where((F.col(c) >= F.col(f"_low_{c}") + 2) & (F.col(c) <= F.col(f"_high_{c}") - 2))
    along = lambda c: F.col(f"_b{c}") - F.col(f"_a{c}")
    long = F.sqrt(along("x") ** 2 + along("y") ** 2)
    probe = F.explode(F.array(*[F.lit(s) for s in (-3, -2, -1, 1, 2, 3)])).alias("_s")
    sent = inside.where(long > 0).join(z, [*grid, "x", "y"]).select(*key, "step", F.col("_v").alias("_own"), "x", "y", (-along("y") / long).alias("_px"), (along("x") / long).alias("_py"), probe)
    whole = lambda c: F.floor(F.col(c) + F.col("_s") * F.col(f"_p{c}") + 0.5).cast("long").alias(c)
    hit = sent.select(*key, "step", "_own", "_s", whole("x"), whole("y")).join(z, [*grid, "x", "y"]).where(F.col("_v") - F.col("_own") > rise)
    walled = hit.groupBy(*key, "step").agg(F.max(F.col("_s") < 0).alias("_l"), F.max(F.col("_s") > 0).alias("_r")).where("_l AND _r")
    begin = F.struct(F.lit(5).cast("long").alias("due"), F.array().cast("array<bigint>").alias("found"))

    def visit(held: Column, at: Column) -> Column:
        take = (at >= held["due"]) & ((at - held["due"]) % 3 == 0)
        return F.struct(F.when(take, at + 13).otherwise(held["due"]).alias("due"), F.when(take, F.concat(held["found"], F.array(at))).otherwise(held["found"]).alias("found"))

    found = F.aggregate(F.sort_array(F.collect_list("step")), begin, visit)["found"]
    steps = walled.groupBy(*key).agg(found.alias("_found"))
    chosen = steps.select(*key, F.explode(F.col("_found") if limit is None else F.slice("_found", 1, limit)).alias("step"))
    return main.join(chosen, [*key, "step"]).select(*key, "step", "x", "y")


def terminal_zones(paths: DataFrame, size: float = 30.0) -> DataFrame:
    """start_id, x, y, radius_m, area_km2: a disc of 5 cells about the end of each primary path of 3 cells or more."""
    key = [c for c in ("grid_id", "start_id") if c in paths.columns]
    end = paths.where("branch = -1 AND n >= 3 AND step = n - 1")
    return end.select(*key, "x", "y", F.lit(5 * size).alias("radius_m"), F.lit(math.pi * (5 * size) ** 2 / 1e6).alias("area_km2"))


def raster_roads(segments: DataFrame, width: int, height: int, spread: float = 0.15) -> DataFrame:
    """x, y, cost: the least cost of a road through a cell of the grid, and of its eight neighbours plus ``spread`` (at most 1);
    cells without a road nearby are left out.

    segments: cost and points, an array of (x, y) in cells. Lines go in equal steps of at most one cell.
    """
    cell = F.transform("points", lambda p: F.struct(F.floor(p["x"]).alias("x"), F.floor(p["y"]).alias("y")))
    placed = segments.where("cost < 1").select("cost", cell.alias("_p"))
    pieces = placed.where(F.size("_p") > 1).select("cost", F.explode(F.zip_with(F.slice(F.col("_p"), F.lit(1), F.size("_p") - 1), F.slice(F.col("_p"), F.lit(2), F.size("_p") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("l"))
    steps = F.greatest(F.abs(F.col("l.b.x") - F.col("l.a.x")), F.abs(F.col("l.b.y") - F.col("l.a.y")))
    along = pieces.select("cost", "l", steps.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("_k"))
    share = F.when(F.col("_n") > 0, F.try_divide(F.col("_k"), F.col("_n"))).otherwise(0.0)
    at = lambda c: F.floor(F.col(f"l.a.{c}") + (F.col(f"l.b.{c}") - F.col(f"l.a.{c}")) * share + 0.5).alias(c)
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    roads = along.select(at("x"), at("y"), "cost").where(inside).groupBy("x", "y").agg(F.min("cost").alias("cost"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    cost = F.when((F.col("s.i") == 0) & (F.col("s.j") == 0), F.col("cost")).otherwise(F.least(F.lit(1.0), F.col("cost") + spread))
    wide = roads.select("x", "y", "cost", around).select((F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), cost.alias("cost"))
    return wide.where(inside).groupBy("x", "y").agg(F.min("cost").alias("cost"))


def routes(costs: DataFrame, targets: DataFrame, size: float = 30.0) -> DataFrame:
    """target_id, step, x, y, v, seconds: the way to each target from the source it is nearest to in time, the source at step
    0. costs: the result of ``grids.cost_distance`` (with its ``factor``, if there was one). targets: target_id, x, y.
    Targets out of reach have no rows."""
    key = grid_key(costs)
    field = costs.withColumn("factor", F.col("factor").cast("double") if "factor" in costs.columns else F.lit(1.0)).where(F.col("seconds") < _INFINITE)

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z, slow, known = a["v"], a["factor"], a["seconds"]
        own, ways = shifted(z, 0, 0), []
        for i, j in grids.STEPS:
            run = size * math.hypot(i, j)
            seconds = run / (6000 / 3600 * np.exp(-3.5 * np.abs((own - shifted(z, i, j)) / run + 0.05)))
            before = shifted(known, i, j)
            ways.append(np.where(before < shifted(known, 0, 0), before + seconds * (shifted(slow, i, j) + shifted(slow, 0, 0)) / 2, _INFINITE))
        best = np.stack(ways)
        return {"direction": np.where((shifted(known, 0, 0) > 0) & (best.min(axis=0) < _INFINITE), best.argmin(axis=0), -1).astype(np.int32)}

    back = _pointers(blockwise(field, 1, kernel, "direction int", ("v", "factor", "seconds")), key)
    reached = targets.select(*_whole(targets, "target_id", *key)).join(field.select(*_whole(field, *key)), [*key, "x", "y"], "left_semi")
    rows = cut(follow(back, reached.select("target_id", *key, "x", "y"), ["target_id"]), "routes")
    n = rows.groupBy(*key, "target_id").agg(F.max("step").alias("_last"))
    cells = field.select(*_whole(field, *key), "v", "seconds")
    return rows.join(n, [*key, "target_id"]).join(cells, [*key, "x", "y"]).select(*key, "target_id", (F.col("_last") - F.col("step")).alias("step"), "x", "y", "v", "seconds")


def route_profile(walked: DataFrame, size: float = 30.0) -> DataFrame:
    """target_id, cells, seconds, distance_m (along the ground plane), ascent_m, descent_m of ``routes``."""
    key = [c for c in ("grid_id", "target_id") if c in walked.columns]
    before = walked.select(*key, (F.col("step") + 1).alias("step"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias("_v"))
    rise = F.coalesce(F.col("v") - F.col("_v"), F.lit(0.0))
    run = F.coalesce(size * F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2), F.lit(0.0))
    met = walked.join(before, [*key, "step"], "left")
    return met.groupBy(*key).agg(F.count("*").alias("cells"), F.max("seconds").alias("seconds"), F.sum(run).alias("distance_m"), F.sum(F.greatest(rise, F.lit(0.0))).alias("ascent_m"), F.sum(F.greatest(-rise, F.lit(0.0))).alias("descent_m"))


def incidents(cells: DataFrame, sources: DataFrame, targets: DataFrame, size: float = 30.0, steep: float = 35.0, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """target_id, seconds, fall_x, fall_y, slope, end_x, end_y, zones: each target's route, the steepest place on it of
    ``steep`` degrees or more (the first of equals; null if there is none), where the corridor from there ends, and how many
    places on it and its branches things may have come to rest. ``box`` (west, north, east, south) limits where falls count.
    """
    key = grid_key(cells)
    walked = cut(routes(grids.cost_distance(cells, sources, size), targets, size), "walked")
    inside = F.lit(True) if box is None else F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    hit = walked.join(fall_slopes(cells, size).where(F.col("slope") >= steep), [*key, "x", "y"]).where(inside)
    fall = F.max_by(F.struct("x", "y", "slope"), F.struct("slope", -F.col("step"))).alias("f")
    falls = cut(hit.groupBy(*key, F.col("target_id").alias("start_id")).agg(fall).select("start_id", *key, "f.*"), "falls")
    paths = cut(downhill_paths(cells, falls, side_least=3), "corridors")
    ends = paths.where("branch = -1 AND step = n - 1").select(*key, "start_id", F.col("x").alias("end_x"), F.col("y").alias("end_y"))
    rest = deposition_zones(cells, paths, size).groupBy(*key, "start_id").agg(F.count("*").alias("zones"))
    times = walked.groupBy(*key, F.col("target_id").alias("start_id")).agg(F.max("seconds").alias("seconds"))
    named = falls.select(*key, "start_id", F.col("x").alias("fall_x"), F.col("y").alias("fall_y"), "slope")
    out = times.join(named, [*key, "start_id"], "left").join(ends, [*key, "start_id"], "left").join(rest, [*key, "start_id"], "left")
    return out.select(*key, F.col("start_id").alias("target_id"), "seconds", "fall_x", "fall_y", "slope", "end_x", "end_y", F.coalesce("zones", F.lit(0)).alias("zones"))


def rest_points(cells: DataFrame, cases: DataFrame, water: DataFrame, size: float = 30.0, spacing: int = 7, hours: float = 4.0, speed_mps: float = 0.8, thin_m: float = 500.0, steepest_deg: float = 25.0, weights: Mapping[str, tuple[float, float, float]] = REST_FACTORS, limit: int | None = None) -> DataFrame:
    """case_id, x, y, score, slope, metres, reasons: where a walker last seen at a cell may have rested.

    cases: case_id, x, y. water: x, y of cells with water. Every ``spacing``-th cell within ``hours`` of walking and of at most
    ``steepest_deg`` is scored by ``weights`` (weight, strong from, named from; REST_FACTORS) of how flat it is, how near to
    water, how sheltered and how far from the start; two strong factors are asked for. Of points within ``thin_m`` the
    better stays, then the one further north and west. ``limit`` keeps the best of a case.
    A case's candidates are bounded by the walking radius, not by the grid. Water further than 500 m away counts as none.
    """
    if "grid_id" in cells.columns:
        raise ValueError("one grid at a time")

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        z = a["v"]
        own = shifted(z, 0, 0)
        e, w, s, n = (shifted(z, *d) for d in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        tilt = [np.where(np.isnan(p) | np.isnan(q), 0.0, np.degrees(np.arctan2(np.abs(p - q), 2 * size))) for p, q in ((e, w), (s, n))]
        around = np.stack([e, w, s, n])
        held = (~np.isnan(around)).sum(axis=0)
        lee = np.nansum(around, axis=0) / np.maximum(held, 1) - own
        return {"slope": np.maximum(*tilt), "shelter": np.where(held > 0, np.clip(0.5 + lee / 10, 0, 1), 0.5), "held": ~np.isnan(own)}

    ground = blockwise(cells, 1, kernel, "slope double, shelter double", keep="held").where(F.col("slope") <= steepest_deg)
    reach = hours * 3600 * speed_mps
    last = int(reach // (size * spacing))
    ring = lambda name: F.explode(F.sequence(F.lit(-last), F.lit(last))).alias(name)
    near = cases.select(*_whole(cases, "case_id"), ring("_i")).select("*", ring("_j")).withColumn("metres", F.sqrt(F.col("_i") ** 2 + F.col("_j") ** 2) * float(size * spacing)).where(F.col("metres") <= reach)
    at = near.select("case_id", (F.col("x") + F.col("_i") * spacing).alias("x"), (F.col("y") + F.col("_j") * spacing).alias("y"), "metres").hint("merge").join(ground, ["x", "y"])
    wet = _distances(ground.select("x", "y"), water, 501.0 / size).select("x", "y", (F.col("distance") * size).alias("_wet"))
    m, wet_m = F.col("metres"), F.col("_wet")
    factors = {
        "flat": 1 - F.col("slope") / steepest_deg,
        "water": F.coalesce(F.when(wet_m < 50, 1.0).when(wet_m <= 500, 1 - 0.8 * wet_m / 500), F.lit(0.0)),
        "sheltered": F.col("shelter"),
        "interval": F.when(m < 200, 0.3).when(m <= 3000, 0.9).otherwise(F.greatest(F.lit(0.2), 0.6 - (m - 3000) / 5000)),
    }
    weighed = [F.struct(F.lit(name).alias("name"), value.alias("value"), *[F.lit(x).alias(c) for c, x in zip(("weight", "strong", "named"), weights[name], strict=True)]) for name, value in factors.items()]
    scored = at.hint("merge").join(wet, ["x", "y"], "left").withColumn("_f", F.array(*weighed))
    strong = F.size(F.filter("_f", lambda f: f["value"] > f["strong"]))
    score = F.aggregate("_f", F.lit(REST_BASE), lambda total, f: total + f["value"] * f["weight"])
    why = F.transform(F.filter("_f", lambda f: f["value"] > f["named"]), lambda f: f["name"])
    kept = scored.where(strong >= 2).select("case_id", "x", "y", score.alias("score"), "slope", "metres", why.alias("reasons")).where(F.col("score") >= REST_LEAST)
    # a case's points are few, so they are gone through in order, each held against those that stay
    near = lambda p, o: (p["x"] - o["x"]) ** 2 + (p["y"] - o["y"]) ** 2 < (thin_m / size) ** 2
    point = F.struct((-F.col("score")).alias("_worse"), "y", "x", "score", "slope", "metres", "reasons")
    points = kept.groupBy("case_id").agg(F.sort_array(F.collect_list(point)).alias("_p"))
    none = F.slice("_p", 1, 0)
    stay = F.aggregate("_p", none, lambda held, p: F.when(F.exists(held, lambda o: near(p, o)), held).otherwise(F.concat(held, F.array(p))))
    out = points.select("case_id", F.explode(stay).alias("p")).select("case_id", *[f"p.{c}" for c in ("x", "y", "score", "slope", "metres", "reasons")])
    if limit is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "y", "x"))).where(F.col("_n") <= limit).drop("_n")
    return out
