"""Lines out of rasters: outlines of zones, divides between basins, streams as paths, and values along drawn lines.

Sides and cells are put in order by list ranking: each knows the one before it, and pointers double (Wyllie 1979), so a line of a
thousand steps takes ten joins over the sides of all lines at once. No line is gathered in a task; lines are rows.
Corners carry the coordinates of the cell to their lower right; y grows southward.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators.blocks import BLOCK, blockwise, grid_key, meet, shifted
from sextant.operators.grids import STEPS, streams
from sextant.storage import cut, discard

Arrays = Mapping[str, np.ndarray]
TOP, RIGHT, BOTTOM, LEFT = range(4)
#: The neighbour beyond each side, and where a side begins and ends; walked so, the cell lies on the right hand.
_BEYOND = ((0, -1), (1, 0), (0, 1), (-1, 0))
_TAIL = ((0, 0), (1, 0), (1, 1), (0, 1))


def ranked(nodes: DataFrame) -> DataFrame:
    """node, head, step and closed of ``nodes`` (node, prev; null before the first of a list): the list's first node, how
    many steps it lies back, and whether the list is a ring, which then begins at its least node. Each node is the one
    before of at most one other."""
    base = cut(nodes.select("node", "prev"), "list")
    opened, rest = _jumped(base)
    if rest is None:
        return opened.withColumn("closed", F.lit(False))
    rings = cut(base.join(rest, "node").withColumn("prev", F.when(F.col("node") != F.col("low"), F.col("prev"))).select("node", "prev"), "rings")
    closed, _ = _jumped(rings)
    return opened.withColumn("closed", F.lit(False)).union(closed.withColumn("closed", F.lit(True)))


def _jumped(base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, head, step) of the nodes of lists with a first node, and (node, low) of those of rings, if there are any."""
    first = F.col("prev").isNull()
    now = cut(base.select("node", F.coalesce("prev", "node").alias("at"), F.when(first, 0).otherwise(1).cast("long").alias("step"), first.alias("done"), F.least("node", F.coalesce("prev", "node")).alias("low"), F.lit(True).alias("moved")), "jump")
    waiting = None
    while True:
        left, moved = now.agg(F.count_if(~F.col("done")), F.count_if(~F.col("done") & F.col("moved"))).first()
        if left == 0:
            return now.select("node", F.col("at").alias("head"), "step"), None
        if left == waiting and moved == 0:
            # lists lose waiting nodes in every round, so these are rings; where no least node within 2^k steps has changed
            # by looking 2^k steps further, the stretches that agree lie end to end all round
            return now.where("done").select("node", F.col("at").alias("head"), "step"), now.where("NOT done").select("node", "low")
        further = now.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("step").alias("_step"), F.col("done").alias("_done"), F.col("low").alias("_low"))
        waiting, former = left, now
        now = cut(now.join(further, "at").select("node", F.col("_at").alias("at"), (F.col("step") + F.col("_step")).alias("step"), F.col("_done").alias("done"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")), "jump")
        discard(former)


def _sides(labelled: DataFrame, label: str, block: int) -> DataFrame:
    """grid_id if any, x, y, own, side and beyond (the neighbour's label, null where there is none) of each side of a cell whose label differs from its neighbour's."""

    def kernel(a: Arrays, there: np.ndarray) -> Arrays:
        return {"own": shifted(a[label], 0, 0), **{f"n{k}": shifted(a[label], i, j) for k, (i, j) in enumerate(_BEYOND)}}

    key = grid_key(labelled)
    near = blockwise(labelled, 1, kernel, "own double, n0 double, n1 double, n2 double, n3 double", (label,), block=block)
    other = lambda k: F.when(~F.isnan(f"n{k}"), F.col(f"n{k}"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), other(k).cast("long").alias("beyond")) for k in range(4)])).alias("s")
    out = near.select(*key, "x", "y", F.col("own").cast("long").alias("own"), each).select(*key, "x", "y", "own", "s.side", "s.beyond")
    return out.where(F.col("beyond").isNull() | (F.col("beyond") != F.col("own")))


def _corner(side: Column, axis: int, end: bool) -> Column:
    at = [_TAIL[(k + end) % 4][axis] for k in range(4)]
    return F.col("xy"[axis]) + F.get(F.array(*map(F.lit, at)), side)


def _linked(sides: DataFrame, key: list[str], group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The sides with their node and corners (t0, t1 where they begin, h0, h1 where they end), written down; and where each ends, as ``prev`` of
    those of its ``group`` that begin there."""
    node = F.struct(*key, "y", "x", "side")
    named = sides.select("*", node.alias("node"), *[_corner(F.col("side"), axis, False).alias(f"t{axis}") for axis in (0, 1)], *[_corner(F.col("side"), axis, True).alias(f"h{axis}") for axis in (0, 1)])
    named = cut(named, "sides")
    ends = named.select(*key, *group, F.col("h0").alias("t0"), F.col("h1").alias("t1"), F.col("node").alias("prev"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return named, ends


def _rings_in_blocks(linked: DataFrame, key: list[str], block: int) -> DataFrame:
    """``linked`` (key, y, x, side, own, py, px, ps: the side before) with hy, hx, hs and step: the least side of its ring, and how many steps that lies
    back. Only rings that lie in one block have them, ``step`` is -1 for the others, which are left to ``ranked``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["y"].iloc[0]) // block * block, int(pdf["x"].iloc[0]) // block * block
        y, x, py, px = (pdf[c].to_numpy(np.int64) - corner for c, corner in (("y", top), ("x", left), ("py", top), ("px", left)))
        inside = (py >= 0) & (py < block) & (px >= 0) & (px < block)
        node = (y * block + x) * 4 + pdf["side"].to_numpy(np.int64)
        row = np.full(block * block * 4, -1)
        row[node] = np.arange(len(node))
        own = np.arange(len(node))
        prev = np.where(inside, row[np.where(inside, (py * block + px) * 4 + pdf["ps"].to_numpy(np.int64), 0)], own)
        # the least side within 2^k steps back, and whether the walk back leaves the block
        at, low, leaves = prev, np.minimum(node, node[prev]), ~inside
        for _ in range(len(node).bit_length()):
            low, leaves, at = np.minimum(low, low[at]), leaves | leaves[at], at[at]
        head = row[low]
        first = (own == head) | leaves
        at, step = np.where(first, own, prev), np.where(first, 0, 1)
        for _ in range(len(node).bit_length()):
            step, at = step + step[at], at[at]
        held = pdf.drop(columns=["_by", "_bx"])
        return held.assign(hy=head_of(pdf, "y", head), hx=head_of(pdf, "x", head), hs=head_of(pdf, "side", head), step=np.where(leaves, -1, step))

    def head_of(pdf: pd.DataFrame, column: str, head: np.ndarray) -> np.ndarray:
        return pdf[column].to_numpy(np.int64)[head]

    names = [*key, "y", "x", "side", "own", "py", "px", "ps"]
    types = dict(linked.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in names] + ["hy long, hx long, hs int, step long"])
    dealt = linked.select(*names, F.floor(F.col("y") / block).alias("_by"), F.floor(F.col("x") / block).alias("_bx"))
    return dealt.groupBy(*key, "_by", "_bx").applyInPandas(run, schema)


def zone_outlines(components_of: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rings around each component (x, y, component, grid_id if any): component, ring, step, x, y, sides, hole, area.

    A row is a corner where the ring turns, in order of ``step``; the component lies on the right hand, so that holes run
    the other way round and have a negative ``area`` (in cells): the areas of a component's rings sum to its cells. Where a component touches
    itself at a corner only, the ring keeps to the cell it follows. ``ring`` is named by its least side. No cells, no rows.
    """
    key = grid_key(components_of)
    group = ["own"]
    named, ends = _linked(_sides(components_of, "component", block), key, group)
    own_cell = ((F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).cast("int")
    linked = named.join(ends, [*key, *group, "t0", "t1"]).groupBy("node", "own").agg(F.max_by("prev", own_cell).alias("prev"))
    flat = linked.select(*[F.col(f"node.{c}").alias(c) for c in (*key, "y", "x", "side")], "own", F.col("prev.y").alias("py"), F.col("prev.x").alias("px"), F.col("prev.side").alias("ps"))
    # most rings lie in one block and close there; the others are ranked over all blocks
    within = cut(_rings_in_blocks(flat, key, block), "linked")
    side_at = lambda y, x, side: F.struct(*key, F.col(y).alias("y"), F.col(x).alias("x"), F.col(side).alias("side"))
    sides = within.select(side_at("y", "x", "side").alias("node"), "own", side_at("py", "px", "ps").alias("prev"), side_at("hy", "hx", "hs").alias("head"), "step")
    across = sides.where("step < 0").select("node", "own", "prev")
    parts = [sides.where("step >= 0"), ranked(across).join(across, "node")]
    order = parts[0].select("node", "own", "prev", "head", "step").union(parts[1].select("node", "own", "prev", "head", "step"))
    order = cut(order, "outlines")
    height = F.when(F.col("node.side") == BOTTOM, F.col("node.y") + 1).when(F.col("node.side") == TOP, -F.col("node.y")).otherwise(0)
    rings = order.groupBy("head").agg(F.count("*").alias("sides"), F.sum(height).alias("area"))
    turns = order.where(F.col("node.side") != F.col("prev.side")).join(rings, "head")
    x, y, side = F.col("node.x"), F.col("node.y"), F.col("node.side")
    corner = [c + F.get(F.array(*[F.lit(_TAIL[k][axis]) for k in range(4)]), side) for axis, c in enumerate((x, y))]
    grids = [F.col(f"node.{k}").alias(k) for k in key]
    name = (F.col("head.y") * (1 << 31) + F.col("head.x")) * 4 + F.col("head.side")
    return turns.select(*grids, F.col("own").alias("component"), name.alias("ring"), "step", corner[0].alias("x"), corner[1].alias("y"), "sides", (F.col("area") < 0).alias("hole"), "area")


def divide_lines(of_basins: DataFrame, size: float = 30.0, least: int = 5, longest: int | None = None, block: int = BLOCK) -> DataFrame:
    """The divides between basins (x, y, basin, grid_id if any) as lines: basin, other, line, step, x, y, metres, area, closed.

    A line runs along the sides between two basins, the one of the lesser name on its right hand, and ends where a third
    basin, the grid's edge or the same two meet across; a row is a corner in order of ``step``. ``metres`` is the line's
    length and ``area`` (square metres) what drains on its two hands. Lines of fewer than ``least`` sides are left out;
    ``longest`` keeps as many of each grid (ties by line).
    """
    key, group = grid_key(of_basins), ["own", "beyond"]
    sides = _sides(of_basins, "basin", block).where("own < beyond")
    named, ends = _linked(sides, key, group)
    at = [*key, *group, "t0", "t1"]
    through = named.groupBy(at).agg(F.count("*").alias("_out")).join(ends.groupBy(at).agg(F.count("*").alias("_in"), F.min("prev").alias("prev")), at).where("_out = 1 AND _in = 1").select(*at, "prev")
    linked = cut(named.join(through, at, "left").select("node", *group, "t0", "t1", "h0", "h1", "prev"), "linked")
    order = cut(ranked(linked).join(linked.drop("prev"), "node"), "divides")
    cells = of_basins.groupBy(*key, "basin").agg(F.count("*").alias("_n"))
    per = order.groupBy("head").agg(F.count("*").alias("sides"), F.first("own").alias("own"), F.first("beyond").alias("beyond"), F.first("closed").alias("closed")).where(F.col("sides") >= least)
    per = per.select("*", *[F.col(f"head.{k}").alias(k) for k in key])
    for c in group:
        per = per.join(cells.withColumnRenamed("basin", c).withColumnRenamed("_n", f"_{c}"), [*key, c])
    per = per.withColumns({"metres": F.col("sides") * float(size), "area": (F.col("_own") + F.col("_beyond")) * float(size * size), "line": (F.col("head.y") * (1 << 31) + F.col("head.x")) * 4 + F.col("head.side")})
    if longest is not None:
        w = Window.partitionBy(*key).orderBy(F.desc("sides"), "line")
        per = per.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= longest)
    # each side's first corner, and of the last side its second too
    corners = F.when(F.col("step") + 1 == F.col("sides"), F.array(F.struct(F.col("step"), F.col("t0").alias("x"), F.col("t1").alias("y")), F.struct((F.col("step") + 1).alias("step"), F.col("h0").alias("x"), F.col("h1").alias("y")))).otherwise(F.array(F.struct(F.col("step"), F.col("t0").alias("x"), F.col("t1").alias("y"))))
    laid = order.select("head", "step", "t0", "t1", "h0", "h1").join(per.select(*key, "head", "line", *group, "sides", "metres", "area", "closed"), "head")
    return laid.select(*key, F.col("own").alias("basin"), F.col("beyond").alias("other"), "line", F.explode(corners).alias("c"), "metres", "area", "closed").select(*key, "basin", "other", "line", "c.step", "c.x", "c.y", "metres", "area", "closed")


def stream_lines(accumulated: DataFrame, least_cells: int, size: float = 30.0, block: int = BLOCK) -> DataFrame:
    """Streams (``flow_accumulation``'s cells that drain ``least_cells`` or more) as paths from a head or a confluence down to the
    next confluence: path, step, x, y, cells, strahler, parent, metres.

    A path is named by its first cell (y * 2^31 + x); ``parent`` is the path that it flows into, null at a mouth;
    ``metres`` the distance from its first cell. All cells of a path have one Strahler order.
    """
    key = grid_key(accumulated)
    place = lambda y, x: F.struct(*key, y.alias("y"), x.alias("x"))
    to = lambda c, axis: F.col(c) + F.get(F.array(*[F.lit(s[axis]) for s in STEPS]), F.col("direction"))
    ordered = streams(accumulated, least_cells, block).select(*key, "x", "y", "cells", "strahler")
    leads = accumulated.select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "direction")
    wet = cut(meet(ordered, leads, [*key, "x", "y"]).select("*", place(F.col("y"), F.col("x")).alias("node"), F.when(F.col("direction") >= 0, place(to("y", 1), to("x", 0))).alias("down")), "streams")
    donors = wet.where("down IS NOT NULL").groupBy(F.col("down").alias("node")).agg(F.count("*").alias("_n"), F.min("node").alias("prev"))
    linked = cut(wet.join(donors, "node", "left").select("node", "down", "direction", "cells", "strahler", F.when(F.col("_n") == 1, F.col("prev")).alias("prev")), "linked")
    order = cut(ranked(linked).join(linked.drop("prev"), "node"), "paths")
    name = lambda c: F.col(f"{c}.y") * (1 << 31) + F.col(f"{c}.x")
    # the last cell's way down leads to the first cell of the parent
    first = order.where("step = 0").select(F.col("node").alias("down"))
    parents = order.join(first, "down").select("head", F.struct("down").alias("_p"))
    # steps across a corner are longer; their number up to each cell is a running count along the path
    diagonal = F.when(F.col("direction") % 2 == 1, 1).otherwise(0)
    w = Window.partitionBy("head").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    across = F.coalesce(F.sum(diagonal).over(w), F.lit(0))
    metres = (F.col("step") - across + across * float(np.sqrt(2.0))) * float(size)
    out = order.withColumn("metres", metres).join(parents, "head", "left")
    return out.select(*[F.col(f"node.{k}").alias(k) for k in key], name("head").alias("path"), "step", F.col("node.x").alias("x"), F.col("node.y").alias("y"), "cells", "strahler", name("_p.down").alias("parent"), "metres")


#: Fixed sizes: samples of a stretch of a segment, of a task's step, and of a block above which it is dealt to several keys.
_STRETCH, _STEP, _DEAL = 1 << 16, 1 << 18, 1 << 20
#: Fixed size: part of a cell by which stretches reach beyond their block, over what rounding may move a sample.
_SPARE = 0.001
_STRETCHES = ("x", "y", "_x", "_y", "_from", "_length", "_last", "_k", "_to", "_bx", "_by")


def _stretches(vertices: DataFrame, key: list[str], spacing: float, size: float, block: int) -> DataFrame:
    """The segments between ``vertices`` as far as a block's squares may hold their samples: where they begin and end, the distance along the line
    to there, and samples _k to _to. Some samples at a block's rim are named by its neighbour too; the block that holds them counts them."""
    line = [*key, "line_id"]
    w = Window.partitionBy(*line).orderBy("seq", "x", "y")
    v = vertices.select(*line, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("seq IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    v = v.withColumns({"_x": F.lead("x").over(w), "_y": F.lead("y").over(w)})
    length = F.coalesce(F.sqrt((F.col("_x") - F.col("x")) ** 2 + (F.col("_y") - F.col("y")) ** 2) * float(size), F.lit(0.0))
    v = v.withColumn("_length", length).withColumn("_from", F.coalesce(F.sum("_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # each multiple lies on one segment, and the last vertex behind all of them, so samples are numbered as they are laid
    low, high = F.ceil(F.col("_from") / spacing), F.ceil((F.col("_from") + F.col("_length")) / spacing) - 1
    last = F.col("_x").isNull()
    v = v.select(*line, "x", "y", F.coalesce("_x", "x").alias("_x"), F.coalesce("_y", "y").alias("_y"), "_from", "_length", last.alias("_last"), low.alias("_low"), F.when(last, low).otherwise(high).alias("_high")).where("_low <= _high")

    def over(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor((F.least(a, b) - _SPARE) / block), F.floor((F.greatest(a, b) + _SPARE) / block)))

    def share(c: str, at: Column) -> list[Column]:
        """The share of a segment, from and to, along which ``c`` lies in the block; the whole where it doesn't change."""
        ends = [F.try_divide(edge - F.col(c), F.col(f"_{c}") - F.col(c)) for edge in (at * block - _SPARE, (at + 1) * block + _SPARE)]
        return [F.greatest(F.least(*ends), F.lit(0.0)), F.least(F.greatest(*ends), F.lit(1.0))]

    v = v.select("*", over(F.col("x"), F.col("_x")).alias("_bx")).select("*", *[c.alias(n) for n, c in zip(("_s", "_t"), share("x", F.col("_bx")), strict=True)])
    v = v.select("*", over(*[F.col("y") + F.col(c) * (F.col("_y") - F.col("y")) for c in ("_s", "_t")]).alias("_by"))
    s, t = share("y", F.col("_by"))
    v = v.withColumns({"_s": F.greatest("_s", s), "_t": F.least("_t", t)}).where("_s <= _t")
    to = lambda c: (F.col("_from") + F.col(c) * F.col("_length")) / spacing
    v = v.withColumns({"_low": F.greatest("_low", F.ceil(to("_s")) - 1), "_to": F.least("_high", F.floor(to("_t")) + 1)}).where("_low <= _to")
    v = v.withColumn("_k", F.explode(F.sequence("_low", "_to", F.lit(_STRETCH).cast("long")))).withColumn("_to", F.least("_to", F.col("_k") + (_STRETCH - 1)))
    return v.select(*line, *_STRETCHES)


def _nine(x: np.ndarray) -> np.ndarray:
    """Nine decimals, halves away from zero: whole numbers stay whole."""
    scaled = x * 1e9
    return np.where(np.isfinite(scaled), np.trunc(scaled + np.copysign(0.5, x)) / 1e9, x)


def _samples(stretches: Arrays, rows: np.ndarray, v: np.ndarray, there: np.ndarray, spacing: float, block: int) -> tuple[np.ndarray, ...]:
    """The samples of some rows of ``stretches`` whose squares begin in the block: row, sample, metres, x, y, value and whether they have one."""
    n = (stretches["_to"] - stretches["_k"] + 1)[rows]
    row = np.repeat(rows, n)
    k = np.arange(len(row)) + np.repeat(stretches["_k"][rows] - (np.cumsum(n) - n), n)
    start, length = stretches["_from"][row], stretches["_length"][row]
    metres = np.where(stretches["_last"][row], start, k * float(spacing))
    part = np.divide(metres - start, length, out=np.zeros(len(row)), where=length > 0)
    x, y = (_nine(stretches[c][row] + part * (stretches[f"_{c}"][row] - stretches[c][row])) for c in ("x", "y"))
    i, j = np.floor(x).astype(np.int64) - stretches["_bx"][0] * block, np.floor(y).astype(np.int64) - stretches["_by"][0] * block
    own = (i >= 0) & (i < block) & (j >= 0) & (j < block)
    row, k, metres, x, y, i, j = (a[own] for a in (row, k, metres, x, y, i, j))
    to_x, to_y = x - np.floor(x), y - np.floor(y)
    total, weight = np.zeros(len(row)), np.zeros(len(row))
    for right in (0, 1):
        for below in (0, 1):
            w = (to_x if right else 1 - to_x) * (to_y if below else 1 - to_y)
            held = (w > 0) & there[j + below, i + right]
            total += np.where(held, v[j + below, i + right] * w, 0.0)
            weight += np.where(held, w, 0.0)
    return row, k, metres, x, y, np.divide(total, weight, out=np.zeros(len(row)), where=weight > 0), weight > 0


def _along(vertices: DataFrame, cells: DataFrame, spacing: float, size: float, block: int, made: Callable[..., Mapping[str, pa.Array]], result: str) -> DataFrame:
    """line and the columns of ``result`` that ``made`` gives for samples, taken block by block: ``row`` among them says of which stretch.

    Stretches of segments, not samples, are sent to the blocks of cells that they cross. Blocks with many samples are dealt to several keys, each with
    the block's cells.
    """
    key = grid_key(cells)
    line = [*key, "line_id"]
    at = [*key, "_bx", "_by"]
    stretches = _stretches(vertices, key, spacing, size, block)
    crossed = cut(stretches.groupBy(at).agg(F.ceil(F.sum(F.col("_to") - F.col("_k") + 1) / _DEAL).alias("_deals")), "crossed")
    # crowded blocks are fewer than a _DEAL-th of the samples
    crowded, deals = F.broadcast(crossed.where("_deals > 1")), F.coalesce("_deals", F.lit(1).cast("long"))
    near = lambda c: F.explode(F.array_distinct(F.array(F.floor(F.col(c) / block), F.floor((F.col(c) - 1) / block))))
    held = cells.where("v IS NOT NULL").select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"))
    held = held.select("*", near("x").alias("_bx")).select("*", near("y").alias("_by"))
    held = meet(held, crossed.select(at), at, "left_semi").join(crowded, at, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("_deals")
    stretches = stretches.join(crowded, at, "left").withColumn("_deal", F.pmod(F.xxhash64(*line, "_k", "x", "y"), deals)).drop("_deals")
    names, step = [c.split()[0] for c in result.split(",")], _STEP

    def run(drawn: pa.Table, of_block: pa.Table) -> pa.Table:
        arrays = {c: drawn[c].to_numpy() for c in _STRETCHES}
        parts = []
        if drawn.num_rows:
            j, i = (of_block[c].to_numpy() - arrays[f"_b{c}"][0] * block for c in ("y", "x"))
            there = np.zeros((block + 1, block + 1), bool)
            there[j, i] = True
            v = np.full((block + 1, block + 1), -np.inf)
            np.maximum.at(v, (j, i), of_block["v"].to_numpy())
            steps = (np.cumsum(arrays["_to"] - arrays["_k"] + 1) - 1) // step
            for rows in np.split(np.arange(drawn.num_rows), np.flatnonzero(np.diff(steps)) + 1):
                got = made(*_samples(arrays, rows, v, there, spacing, block))
                parts.append(pa.table([*[drawn[c].combine_chunks().take(pa.array(got["row"])) for c in line], *[got[c] for c in names]], [*line, *names]))
        empty = pa.table([drawn[c].slice(0, 0) for c in line], line)
        return pa.concat_tables(parts) if parts else pa.table([*empty.columns, *[pa.array([], {"long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in result.split(",")]], [*line, *names])

    schema = ", ".join([f"{c} {dict(vertices.dtypes)[c]}" for c in line] + [result])
    # stretches are small beside their samples, so tasks are not merged on size
    tasks, to = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*at, "_deal"]
    return stretches.repartition(tasks, *to).groupBy(to).cogroup(held.repartition(tasks, *to).groupBy(to)).applyInArrow(run, schema)


def sampled_lines(vertices: DataFrame, cells: DataFrame, spacing: float = 30.0, size: float = 30.0, block: int = BLOCK) -> DataFrame:
    """line_id, sample, metres, x, y, v: points every ``spacing`` metres along lines, and their last vertices, with bilinear values.

    vertices: line_id, seq, x, y in cells (whole numbers are centres of cells; grid_id, where the cells have it, is part of
    a line's name). A vertex's distance is the running sum of its line's segments, and each segment lays the multiples of ``spacing``
    that fall on it. Of the four cells around a point those count that are there and have a weight; none of them, no value
    (null). Lines of one vertex are one point; vertices with a null are left out.
    """

    def made(row: np.ndarray, k: np.ndarray, metres: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, known: np.ndarray) -> Mapping[str, pa.Array]:
        return {"row": row, "sample": pa.array(k), "metres": pa.array(metres), "x": pa.array(x), "y": pa.array(y), "v": pa.array(v, mask=~known)}

    return _along(vertices, cells, spacing, size, block, made, "sample long, metres double, x double, y double, v double")


def profiled_lines(vertices: DataFrame, cells: DataFrame, spacing: float = 30.0, size: float = 30.0, block: int = BLOCK) -> DataFrame:
    """``line_profiles`` of ``sampled_lines``, whose samples never become rows: each stretch of a segment is summed up in its block, and what lies
    between two stretches is added along the line."""

    def made(row: np.ndarray, k: np.ndarray, metres: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, known: np.ndarray) -> Mapping[str, pa.Array]:
        # samples of a stretch stand side by side, in order
        first = np.flatnonzero(np.diff(row, prepend=-1))
        end = np.append(first, len(row))[1:]
        of = np.repeat(np.arange(len(first)), end - first)
        n = np.bincount(of[known], minlength=len(first))
        own, at, values = of[known], metres[known], v[known]
        some = n > 0
        begin = (np.cumsum(n) - n)[some]
        least, most, steep = (np.zeros(len(first)) for _ in range(3))
        ends = {c: np.zeros(len(first)) for c in ("v0", "m0", "v1", "m1")}
        rise, run, to = np.diff(values), np.diff(at), own[1:]
        same = to == own[:-1]
        rise, run, to = rise[same], run[same], to[same]
        up, down = (np.bincount(to, weights=np.maximum(r, 0.0), minlength=len(first)).astype(float) for r in (rise, -rise))
        np.maximum.at(steep, to[run > 0], np.abs(rise[run > 0] / run[run > 0]))
        if len(begin):
            least[some], most[some] = np.fmin.reduceat(values, begin), np.maximum.reduceat(values, begin)
            for c, a, place in (("v0", values, begin), ("m0", at, begin), ("v1", values, begin + n[some] - 1), ("m1", at, begin + n[some] - 1)):
                ends[c][some] = a[place]
        null = lambda a: pa.array(a, mask=~some)
        steps = np.bincount(to[run > 0], minlength=len(first)) > 0
        return {"row": row[first], "first": pa.array(k[first]), "points": pa.array(end - first), "length": pa.array(metres[end - 1]), "n": pa.array(n), "least": null(least), "most": null(most), "up": null(up), "down": null(down), "steep": pa.array(steep, mask=~steps)} | {c: null(a) for c, a in ends.items()}

    doubles = ("length", "least", "most", "up", "down", "steep", "v0", "m0", "v1", "m1")
    parts = _along(vertices, cells, spacing, size, block, made, "first long, points long, n long, " + ", ".join(f"{c} double" for c in doubles))
    line = [*grid_key(cells), "line_id"]
    w = Window.partitionBy(*line).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("n") > 0, F.struct("v1", "m1")), ignorenulls=True).over(w)
    seen = parts.withColumn("_b", before).withColumns({"_rise": F.col("v0") - F.col("_b.v1"), "_run": F.col("m0") - F.col("_b.m1")})
    climb = lambda own, x: F.when(F.sum("n") > 0, F.coalesce(F.sum(own), F.lit(0.0)) + F.coalesce(F.sum(F.greatest(x, F.lit(0.0))), F.lit(0.0)))
    return seen.groupBy(*line).agg(
        F.max("length").alias("length_m"), F.sum("points").alias("points"), F.min("least").alias("lowest"), F.max("most").alias("highest"),
        climb("up", F.col("_rise")).alias("ascent"), climb("down", -F.col("_rise")).alias("descent"), F.max(F.greatest("steep", F.when(F.col("_run") > 0, F.abs(F.col("_rise") / F.col("_run"))))).alias("steepest"),
    )


def line_profiles(samples: DataFrame) -> DataFrame:
    """length_m, points, lowest, highest, ascent, descent and steepest (rise over run) of each line of ``sampled_lines``; points without a value are passed over."""
    line = [*grid_key(samples), "line_id"]
    w = Window.partitionBy(*line).orderBy("metres").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("v").isNotNull(), F.struct("v", "metres")), ignorenulls=True).over(w)
    seen = samples.select(*line, "metres", "v", before.alias("_b")).withColumns({"_rise": F.col("v") - F.col("_b.v"), "_run": F.col("metres") - F.col("_b.metres")})
    climb = lambda x: F.when(F.count("v") > 0, F.coalesce(F.sum(F.greatest(x, F.lit(0.0))), F.lit(0.0)))
    return seen.groupBy(*line).agg(
        F.max("metres").alias("length_m"), F.count("*").alias("points"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
        climb(F.col("_rise")).alias("ascent"), climb(-F.col("_rise")).alias("descent"), F.max(F.when(F.col("_run") > 0, F.abs(F.col("_rise") / F.col("_run")))).alias("steepest"),
    )
