"""Raster kernels on blocks: a long cell table (grid_id if there is one, x, y, values) cut into squares with a halo.

A cell goes to its own block, and to the neighbouring blocks of which it lies in the halo, so a table grows by a few
hundredths in the one shuffle that deals it out by (grid_id, bx, by); a block's arrays are a task's whole memory. Kernels
are NumPy on those arrays. ``settle`` repeats a kernel until no block changes, for results that travel over the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.storage import cut, discard

BLOCK = 256
#: A kernel's input: each value column as an array [row, column] with the halo around it (NaN where there is none), and
#: which cells there are. Its result: arrays of the block without the halo.
Kernel = Callable[[Mapping[str, np.ndarray], np.ndarray], Mapping[str, np.ndarray]]


def grid_key(cells: DataFrame) -> list[str]:
    """The column that tells grids apart, if the table has one."""
    return ["grid_id"] if "grid_id" in cells.columns else []


def meet(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Tables of cells joined by shuffles. Files of cells are far smaller than their rows, so on the size of its files a whole grid would
    pass for small and be broadcast through the driver."""
    return a.hint("merge").join(b.hint("merge"), list(on), how)


def blockwise(cells: DataFrame, halo: int, kernel: Kernel, result: str, values: Sequence[str] = ("v",), keep: str | None = None, block: int = BLOCK) -> DataFrame:
    """grid_id (if any), x, y and the columns of ``result`` for each cell of ``cells``; ``keep`` names a result that selects
    the cells to return and isn't returned. A cell given twice counts with one of its values."""
    if halo > block:
        raise ValueError("the halo is wider than a block")
    key = grid_key(cells)
    chosen = cells.select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[F.col(c).cast("double").alias(c) for c in values])

    def near(at: str) -> Column:
        own = F.floor(F.col(at) / block)
        inner = F.col(at) - own * block
        return F.concat(F.array(own), F.when(inner < halo, F.array(own - 1)).otherwise(F.array().cast("array<long>")), F.when(inner >= block - halo, F.array(own + 1)).otherwise(F.array().cast("array<long>")))

    dealt = chosen.withColumn("bx", F.explode(near("x"))).withColumn("by", F.explode(near("y"))) if halo else chosen.withColumn("bx", F.floor(F.col("x") / block)).withColumn("by", F.floor(F.col("y") / block))
    names = [c.split()[0] for c in result.split(",")]
    wide = block + 2 * halo

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, top = int(pdf["bx"].iloc[0]) * block, int(pdf["by"].iloc[0]) * block
        j, i = pdf["x"].to_numpy() - left + halo, pdf["y"].to_numpy() - top + halo
        there = np.zeros((wide, wide), bool)
        there[i, j] = True
        arrays = {}
        for c in values:
            a = np.full((wide, wide), np.nan)
            a[i, j] = pdf[c].to_numpy(np.float64)
            arrays[c] = a
        inner = there[halo : halo + block, halo : halo + block]
        if not inner.any():
            return pd.DataFrame()
        made = kernel(arrays, there)
        rows, columns = np.nonzero(inner & made[keep].astype(bool) if keep else inner)
        out = {k: [pdf[k].iloc[0]] * len(rows) for k in key} | {"x": columns + left, "y": rows + top}
        return pd.DataFrame(out | {c: made[c][rows, columns] for c in names})

    schema = ", ".join([f"{k} {dict(cells.dtypes)[k]}" for k in (*key, "x", "y")] + [result])
    return dealt.groupBy(*key, "bx", "by").applyInPandas(run, schema)


def settle(cells: DataFrame, kernel: Kernel, state: Sequence[str], fixed: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The table after ``kernel`` has been applied, block by block with a halo of one cell, until no ``state`` changes.

    The kernel returns the new state columns and ``moved``, which cells have changed; it must go to its own end inside a
    block, so that rounds count the blocks that a result travels through. Each round is written to the shared folder.
    """
    key = grid_key(cells)
    now = cut(cells.select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *fixed, *state), "grid")
    columns = ", ".join(f"{c} double" for c in (*fixed, *state)) + ", moved boolean"
    while True:

        def step(arrays: Mapping[str, np.ndarray], there: np.ndarray) -> Mapping[str, np.ndarray]:
            made = dict(kernel(arrays, there))
            return made | {c: arrays[c][1:-1, 1:-1] for c in fixed}

        former, now = now, cut(blockwise(now, 1, step, columns, (*fixed, *state), block=block), "grid")
        discard(former)
        if now.where("moved").isEmpty():
            return now.select(*key, "x", "y", *fixed, *state)


def shifted(a: np.ndarray, i: int, j: int, halo: int = 1) -> np.ndarray:
    """What lies ``i`` columns to the right and ``j`` rows below each cell of the block."""
    return a[halo + j : a.shape[0] - halo + j, halo + i : a.shape[1] - halo + i]


def window_sums(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over the (2r + 1)^2 window of each cell of the block (halo r), rows first, then columns."""
    total = np.cumsum(np.pad(a, ((0, 0), (1, 0))), axis=1)
    rows = total[:, 2 * r + 1 :] - total[:, : -2 * r - 1]
    total = np.cumsum(np.pad(rows, ((1, 0), (0, 0))), axis=0)
    return total[2 * r + 1 :] - total[: -2 * r - 1]


def labels(mask: np.ndarray, classes: np.ndarray | None = None, diagonal: bool = False) -> np.ndarray:
    """For each cell of ``mask`` the least place (row by row) of its connected cells; -1 outside.

    Touching cells hook their roots to the lesser one, and roots jump to their own roots (Shiloach and Vishkin 1982).
    """
    h, w = mask.shape
    place = np.arange(h * w).reshape(h, w)
    edges = []
    for i, j in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if diagonal else ())):
        a = (slice(0, h - i), slice(max(0, -j), w - max(0, j)))
        b = (slice(i, h), slice(max(0, j), w - max(0, -j)))
        both = mask[a] & mask[b]
        if classes is not None:
            both &= classes[a] == classes[b]
        edges.append((place[a][both], place[b][both]))
    u, v = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    root = np.arange(h * w)
    while len(u):
        a, b = root[u], root[v]
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    return np.where(mask, root.reshape(h, w), -1)
