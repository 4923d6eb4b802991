"""Approximate nearest neighbours by shifted space-filling curves.

Several orthogonal projections of the unit vectors to a few dimensions are shifted at random, quantised and ordered along
a Hilbert curve each. A query is scored in double precision against the rows of its window, so many places to either side
of it in each order, and the windows of all curves are merged and reranked on the original vectors. Orders are cut into
cells, and a window is made of whole cells.

How wide windows must be depends on the vectors, so it is measured: the true neighbours of CALIBRATION queries are found in
one pass over all rows, and the number of curves and the window are the least work with which RECALL of these neighbours
are met. Vectors with structure take windows of some hundred rows, whatever the table's size. Independent directions have
none that an ordering could keep: there the windows grow with the table.

Vectors of the same direction are one class that keeps its k + 1 smallest ids: no more can be among the k nearest of any
query. Cosines that agree to TIE are equal, and the smaller vec_id comes first. Cells give k + 1 classes for a query,
chosen by that very order, so a tie of any number of vectors loses none that belongs in the result. Keys alone are
range-partitioned to find the cells; each vector then travels once for each curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.shipping import ship
from sextant.llm.storage import cut

CURVES = 12
DIMENSIONS = 8
BITS = 4
#: Queries whose true neighbours tell how wide windows must be, and the share of these neighbours to be met.
CALIBRATION = 256
RECALL = 0.96
#: Rows of a cell: half a window's reach, within these.
LEAST_CELL, MOST_CELL = 128, 2048
#: Queries scored together against a cell.
QUERY_CHUNK = 2048
#: The projections' quantiles are fitted on at most this many vectors, those of the least id hashes.
FIT_ROWS = 10_000
#: Cosines are compared in whole steps of this, components of scaled vectors in steps of 2^-WAY_BITS.
TIE = 1e-12
WAY_BITS = 43
#: Pairs scored together in double precision after a cell's matrix product has chosen them.
PAIRS = 16_384


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with whole coordinates in [0, 2^bits), one point a row.

    Works bit plane by bit plane from the top (Skilling 2004): undo the rotations and reflections of each sub-cube, then
    Gray-decode and interleave.
    """
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            flip = (x[i] >> bit & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where(x[-1] >> bit & 1, turn ^ ((1 << bit) - 1), turn)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] ^ turn) >> bit & 1
    return key


class Curves:
    """Projections, shifts and quantiles of all curves, fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, dim: int, curves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.axes, self.edges = [], []
        per_turn = max(1, dim // DIMENSIONS)
        for k in range(curves):
            if k % per_turn == 0:
                turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            at = k % per_turn * DIMENSIONS
            axes = turn[:, at : at + DIMENSIONS]
            # the shift moves the grid by up to a quarter of the spread
            levels = np.clip((np.arange(1, 1 << BITS)[:, None] / (1 << BITS) - 0.25 * rng.random(axes.shape[1])) / 0.75, 0, 1)
            spread = np.sort(sample @ axes, axis=0)
            place = np.minimum((levels * len(spread)).astype(int), len(spread) - 1)
            self.axes.append(axes)
            self.edges.append(np.take_along_axis(spread, place, axis=0))

    def keys(self, unit: np.ndarray, k: int) -> np.ndarray:
        p = unit @ self.axes[k]
        cells = np.stack([np.searchsorted(self.edges[k][:, j], p[:, j], "right") for j in range(p.shape[1])], axis=1)
        return hilbert_keys(cells, BITS)


def _scaled(vectors: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    # scaled, so that neither huge nor tiny components leave the range of doubles when squared
    return m / np.abs(m).max(axis=1, keepdims=True)


def _matrix(vectors: list[bytes]) -> np.ndarray:
    m = _scaled(vectors)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products row by row, summed in the order of _cosine, so that both give the same bits."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out = out + a[:, j] * b[:, j]
    return out


def _best(a: np.ndarray, b: np.ndarray, ids: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``a`` the first ``take`` of ``b`` by cosine, then id: places in a, places in b, cosines."""
    of_a, of_b, take = np.sqrt(_dots(a, a)), np.sqrt(_dots(b, b)), min(take, len(b))
    near = (a / of_a[:, None]) @ (b / of_b[:, None]).T
    least = np.partition(near, len(b) - take, axis=1)[:, len(b) - take]
    row, column = np.nonzero(near >= least[:, None] - 4 * TIE)
    dots = [_dots(a[row[i : i + PAIRS]], b[column[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]
    cosine = np.concatenate(dots) / (of_a[row] * of_b[column])
    order = np.lexsort((ids[column], -np.floor(cosine / TIE + 0.5), row))
    row, column, cosine = row[order], column[order], cosine[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < take
    return row[kept], column[kept], cosine[kept]


def _packed(df: DataFrame) -> DataFrame:
    """(node, items) -> (node, packed): the doubles of a vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            rows = [flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.binary())], names=["node", "packed"])

    return df.mapInArrow(run, "node long, packed binary")


def _true_neighbours(packed: DataFrame, asked: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """(q, node): the k nearest rows of each of a few queries, itself left out; every task keeps k + 1 of its rows."""
    shared = packed.sparkSession.sparkContext.broadcast((asked, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names = shared.value
        near, found = np.full((len(names), k + 1), -2.0), np.full((len(names), k + 1), -1, np.int64)
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 4096):
                score = queries @ _matrix(batch.column("packed").slice(at, 4096).to_pylist()).T
                held = np.concatenate([near, score], axis=1)
                of = np.concatenate([found, np.broadcast_to(nodes[at : at + 4096], score.shape)], axis=1)
                best = np.argpartition(-held, k, axis=1)[:, : k + 1]
                near, found = np.take_along_axis(held, best, axis=1), np.take_along_axis(of, best, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k + 1)), pa.array(found.reshape(-1)), pa.array(near.reshape(-1))], names=["q", "node", "near"])

    each = packed.mapInArrow(run, "q long, node long, near double").where("near > -2 AND q <> node")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("near").desc(), "node"))
    return each.withColumn("_r", place).where(F.col("_r") <= k).select("q", "node")


def fit_windows(gaps: np.ndarray, total: int, recall: float = RECALL) -> tuple[int, int, int]:
    """(curves, reach, cell): the smallest part of all rows to score so that the share ``recall`` of known neighbours is met.

    gaps: for each known pair the places between the two in each curve's order. Of the first m curves the best is taken;
    reach is that gap's quantile, a window is the whole cells that hold it, and windows of several curves overlap as sets
    drawn at random do.
    """
    best = None
    for m in range(1, gaps.shape[1] + 1):
        least = np.sort(gaps[:, :m].min(axis=1))
        reach = int(least[max(0, math.ceil(recall * len(least)) - 1)])
        cell = min(MOST_CELL, max(LEAST_CELL, math.ceil(reach / 2)))
        scored = 1 - (1 - min(1.0, (2 * math.ceil(reach / cell) + 1) * cell / total)) ** m
        if best is None or scored < best[0]:
            best = (scored, m, reach, cell)
    return best[1:]


def nearest(
    vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    curves: int = CURVES, recall: float = RECALL, observed: dict | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score for the ``k`` nearest found of each row that ``is_query`` (over vec_id).

    Largest cosine first, in double precision on the original vectors; ties (up to TIE) go to the smaller vec_id; a row is no
    neighbour of its own id. With no more than k other rows, all of them. No part is taken by null ids and by vectors
    that are null, empty, zero, of another length than most, or hold null or non-finite components. Rows repeated with
    the same vec_id and vector count once. Other columns are ignored. An empty table, or one without queries, gives no rows.
    observed is given the curves, reach and cell that were chosen, and the rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    item = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), item.alias("items")).where("vec_id IS NOT NULL AND items IS NOT NULL")
    good = F.forall("items", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("items", lambda x: x != 0)
    rows = rows.where(good)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("items").collect()
    lengths = [len(r[0]) for r in sample]
    dim = max(sorted(set(lengths)), key=lengths.count, default=0)
    fitted = [np.array(r[0], np.float64).tobytes() for r in sample if len(r[0]) == dim]
    result = "query_id long, rank int, vec_id long, score double"
    if not fitted:
        return spark.createDataFrame([], result)
    shape = spark.sparkContext.broadcast(Curves(_matrix(fitted), dim, curves))
    # classes of one direction: node = smallest id, ids = the k + 1 smallest, asks = whether one of all its ids is a query
    most = F.array_max(F.transform("items", F.abs))
    way = F.transform("items", lambda x: F.floor(x / most * float(1 << WAY_BITS) + 0.5))
    rows = cut(rows.where(F.size("items") == dim).distinct().withColumn("asks", F.expr(is_query)).withColumn("way", way), "vectors")
    nodes = rows.groupBy("way").agg(F.min(F.struct("vec_id", "items")).alias("least"), F.max("asks").alias("asks"))
    nodes = cut(nodes.select("way", F.col("least.vec_id").alias("node"), "least.items", "asks"), "nodes")
    few = F.row_number().over(Window.partitionBy("way").orderBy("vec_id"))
    first_ids = rows.withColumn("_r", few).where(F.col("_r") <= k + 1).groupBy("way").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    first_ids = cut(first_ids.select("node", "ids"), "ids")
    packed = cut(_packed(nodes.select("node", "items")), "packed")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column("packed").to_pylist()) if batch.num_rows else np.zeros((0, dim))
            for c in range(curves if batch.num_rows else 0):
                made = [batch.column("node"), pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(shape.value.keys(unit, c))]
                yield pa.RecordBatch.from_arrays(made, names=["node", "curve", "key"])

    order = ["curve", "key", "node"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = packed.mapInArrow(keyed, "node long, curve int, key long").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(placed.select("node", "curve", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "curves")
    # one row for each partition and curve: where the curve's rows in the partition begin
    begins = placed.groupBy("part", "curve").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = begins.select(F.col("part").alias("_part"), F.col("curve").alias("_curve"), "first", before.alias("before"))
    place = F.col("before") + F.col("seq") - F.col("first")
    places = cut(placed.join(begins, (F.col("part") == F.col("_part")) & (F.col("curve") == F.col("_curve"))).select("node", "curve", place.alias("place")), "places")
    total = packed.count()
    asking = nodes.where("asks").select("node")
    tried = packed.join(asking, "node").orderBy(F.xxhash64("node"), "node").limit(CALIBRATION).collect()
    if not tried:
        return spark.createDataFrame([], result)
    ids = np.array([r.node for r in tried], np.int64)
    pairs = cut(_true_neighbours(packed, _matrix([bytes(r.packed) for r in tried]), ids, k), "known")
    # at most CALIBRATION * k pairs and their places
    of_q = places.join(F.broadcast(pairs), places.node == pairs.q).select("q", pairs.node.alias("node"), "curve", F.col("place").alias("of_q"))
    gaps = of_q.join(places, ["node", "curve"]).select("q", "node", "curve", F.abs(F.col("place") - F.col("of_q")).alias("gap")).collect()
    known = {pair: i for i, pair in enumerate(sorted({(r.q, r.node) for r in gaps}))}
    table = np.zeros((max(1, len(known)), curves), np.int64)
    for r in gaps:
        table[known[r.q, r.node], r.curve] = r.gap
    used, reach, size = fit_windows(table, total, recall)
    if observed is not None:
        observed |= {"curves": used, "reach": reach, "cell": size, "rows": total}
    cells = places.where(F.col("curve") < used).select("node", "curve", F.floor(F.col("place") / size).cast("int").alias("cell"))
    side, last = math.ceil(reach / size), (total - 1) // size
    chunks = max(1, math.ceil(asking.count() * min(1.0, (2 * side + 1) * size / total) / QUERY_CHUNK))
    per_node = cells.groupBy("node").agg(F.collect_list(F.struct("curve", "cell")).alias("at"))
    full = packed.join(per_node, "node").withColumn("at", F.explode("at")).select("node", "packed", "at.curve", "at.cell")
    data = full.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("query", F.lit(False))
    window = F.sequence(F.greatest(F.lit(0), F.col("cell") - side), F.least(F.lit(last), F.col("cell") + side))
    queries = full.join(asking, "node").withColumn("cell", F.explode(window)).withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int")).withColumn("query", F.lit(True))

    def score(block: pd.DataFrame) -> pd.DataFrame:
        asked, held = block[block["query"]], block[~block["query"]]
        if not len(asked) or not len(held):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "near": np.zeros(0)})
        row, column, near = _best(_scaled(asked["packed"].tolist()), _scaled(held["packed"].tolist()), held["node"].to_numpy(), k + 1)
        return pd.DataFrame({"q": asked["node"].to_numpy()[row], "node": held["node"].to_numpy()[column], "near": near})

    found = data.unionByName(queries).groupBy("curve", "cell", "chunk").applyInPandas(score, "q long, node long, near double")
    merged = found.groupBy("q", "node").agg(F.max("near").alias("near"))
    top = F.row_number().over(Window.partitionBy("q").orderBy(_level("near").desc(), "node"))
    merged = cut(merged.withColumn("_r", top).where(F.col("_r") <= k + 1).select("q", "node"), "merged")
    # rerank on the original vectors
    of_q = nodes.select(F.col("node").alias("q"), F.col("items").alias("of_q"))
    both = merged.join(nodes.select("node", "items"), "node").join(of_q, "q")
    ranked = both.select("q", "node", _cosine("items", "of_q").alias("score")).join(first_ids, "node").select("q", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(_level("score").desc(), "vec_id"))
    ranked = ranked.withColumn("_r", place).where(F.col("_r") <= k + 1).select("q", "score", "vec_id")
    asked = rows.where("asks").join(nodes.select("way", F.col("node").alias("q")), "way").select(F.col("vec_id").alias("query_id"), "q")
    out = asked.join(ranked, "q").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(_level("score").desc(), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _level(score: str):
    return F.floor(F.col(score) / TIE + 0.5)


def _cosine(a: str, b: str):
    def scaled(x):
        most = F.array_max(F.transform(F.col(x), F.abs))
        return F.transform(F.col(x), lambda v: v / most)

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = scaled(a), scaled(b)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
