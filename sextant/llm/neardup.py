"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives each document the size and a 128-bit digest of its shingle set, and the bucket names of
   its signature bands. Equal sets are one class from here on, named by its smallest doc_id, so any number of exact
   copies costs one row.
2. A bucket's candidate edges form a star around its most connected class, the one that shares most buckets with most
   others (the original of a family of copies, as a rule). A class goes to the best centre of its buckets only, so there
   are no more edges than classes, and they make a forest. All links are confirmed on full sets.
3. A star can miss a link between two leaves. So the trees are labelled, and in buckets that still hold several labels
   each pair of different labels is compared once, in the first bucket that the two share, by sketches of SKETCH bits,
   or by the sets themselves where one has fewer than SHORT shingles (sketches of few shingles are too coarse, and such
   sets are hardly larger); those close enough go on to the full sets. A family of texts that resemble each other below the threshold costs
   comparisons of bits, not of texts, and pairs already connected cost nothing.

With BANDS bands of ROWS values a pair at similarity 0.8 shares no bucket with probability (1 - 0.8^5)^32 = 3e-6; its
sketches, if both sets have SHORT shingles, are SLACK standard deviations off with probability 3e-5 at the threshold
itself, far less above it. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import shingles, textscan
from sextant.llm.components import components
from sextant.llm.shipping import ship
from sextant.llm.storage import cut, discard

BANDS = 32
ROWS = 5
SKETCH = 2048
#: The part of a sketch that is compared first.
GLANCE = 512
SLACK = 4.0
#: Sets of fewer shingles are compared themselves.
SHORT = 64
#: Rows signed at once, so that SLICE_ROWS * SKETCH values are the most that a worker holds.
SLICE_ROWS = 512


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _long(flat))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.batches_by_bytes(whole, "text", rows=SLICE_ROWS):
                sets = shingles.shingle_sets(batch.column("text"), width)
                names = shingles.bands(shingles.signatures(sets, BANDS * ROWS), BANDS)
                lengths = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(lengths), pa.array([shingles.digest(s) for s in sets], pa.binary()), _lists(names.reshape(-1), np.where(lengths > 0, BANDS, 0))],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """node, items; short: the items again of sets that can be similar to one of fewer than SHORT; sketch of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.batches_by_bytes(whole, "text", rows=SLICE_ROWS):
                sets = shingles.shingle_sets(batch.column("text"), width)
                lengths = np.array([len(s) for s in sets], np.int64)
                bits = shingles.sketches(shingles.signatures([s for s in sets if len(s) >= SHORT], SKETCH))
                words = np.where(lengths >= SHORT, SKETCH // 64, 0)
                brief = np.where(percent * lengths < 100 * SHORT, lengths, 0)
                few = np.concatenate([s[:n] for s, n in zip(sets, brief.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths), _lists(np.concatenate(sets), lengths), _lists(few, brief), _lists(bits.reshape(-1), words)], names=["node", "size", "items", "short", "sketch"])

    return docs.mapInArrow(run, "node long, size long, items array<long>, short array<long>, sketch array<long>")


def _close(a: str, b: str, percent: int, bits: int) -> Column:
    """Whether two sketches differ in no more of their first bits than SLACK deviations above what the threshold leads to."""
    j = percent / 100
    limit = bits * (1 - j) / 2 + SLACK * (bits * (1 + j) / 2 * (1 - j) / 2) ** 0.5
    words = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(bits // 64)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total <= int(limit)


def _similar(a: str, b: str, percent: int) -> Column:
    """Whether two sets are similar enough; sizes first: without this much overlap possible, they need not be compared."""
    small, big = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(100 * small >= percent * big, 100 * both >= percent * (F.size(a) + F.size(b) - both)).otherwise(False)


def _forest_labels(parents: DataFrame) -> DataFrame:
    """(node, label) of all nodes of a forest given as (v, u: its only parent); label is the least node of the tree."""
    up = cut(parents.select(F.col("v").alias("node"), F.col("u").alias("root")).distinct(), "forest")
    before = up
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = cut(up.join(above, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forest")
        discard(before)
        before, up = jumped, jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            break
    trees = up.groupBy("root").agg(F.least(F.col("root"), F.min("node")).alias("label"))
    return cut(up.join(trees, "root").select("node", "label").union(trees.select(F.col("root").alias("node"), "label")), "labels")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough. A set travels once for each of its pairs as v."""
    with_v = pairs.join(sets.withColumnRenamed("node", "v").withColumnRenamed("items", "of_v"), "v")
    with_both = with_v.join(sets.withColumnRenamed("node", "u").withColumnRenamed("items", "of_u"), "u")
    return with_both.where(_similar("of_u", "of_v", percent)).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Rows are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``width``-word shingles. component_id is
    the smallest doc_id reachable by links; kept is doc_id = component_id. Texts without words, and null texts, have an
    empty set and are linked with nothing. Rows that share a doc_id are one node of the link graph. A row whose doc_id is
    null takes no part: its component_id is null and it is kept. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = cut(_signed(base, width), "signed")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("digest").alias("name")).agg(F.min("doc_id").alias("rep"))
    able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    met = signed.join(classes, F.when(able, F.col("digest")) == F.col("name"), "left")
    copies = cut(met.select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "classes")
    # members: (bucket, node, n) of buckets that hold two nodes or more
    bands = copies.where("bands IS NOT NULL").select(F.col("rep").alias("node"), "bands")
    placed = bands.select(F.explode("bands").alias("bucket"), "node")
    shared = placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n")
    members = cut(placed.join(shared, "bucket"), "members")
    nodes = cut(members.groupBy("node").agg(F.sum("n").alias("degree")), "nodes")
    sets = cut(_sets(base.join(nodes, base.doc_id == nodes.node, "left_semi"), width, percent), "sets")
    ranked = members.join(nodes, "node").select("bucket", F.struct("degree", (-F.col("node")).alias("node")).alias("rank"))
    centres = ranked.groupBy("bucket").agg(F.max("rank").alias("centre"))
    star = ranked.join(centres, "bucket").where("rank < centre").groupBy("rank.node").agg(F.max("centre").alias("c"))
    star = star.select((-F.col("c.node")).alias("u"), (-F.col("node")).alias("v"))
    full = sets.select("node", "items")
    labels = _forest_labels(_confirmed(star, full, percent))
    # pairs of different labels, each in the first bucket that it shares
    known = members.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    held = cut(known.join(mixed, "bucket").join(sets.select("node", "size", "short", "sketch"), "node").join(bands, "node"), "mixed")
    others = held.select(*[F.col(c).alias(f"c_{c}") for c in held.columns])
    differ = (F.col("bucket") == F.col("c_bucket")) & (F.col("node") < F.col("c_node")) & (F.col("label") != F.col("c_label"))
    near = _close("sketch", "c_sketch", percent, GLANCE) & _close("sketch", "c_sketch", percent, SKETCH)
    # a larger set that isn't among the short ones is empty there, and too large for the smaller one
    near = F.when(F.least("size", "c_size") < SHORT, _similar("short", "c_short", percent)).otherwise(near)
    first = F.get(F.array_intersect("bands", "c_bands"), F.lit(0)) == F.col("bucket")
    pairs = held.join(others, differ & near & first).select(F.col("node").alias("u"), F.col("c_node").alias("v")).distinct()
    # every class of a doc_id that has several, with the least of them
    several = copies.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("doc_id", "u")
    same_id = copies.join(several, "doc_id").where("rep > u").select("u", F.col("rep").alias("v")).distinct()
    more = cut(_confirmed(pairs, full, percent).union(same_id), "links")
    out = copies.join(labels, copies.rep == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("rep"))
    if more.isEmpty():
        label = F.col("rep")
    else:
        u, v = labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        between = more.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        merged = cut(components(between), "merged")
        out, label = out.join(merged, out.rep == merged.node, "left"), F.coalesce("label", "rep")
    component = F.coalesce(label, "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
