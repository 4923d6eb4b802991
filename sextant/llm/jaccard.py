"""Exact Jaccard join of documents on word shingles: a size-aware heavy-light join.

Two sets of sizes t <= s are similar enough just if they share c = ceil(percent * (s + t) / (100 + percent)) elements.

1. One pass over the texts gives each document the size and a 128-bit digest of its set; equal sets are one class from here
   on. The same pass counts elements in COUNTERS counters, a table of fixed size, which orders elements from rare to common.
2. Heavy sets are found through inverted lists: each set stands in the lists of its rarest elements, as many as it takes
   for two similar sets to share one. Elements of passages that very many documents hold come last and are hardly listed.
3. Light sets are found through fixed-size subsets: for each size of a partner a set names all its subsets of c elements
   (as sums of hashes, so one subset costs a few subtractions). Sets of the right sizes under one name are similar by
   construction, so a name with any number of sets makes a star and no pair is compared.
4. The size up to which sets are light is where the subsets named plus the list entries still to be scanned are fewest; both are
   counted beforehand, by size.

Lists are scanned in two turns, as most of a family of near copies hangs together: first each set meets the one of its lists
that stands in most lists, and what proves similar is labelled; then pairs of different labels in a list meet. A
pair must pass its sizes, its places in the list and a lossless bound from parity bitmaps (the sets differ in at least as
many elements as the bitmaps do in bits) before full sets are compared. Nothing is capped and no filter loses a link. A family
of texts that resemble each other just below the threshold costs comparisons of bits for each of its pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import shingles, textscan
from sextant.llm.components import components
from sextant.llm.neardup import SLICE_ROWS, _confirmed, _forest_labels, _lists
from sextant.llm.shipping import ship
from sextant.llm.storage import cut

_U64 = np.uint64
#: Counters of elements: the most that is broadcast, 4 MB, however many elements there are.
COUNTERS = 1 << 20
#: Counters that travel in a row.
CHUNK = 1 << 14
#: Elements for each 64 bits of a set's bitmap, which has 1, 2, 4 ... words, MOST_WORDS at most. Unrelated sets differ in half
#: of the bits, similar ones in a third at most.
A_WORD, MOST_WORDS = 128, 64
#: Nodes whose sets are picked out of the texts by a table of bits (16 a node, so 32 MB are broadcast at most); where more are
#: wanted, the texts are joined with them.
PICKED = 1 << 24
#: Sizes up to which the boundary is looked for; a set of 32 has up to some ten thousand subsets.
LIMIT = 32
_SECOND = _U64(0xA0761D6478BD642F)


def shared(a: int, b: int, percent: int) -> int:
    """The elements that sets of sizes a and b must share."""
    return -(-percent * (a + b) // (100 + percent))


def partners(size: int, percent: int) -> range:
    """The sizes of sets that one of ``size`` can be similar to."""
    return range(-(-percent * size // 100), 100 * size // percent + 1)


def named(size: int, percent: int) -> int:
    """How many subsets a set of ``size`` names; those that only an equal set shares are left out."""
    return sum(math.comb(size, shared(size, p, percent)) for p in partners(size, percent) if (p, shared(size, p, percent)) != (size, size))


def boundary(sets: dict[int, int], scanned: dict[int, int], percent: int) -> int:
    """The greatest light size: least sum of subsets named by ``sets`` (count by size) and list entries ``scanned`` (by size)."""
    costs, light, total = [], 0, sum(scanned.values())
    for x in range(LIMIT + 1):
        light += sets.get(x, 0) * named(x, percent) if x else 0
        still = total - sum(n for s, n in scanned.items() if s < partners(x + 1, percent).start)
        costs.append((light + still, x))
    return min(costs)[1]


def _slot(sets: np.ndarray) -> np.ndarray:
    return (sets & _U64(COUNTERS - 1)).astype(np.int64)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document, and after them the task's counters in chunks."""
    schema = "doc_id long, n_shingles long, digest binary, chunk int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int32)
        for whole in batches:
            for batch in textscan.batches_by_bytes(whole, "text"):
                sets = shingles.shingle_sets(batch.column("text"), width)
                counts += np.bincount(_slot(np.concatenate(sets)), minlength=COUNTERS).astype(np.int32)
                n, none = len(sets), pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.digest(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), none], names=["doc_id", "n_shingles", "digest", "chunk", "counts"])
        parts = counts.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        null = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([null, null, pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["doc_id", "n_shingles", "digest", "chunk", "counts"])

    return docs.mapInArrow(run, schema)


def _counters(signed: DataFrame) -> np.ndarray:
    """The counters of all tasks together, COUNTERS of them."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in rows["counts"])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    rows = signed.where("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.spark_partition_id(), F.lit(16)).alias("salt"))
    once = rows.groupBy("chunk", "salt").applyInPandas(lambda x: add(x[["chunk", "counts"]]), "chunk int, counts binary")
    out = np.zeros(COUNTERS, np.int32)
    for r in once.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int32)
    return out


def _listed(docs: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """node, size, prefix (its rarest elements, rarest first), bitmap, and small: the elements of a set of LIMIT at most."""
    known = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.batches_by_bytes(whole, "text", rows=SLICE_ROWS):
                sets = shingles.shingle_sets(batch.column("text"), width)
                size = np.array([len(s) for s in sets], np.int64)
                flat, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                order = np.lexsort((flat, known.value[_slot(flat)], at))
                length = np.where(size > 0, size + 1 - -(-percent * size // 100), 0)
                first = np.cumsum(size) - size
                prefix = flat[order][np.arange(len(flat)) - first[at] < length[at]]
                words = np.minimum(1 << np.ceil(np.log2(np.maximum(size, 1) / A_WORD)).clip(0).astype(np.int64), MOST_WORDS)
                bit = (textscan.mix(flat ^ _SECOND) & (64 * words[at] - 1).astype(_U64)).astype(np.int64)
                opens = (np.cumsum(words) - words) * 64
                odd = np.bincount(opens[at] + bit, minlength=int(words.sum()) * 64).astype(np.uint8) & 1
                few = np.where(size <= LIMIT, size, 0)
                small = np.concatenate([s[:n] for s, n in zip(sets, few.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), _lists(prefix, length), _lists(np.packbits(odd).view(_U64), words), _lists(small, few)], names=["node", "size", "prefix", "bitmap", "small"])

    return docs.mapInArrow(run, "node long, size long, prefix array<long>, bitmap array<long>, small array<long>")


def _bit(nodes: np.ndarray, size: int) -> np.ndarray:
    return (textscan.mix(nodes.view(_U64)) & _U64(size - 1)).astype(np.int64)


def _bits(nodes: DataFrame, size: int) -> np.ndarray:
    """A table of ``size`` bits with those of ``nodes`` set; packed, chunk by chunk."""
    chunk = min(size, 1 << 17)

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(chunk, np.uint8)
        out[rows["bit"].to_numpy() % chunk] = 1
        return pd.DataFrame({"chunk": [int(rows["bit"].iloc[0]) // chunk], "bits": [np.packbits(out).tobytes()]})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(batch.column(0).to_numpy(), size))], names=["bit"])

    placed = nodes.mapInArrow(place, "bit long").distinct()
    out = np.zeros(size // 8, np.uint8)
    for r in placed.groupBy((F.col("bit") / chunk).cast("long").alias("c")).applyInPandas(mark, "chunk long, bits binary").toLocalIterator():
        out[r.chunk * chunk // 8 : (r.chunk + 1) * chunk // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _items(docs: DataFrame, width: int, nodes: DataFrame) -> DataFrame:
    """node and items of the sets of ``nodes``, and of a few more documents that share a bit with one of them."""
    n = nodes.count()
    if n > PICKED:
        docs, known = docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), None
    else:
        size = max(1 << 16, 1 << (16 * n - 1).bit_length())
        known = docs.sparkSession.sparkContext.broadcast(_bits(nodes, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if known is not None:
                at = _bit(whole.column("doc_id").to_numpy(), size)
                whole = whole.filter(pa.array((known.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            for batch in textscan.batches_by_bytes(whole, "text", rows=SLICE_ROWS):
                sets = shingles.shingle_sets(batch.column("text"), width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(np.concatenate(sets), np.array([len(s) for s in sets], np.int64))], names=["node", "items"])

    return docs.mapInArrow(run, "node long, items array<long>")


@functools.lru_cache(maxsize=4096)
def _left_out(size: int, n: int) -> np.ndarray:
    """The ways to leave n of ``size`` elements out, a row each."""
    return np.array(list(itertools.combinations(range(size), n)), np.int64).reshape(math.comb(size, n), n)


def subset_names(items: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of a partner the names (two hashes each) of the subsets that a set shares with it if they are similar."""
    size, one, two = len(items), textscan.mix(items), textscan.mix(items ^ _SECOND)
    for p in partners(size, percent):
        c = shared(size, p, percent)
        if (p, c) != (size, size):
            out = _left_out(size, size - c)
            yield p, one.sum() - one[out].sum(axis=1, dtype=_U64), two.sum() - two[out].sum(axis=1, dtype=_U64)


KEY = ["low", "high", "one", "two"]


def _names(small: DataFrame, percent: int) -> DataFrame:
    """A row for each subset that the sets of ``small`` (node, small) name: KEY, node, and larger where the partner is smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in zip(batch.column("node").to_pylist(), batch.column("small"), strict=True):
                items = items.values.to_numpy().view(_U64)
                for p, one, two in subset_names(items, percent):
                    n = len(one)
                    columns = [np.full(n, node), np.full(n, min(p, len(items))), np.full(n, max(p, len(items))), np.full(n, len(items) > p), one.view(np.int64), two.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "low", "high", "larger", "one", "two"])

    return small.mapInArrow(run, "node long, low long, high long, larger boolean, one long, two long")


def _light_edges(small: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of light sets: stars over the sets that name one subset."""
    names = _names(small, percent)
    least = names.groupBy(KEY).agg(F.min(F.when(~F.col("larger"), F.col("node"))).alias("a"), F.min(F.when(F.col("larger"), F.col("node"))).alias("b"), F.count("*").alias("n"))
    hubs = least.where("n > 1 AND (low = high OR (a IS NOT NULL AND b IS NOT NULL))").select(*KEY, "a", "b")
    hub = F.when((F.col("low") == F.col("high")) | F.col("larger"), F.col("a")).otherwise(F.col("b"))
    return names.join(hubs, KEY).select(F.least("node", hub).alias("u"), F.greatest("node", hub).alias("v")).where("u < v").distinct()


def _light_pairs(small: DataFrame, percent: int) -> DataFrame:
    """All links (u, v) of light sets."""
    names = _names(small, percent)
    others = names.select(*KEY, F.col("node").alias("c_node"), F.col("larger").alias("c_larger"))
    meet = names.join(others, KEY).where("CASE WHEN low = high THEN node < c_node ELSE larger AND NOT c_larger END")
    return meet.select(F.least("node", "c_node").alias("u"), F.greatest("node", "c_node").alias("v")).where("u < v").distinct()


def _size(entry: str) -> Column:
    return F.shiftright(entry, 32)


def _pos(entry: str) -> Column:
    return F.col(entry).bitwiseAND(F.lit((1 << 32) - 1))


def _placed(s: Column, at: Column, t: Column, c_at: Column, percent: int) -> Column:
    """Whether sets of sizes s and t can be similar if this list, where they stand at these places of their own order, is
    the first that they share: they share no more than what follows."""
    fit = 100 * F.least(s, t) >= percent * F.greatest(s, t)
    return fit & ((100 + percent) * F.least(s - at, t - c_at) >= percent * (s + t))


def _apart(a: str, b: str) -> Column:
    """Bits in which two bitmaps differ; the longer one is folded to the shorter one's words, which keeps parities."""
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    words = lambda c: F.shiftright(F.size(c), 1)
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), words(c)), F.slice(c, words(c) + 1, words(c)), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(a) == F.size(b), differ(F.col(a), F.col(b))).when(F.size(a) > F.size(b), differ(half(F.col(a)), F.col(b))).otherwise(differ(F.col(a), half(F.col(b))))


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar, by their sizes and bitmaps: they differ in as many elements as bitmaps do in bits."""
    s, t = F.col(f"{a}size"), F.col(f"{b}size")
    fit = 100 * F.least(s, t) >= percent * F.greatest(s, t)
    ratio = F.size(f"{a}bitmap") / F.size(f"{b}bitmap")
    # with d elements in which they differ, they share (s + t - d) / 2; bitmaps more than one fold apart aren't compared
    apart = F.when(ratio.between(0.5, 2.0), _apart(f"{a}bitmap", f"{b}bitmap")).otherwise(0)
    return F.when(fit, (100 + percent) * (s + t - apart) >= 2 * percent * (s + t)).otherwise(False)


def _scan(held: DataFrame, percent: int, labelled: bool) -> DataFrame:
    """Pairs (u, v) of a list's sets ``held`` (element, node, size, pos, bitmap, label) that can be similar; with ``labelled`` only those of different labels."""
    others = held.select(*[F.col(c).alias(f"c_{c}") for c in held.columns])
    placed = _placed(F.col("size"), F.col("pos"), F.col("c_size"), F.col("c_pos"), percent)
    meet = (F.col("element") == F.col("c_element")) & (F.col("node") < F.col("c_node")) & placed & _possible("", "c_", percent)
    if labelled:
        meet = meet & (F.col("label") != F.col("c_label"))
    return held.join(others, meet).select(F.col("node").alias("u"), F.col("c_node").alias("v")).distinct()


class _Join:
    """What both results start from: classes of equal sets, light edges and the lists of the heavy sets."""

    def __init__(self, docs: DataFrame, width: int, percent: int, doc_id: str, text: str):
        ship(docs.sparkSession)
        self.width, self.percent = width, percent
        self.base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        signed = cut(_signed(self.base, width), "signed")
        rows = signed.where("chunk IS NULL").select("doc_id", "n_shingles", "digest")
        able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        classes = rows.where(able).groupBy(F.col("digest").alias("name")).agg(F.min("doc_id").alias("rep"))
        met = rows.join(classes, F.when(able, F.col("digest")) == F.col("name"), "left")
        self.copies = cut(met.select("doc_id", "n_shingles", "digest", "rep"), "copies")
        # a doc_id of several texts is one node with several sets; equal rows of one doc_id are taken once
        self.repeats = not self.copies.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty()
        self.base = self.base.where("doc_id IS NOT NULL")
        self.listed = cut(self.once(_listed(self.base, width, percent, _counters(signed))), "listed")
        entry = F.shiftleft("size", 32) + F.col("pos")
        placed = self.listed.select("node", "size", F.posexplode("prefix").alias("pos", "element")).select("element", "node", entry.alias("entry"))
        lists = placed.groupBy("element").agg(F.count("*").alias("n"), F.min("entry").alias("low"), F.max("entry").alias("high"))
        lists = lists.where((F.col("n") > 2) | ((F.col("n") == 2) & _placed(_size("low"), _pos("low"), _size("high"), _pos("high"), percent))).select("element")
        reps = self.copies.where("doc_id = rep").select(F.col("doc_id").alias("node")).distinct()
        # of copies only the representative stays; written down before, or all entries would be shuffled by node first
        met = cut(placed.join(lists, "element"), "met")
        members = cut(met.join(reps, "node", "left_semi"), "members").select("element", "node", _size("entry").alias("size"), _pos("entry").alias("pos"))
        self.small = cut(self.listed.where(F.col("size").between(1, LIMIT)).select("node", "size", "small").join(reps, "node", "left_semi"), "small")
        sets = dict(map(tuple, self.small.groupBy("size").agg(F.count("*")).collect()))
        few = members.where(F.col("size") <= LIMIT).select("element", "size").join(members.groupBy("element").agg(F.count("*").alias("n")), "element")
        scanned = dict(map(tuple, few.groupBy("size").agg(F.sum("n")).collect()))
        self.light = boundary(sets, scanned, percent)
        self.members = members.where(F.col("size") >= partners(self.light + 1, percent).start)
        self.light_edges = cut(_light_edges(self.small.where(F.col("size") <= self.light).select("node", "small"), percent), "light")

    def once(self, sets: DataFrame) -> DataFrame:
        return sets.distinct() if self.repeats else sets

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose full sets are similar."""
        pairs = cut(pairs, "pairs")
        nodes = cut(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "wanted")
        sets = cut(self.once(_items(self.base, self.width, nodes)), "items")
        return _confirmed(pairs, sets, self.percent).distinct()

    def held(self, members: DataFrame) -> DataFrame:
        return members.join(self.listed.select("node", "size", "bitmap"), ["node", "size"])


def jaccard_links(docs: DataFrame, width: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All links (u, v) with u < v between representatives of classes of equal sets: the join itself, whose size is that of
    its result. Membership of classes is ``jaccard_components``' matter; nulls and ties are as there."""
    join = _Join(docs, width, percent, doc_id, text)
    heavy = join.held(join.members.select("element", "node", "size", "pos")).withColumn("label", F.lit(0))
    small = join.small.where(F.col("size") <= join.light).select("node", "small")
    return join.confirmed(_scan(heavy, percent, False)).union(_light_pairs(small, percent)).distinct()


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``.

    Rows are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``width``-word shingles, a text of fewer
    words having one shingle, its whole sequence; component_id is the smallest doc_id reachable by links. Null texts and
    texts without words have an empty set and are linked with nothing. Rows that share a doc_id are one node of the link
    graph, and repeated rows are copies of each other. A row whose doc_id is null takes no part: its component_id is null.
    An empty table gives no rows; other columns are ignored. Texts of any length are compared whole.
    """
    join = _Join(docs, width, percent, doc_id, text)
    members, listed = join.members, join.listed
    # first turn: each set and the best connected set of its lists
    nodes = cut(members.groupBy("node").agg(F.count("*").alias("degree")), "nodes")
    ranked = members.join(nodes, "node").select("element", F.struct("degree", (-F.col("node")).alias("node")).alias("rank"))
    centres = ranked.groupBy("element").agg(F.max("rank").alias("centre"))
    star = ranked.join(centres, "element").where("rank < centre").groupBy("rank.node").agg(F.max("centre").alias("c"))
    star = star.select((-F.col("c.node")).alias("u"), (-F.col("node")).alias("v"))
    bits = listed.select("node", "size", "bitmap")
    with_u = star.join(bits.select(F.col("node").alias("u"), F.col("size").alias("u_size"), F.col("bitmap").alias("u_bitmap")), "u")
    with_v = with_u.join(bits.select(F.col("node").alias("v"), F.col("size").alias("v_size"), F.col("bitmap").alias("v_bitmap")), "v")
    labels = _forest_labels(join.confirmed(with_v.where(_possible("u_", "v_", percent)).select("u", "v")))
    # second turn: pairs of different labels
    known = members.select("element", "node", "size", "pos").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("element")
    held = cut(join.held(known.join(mixed, "element")), "mixed")
    pairs = join.confirmed(_scan(held, percent, True))
    # every class of a doc_id that has several, with the least of them
    several = join.copies.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("doc_id", "u")
    same_id = join.copies.join(several, "doc_id").where("rep > u").select("u", F.col("rep").alias("v")).distinct()
    more = cut(pairs.union(join.light_edges).union(same_id), "links")
    out = join.copies.join(labels, join.copies.rep == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("rep"))
    label = F.col("rep")
    if not more.isEmpty():
        u, v = labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        between = more.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        merged = cut(components(between), "merged")
        out, label = out.join(merged, out.rep == merged.node, "left"), F.coalesce("label", "rep")
    return out.select("doc_id", "n_shingles", F.coalesce(label, "doc_id").alias("component_id"))
