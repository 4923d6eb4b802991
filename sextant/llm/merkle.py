"""Merkle manifest of a dataset: a hash tree a group, a tree over the groups' roots, proofs, and versions of tampered leaves.

Leaves are digests made by SQL functions (``leaf_digest``). They are numbered within their group by a range partition and
partition counts, so a group of any size spreads over tasks, and dealt into aligned blocks of 2**BITS. A block is reduced in one task;
what remains of the blocks are the leaves of the next, 2**BITS times smaller, tree, until each group has one node; the
groups' roots make a tree in the same way. Only digests are shuffled, texts never.

Trees are persistent. A tampered leaf makes a version by path copying: within its block the ancestors of the leaf are
copied and every other node is shared with the untouched tree; above the block the version goes on along the block's
path, of which there is one for all versions of the block, so versions never gather at the top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.shipping import ship
from sextant.llm.storage import cut

BITS = 10
#: Marks of a path: the sibling stands left or right of the node, or there is none.
LEFT, RIGHT, ALONE = "<", ">", "."


def join_digests(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values, each as its UTF-8 byte count, a colon and the value, or ``-`` where it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def grow(digests: list[str], height: int) -> list[list[str]]:
    """The levels of a tree, the leaves first; a lone last node is hashed alone."""
    levels = [digests]
    for _ in range(height):
        below = levels[-1]
        levels.append([join_digests(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def path_in(levels: list[list[str]], at: int) -> list[str]:
    """The siblings from leaf ``at`` up to the top of its levels, each with its mark."""
    out = []
    for level in levels[:-1]:
        beside = at ^ 1
        out.append(ALONE if beside >= len(level) else (LEFT if beside < at else RIGHT) + level[beside])
        at >>= 1
    return out


def copy_path(levels: list[list[str]], at: int, leaf: str) -> list[str]:
    """A version: the nodes that it does not share with ``levels``, from the new leaf to the new top."""
    copied = [leaf]
    for level in levels[:-1]:
        beside = at ^ 1
        if beside >= len(level):
            copied.append(join_digests(copied[-1]))
        else:
            copied.append(join_digests(level[beside], copied[-1]) if beside < at else join_digests(copied[-1], level[beside]))
        at >>= 1
    return copied


def follow(path: list[str], node: str) -> list[str]:
    """The version's nodes above ``node`` along a path that was made elsewhere."""
    out = []
    for step in path:
        node = join_digests(node) if step == ALONE else join_digests(step[1:], node) if step[0] == LEFT else join_digests(node, step[1:])
        out.append(node)
    return out


def _height(n: int, bits: int) -> int:
    """Levels in a block of a group of ``n`` nodes: all of a block's, or as many as leave a single node."""
    return min(bits, (n - 1).bit_length())


def _numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with their place ``at`` in their group ``grp``, by ``order``, and the group's size ``n``."""
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    laid = cut(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), "laid")
    part = F.shiftright("_row", 33)
    parts = laid.groupBy("grp", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    sums = parts.selectExpr("grp", "_part", "sum(_n) OVER (PARTITION BY grp ORDER BY _part) - _n - _first AS _shift", "sum(_n) OVER (PARTITION BY grp) AS n")
    return laid.withColumn("_part", part).join(sums, ["grp", "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _tops(nodes: DataFrame) -> DataFrame:
    """(grp, at, n, digest) of what remains of each block."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        n = int(block["n"].iloc[0])
        top = grow(block["digest"].tolist(), _height(n, BITS))[-1][0]
        return pd.DataFrame({"grp": block["grp"].iloc[:1], "at": [int(block["at"].iloc[0]) >> BITS], "n": [-(-n >> BITS)], "digest": [top]})

    return nodes.groupBy("grp", F.shiftright("at", BITS)).applyInPandas(run, "grp string, at long, n long, digest string")


def _paths(nodes: DataFrame) -> DataFrame:
    """(grp, at, path) of each node up to the top of its block."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        levels = grow(block["digest"].tolist(), _height(int(block["n"].iloc[0]), BITS))
        return block[["grp", "at"]].assign(path=[path_in(levels, k) for k in range(len(block))])

    return nodes.groupBy("grp", F.shiftright("at", BITS)).applyInPandas(run, "grp string, at long, path array<string>")


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The root (grp, digest) of each group of ``nodes``, and each node's path (grp, at, path) to it; one round a block level."""
    rounds, roots = [], None
    while True:
        tops = cut(_tops(nodes), "tops")
        done = tops.where("n = 1").select("grp", "digest")
        roots = done if roots is None else roots.union(done)
        rounds.append(cut(_paths(nodes), "paths"))
        nodes = tops.where("n > 1")
        if nodes.isEmpty():
            break
    paths = rounds.pop()
    while rounds:
        above = paths.select("grp", F.col("at").alias("_up"), F.col("path").alias("_above"))
        joined = rounds.pop().withColumn("_up", F.shiftright("at", BITS)).join(above, ["grp", "_up"], "left")
        paths = joined.select("grp", "at", F.concat("path", F.coalesce("_above", F.array().cast("array<string>"))).alias("path"))
    return roots, paths


def merkle_manifest(leaves: DataFrame, copies: bool = False) -> DataFrame:
    """The manifest of ``leaves`` (doc_id long, grp string, leaf string, changed string).

    Returns doc_id, leaf, subroot (of its group), root, proof_sha256 (the digest of its siblings from the leaf to the root),
    folded_root (the root that ``changed``, or the leaf where that is null, leads to with the same siblings), verified (it is
    the root), and with ``copies`` the array ``copied`` of the version's own nodes from the leaf to the root, the leaf itself
    where nothing is changed.

    Leaves of a group ascend by doc_id, nulls first, then by leaf, so repeated rows are leaves beside each other and ties give
    the same tree in any run. Groups ascend bytewise, the null group first; a group of one leaf has it as its subroot, a
    single group's subroot is the root. No leaves give no rows. Other columns are ignored.
    """
    ship(leaves.sparkSession)
    grp = F.coalesce(F.concat(F.lit("="), "grp"), F.lit(""))
    base = cut(leaves.select(F.col("doc_id").cast("long").alias("doc_id"), grp.alias("grp"), "leaf", "changed"), "leaves")
    nodes = cut(_numbered(base, "doc_id", "leaf"), "nodes")
    blocks = cut(_tops(nodes.select("grp", "at", "n", F.col("leaf").alias("digest"))), "blocks")
    none = F.array().cast("array<string>")
    tall = blocks.where("n > 1")
    subroots, within = blocks.where("n = 1").select("grp", "digest"), None
    if not tall.isEmpty():
        high, within = _climb(tall)
        subroots = subroots.union(high)
    subroots = cut(subroots, "subroots")
    groups = cut(_numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "name"), "groups")
    top, over = _climb(groups.select("grp", "at", "n", "digest"))
    over = groups.join(over, ["grp", "at"]).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("_over"))
    above = blocks.select("grp", "at")
    above = above.withColumn("path", none) if within is None else above.join(within, ["grp", "at"], "left")
    above = above.join(over, "grp").crossJoin(F.broadcast(top.select(F.col("digest").alias("root"))))
    above = cut(above.select("grp", "at", "subroot", "root", F.concat(F.coalesce("path", none), "_over").alias("path")), "above")
    shown = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", copied array<string>" * copies

    def prove(block: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        levels = grow(block["leaf"].tolist(), _height(int(block["n"].iloc[0]), BITS))
        path, root = list(up["path"].iloc[0]), up["root"].iloc[0]
        paths = [path_in(levels, k) + path for k in range(len(block))]
        proofs = [join_digests(*(step[1:] for step in steps)) for steps in paths]
        versions = list(_versions(levels, block["changed"].tolist(), path))
        folded = [v[-1] if v else follow(steps, leaf)[-1] if steps else leaf for v, steps, leaf in zip(versions, paths, levels[0], strict=True)]
        out = {"doc_id": block["doc_id"].astype("Int64"), "leaf": block["leaf"], "subroot": up["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]}
        if copies:
            out["copied"] = [v or [leaf] for v, leaf in zip(versions, levels[0], strict=True)]
        return pd.DataFrame(out)

    cells = nodes.select("doc_id", "grp", "at", "n", "leaf", "changed").groupBy("grp", F.shiftright("at", BITS).alias("block"))
    return cells.cogroup(above.groupBy("grp", F.col("at").alias("block"))).applyInPandas(prove, shown)


def _versions(levels: list[list[str]], changed: list[str | None], path: list[str]) -> Iterator[list[str]]:
    """For each leaf the nodes of its version, up to the root; none where it isn't changed."""
    for at, leaf in enumerate(changed):
        if leaf is None:
            yield []
        else:
            copied = copy_path(levels, at, leaf)
            yield copied + follow(path, copied[-1])
