"""Mixing sources to target weights by pivotal dependent rounding.

Targets: a fixed share of all words is dealt to the sources by weight; a source stops at CAP times its size and what is
over is dealt again by weight. A source's documents then all want target / size copies. Whole copies are given outright;
the fractional rest p of each document enters the rounding, as p times its size in words. Two documents meet, words move
from one to the other, up or down with the odds that keep both expectations, until one of the two has a whole number of
copies; the other goes on. A source's words therefore stay equal to its target up to the one document left at the end,
which takes the nearer whole number.

Documents are dealt to blocks of about BLOCK by the hash of their key, a block is rounded on its own and leaves at most
one unsettled document, and those residuals are blocked and rounded again: a reduction tree of depth log_BLOCK(n), so a
source of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.shipping import ship
from sextant.llm.spark_names import Renamed
from sextant.llm.storage import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) for each source of ``sized`` (source, size, m: that many rows alike).

    Sources in the order of their code points, null last, take ``weights`` in turn. What is over a source's ``cap`` times
    its size is shared by weight among the rest until no target is above its cap.
    """
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut(sizes.withColumn("weight", F.get(table, F.pmod(turn, F.lit(len(weights))))), "sources")
    most = cap * F.col("source_size").cast("double")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    words, weight = share * float(total[0]), float(total[1])
    level, capped = (words / weight if weight else 0.0), -1
    while True:
        row = sources.where(most <= level * F.col("weight")).agg(F.count("*"), F.sum(most), F.sum("weight")).first()
        if row[0] == capped or weight - (row[2] or 0.0) <= 0:
            break
        capped = row[0]
        level = (words - (row[1] or 0.0)) / (weight - (row[2] or 0.0))
    return sources.select("source", "source_size", F.least(most, level * F.col("weight")).alias("target"))


def _uniform(a: int, b: int) -> float:
    """A number in [0, 1) that depends on the two keys only."""
    x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 11) / (1 << 53)


def pivotal(p: Sequence[float], size: Sequence[float], key: Sequence[int]) -> list[float]:
    """Round the probabilities ``p`` so that sum(p * size) is kept; at most one of the results is not 0 or 1."""
    out, i = [float(x) for x in p], -1
    for j in range(len(out)):
        if not 0 < out[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        si, sj = size[i], size[j]
        up_i, down_i = (1 - out[i]) * si, out[i] * si
        up_j, down_j = (1 - out[j]) * sj, out[j] * sj
        to_i, to_j = min(up_i, down_j), min(down_i, up_j)
        if _uniform(key[i], key[j]) * (to_i + to_j) < to_j:
            out[i], out[j] = out[i] + to_i / si, out[j] - to_i / sj
            full_i, full_j = to_i == up_i, to_i == down_j
            out[i], out[j] = (1.0 if full_i else out[i]), (0.0 if full_j else out[j])
        else:
            out[i], out[j] = out[i] - to_j / si, out[j] + to_j / sj
            full_i, full_j = to_j == down_i, to_j == up_j
            out[i], out[j] = (0.0 if full_i else out[i]), (1.0 if full_j else out[j])
        if full_i:
            i = -1 if full_j else j
    return out


def _round_block(block: pd.DataFrame) -> pd.DataFrame:
    # longest first: the one left at the end then tends to be short, and so the words by which the target is missed few
    block = block.sort_values(["size", "key", "doc_id", "p"], ascending=[False, True, True, True], kind="stable")
    keys = [int(x) & 0xFFFFFFFFFFFFFFFF for x in block["key"]]
    return block.assign(p=np.array(pivotal(block["p"].tolist(), block["size"].astype(float).tolist(), keys)))


def mixing_units(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, rid, size, m): a row for each distinct (doc_id, source, text), m rows of ``docs`` being alike."""
    d, s, t = (F.col(f"`{c}`") for c in (doc_id, source, text))
    rows = docs.select(d.alias("doc_id"), s.alias("source"), F.xxhash64(d, s, t).alias("rid"), n_words(t).alias("size"))
    return rows.groupBy("doc_id", "source", "rid", "size").agg(F.count("*").alias("m"))


def mixing_plan(units: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``units`` with source_size, target and copies (all m rows of a unit together). Reruns give the same copies.

    Units without words settle by their hash alone. Null sources are one source, the last. Empty input, empty output.
    """
    spark = units.sparkSession
    ship(spark)
    units = cut(units, "units")
    targets = source_targets(units, weights, share, cap)
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    targets = cut(targets.join(counts, targets.source.eqNullSafe(counts.source)).select(targets.source.alias("_source"), "source_size", "target", "n"), "targets")
    want = F.col("m") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.xxhash64("rid", "doc_id", F.lit(20))
    wanted = units.join(targets, units.source.eqNullSafe(F.col("_source"))).withColumn("want", want).withColumn("whole", F.floor("want")).withColumn("key", key)
    chance = F.shiftrightunsigned(F.col("key"), 11) / F.lit(float(1 << 53))
    wordless = (F.col("size") == 0) & (chance < F.col("want") - F.col("whole"))
    wanted = cut(wanted.withColumn("whole", F.col("whole") + wordless.cast("long")).withColumn("p", F.when(F.col("size") > 0, F.col("want") - F.floor("want")).otherwise(0.0)), "wanted")
    names = ["_source", "doc_id", "rid", "key", "size", "p", "n"]
    todo, settled = wanted.where("p > 0").select(*names), None
    schema = todo.schema
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
        level = cut(todo.groupBy("_source", F.pmod(F.col("key"), blocks).alias("_block")).applyInPandas(_round_block, schema), "level")
        done, left = level.where("p = 0 OR p = 1"), level.where("p > 0 AND p < 1")
        settled = done if settled is None else settled.union(done)
        per_source = left.groupBy("_source").agg(F.count("*").alias("n"))
        if per_source.where("n > 1").isEmpty():
            break
        per_source = per_source.withColumnRenamed("_source", "_s")
        # another hash for the next level, or residuals of one block would meet the same ones again
        todo = left.drop("n").join(per_source, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("key", F.xxhash64("key")).select(*names)
    last = left.withColumn("p", F.floor(F.col("p") + 0.5).cast("double"))
    bonus = settled.union(last).where("p = 1").select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), F.lit(1).alias("bonus"))
    out = wanted.join(bonus, wanted.doc_id.eqNullSafe(F.col("_id")) & (wanted.rid == F.col("_rid")), "left")
    return out.select("doc_id", "source", "rid", "size", "m", "source_size", "target", (F.col("whole") + F.coalesce("bonus", F.lit(0))).cast("long").alias("copies"))


def mixed_counts(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) for each row of ``docs``.

    Rows alike in doc_id, source and text share their copies as evenly as whole numbers allow. A null text has size 0.
    """
    plan = mixing_plan(mixing_units(docs), weights, share, cap)
    each = plan.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.floor(F.col("copies") / F.col("m")) + (F.col("_k") <= F.pmod(F.col("copies"), F.col("m"))).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of the mix: each document as many times as the plan says, none where it says 0, in ``docs``'s columns.

    Rows alike in doc_id, source and text are one document whose copies are theirs together.
    """
    own = Renamed(docs)
    plan = mixing_plan(mixing_units(docs), weights, share, cap).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("rid").alias("p_rid"), F.col("copies").cast("int").alias("copies"))
    keyed = own.df.withColumn("rid", F.xxhash64(own["doc_id"], own["source"], own["text"]))
    met = keyed.join(plan, (F.col("rid") == F.col("p_rid")) & own["doc_id"].eqNullSafe(F.col("p_id")))
    # a unit's copies are those of all its like rows together
    each = met.dropDuplicates(["rid", "p_id"]).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return each.select(*own.back())
