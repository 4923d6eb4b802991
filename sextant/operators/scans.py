"""Scans along keys of any size: what came before a row, and running sums, without a key's rows in one task.

Rows are range-partitioned by (key, order), so a key with most of the rows spreads over most partitions. Within a partition windows
do the work; what a partition leaves to the next one of its keys (its last row, its sums) is a row a key and partition, and a
window over those few carries it on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.storage import cut


def laid(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with _part and _at, their place by (key, order); nulls first, ties in any order unless ``order`` breaks them."""
    by = [F.col(c).asc_nulls_first() for c in (*key, *order)]
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "laid")
    return placed.withColumn("_part", F.shiftright("_at", 33))


def _joined(rows: DataFrame, carried: DataFrame, key: Sequence[str]) -> DataFrame:
    names = {c: f"_c{k}" for k, c in enumerate(("_part", *key))}
    on = F.lit(True)
    for c, name in names.items():
        carried = carried.withColumnRenamed(c, name)
        on = on & F.col(c).eqNullSafe(F.col(name))
    return rows.join(carried, on, "left").drop(*names.values())


def before(rows: DataFrame, key: Sequence[str], columns: Sequence[str], prefix: str = "before_") -> DataFrame:
    """``rows`` of ``laid`` with the ``columns`` of the key's row before, null at a key's first."""
    within = Window.partitionBy("_part", *key).orderBy("_at")
    row = F.struct(*columns)
    last = rows.groupBy("_part", *key).agg(F.max_by(row, "_at").alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*key).orderBy("_part"))).select("_part", *key, "_carried")
    out = _joined(rows.withColumn("_own", F.lag(row).over(within)), carried, key).withColumn("_own", F.coalesce("_own", "_carried"))
    return out.select(*rows.columns, *[F.col(f"_own.{c}").alias(f"{prefix}{c}") for c in columns])


def running(rows: DataFrame, key: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` of ``laid`` with sums over the key's rows up to and with each."""
    within = Window.partitionBy("_part", *key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.groupBy("_part", *key).agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("_part", *key, *[F.sum(f"_all_{n}").over(earlier).alias(f"_all_{n}") for n in sums])
    out = _joined(rows.withColumns({f"_own_{n}": F.sum(c).over(within) for n, c in sums.items()}), carried, key)
    total = lambda n: F.when(F.col(f"_own_{n}").isNotNull() | F.col(f"_all_{n}").isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in (F.col(f"_own_{n}"), F.col(f"_all_{n}"))), F.lit(0)))
    return out.select(*rows.columns, *[total(n).alias(n) for n in sums])
