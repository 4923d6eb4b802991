"""Connection telemetry: identity, endpoint quality, process and address statistics, quality map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators import scans

PRIVATE = r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|::1$|fe80:|f[cd][0-9a-f]{2}:)"


def is_private_ip(ip: Column) -> Column:
    return F.lower(ip).rlike(PRIVATE)


def connection_states(rows: DataFrame) -> DataFrame:
    """First and last sight, rows and latest state of each connection."""
    return rows.groupBy("conn_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"), F.max_by("state", "seq").alias("state"))


def network_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.sum((F.col("state") == "Established").cast("long")).alias("established"),
        F.countDistinct("remote_ip").alias("ips"), F.countDistinct(F.when(~is_private_ip(F.col("remote_ip")), F.col("remote_ip"))).alias("public_ips"),
    )


def top_processes(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.groupBy("process").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "process").limit(k)


def endpoint_quality(rows: DataFrame, last: int = 10) -> DataFrame:
    """Of each remote address's last rows: mean latency of answered probes, loss in percent, and a banded score."""
    place = F.row_number().over(Window.partitionBy("remote_ip").orderBy(F.desc("seq")))
    recent = rows.withColumn("_r", place).where(F.col("_r") <= last)
    out = recent.groupBy("remote_ip").agg(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("latency_ms"), (F.avg((F.col("latency_ms") == 0).cast("double")) * 100).alias("loss_pct"))
    slow = F.when(F.col("latency_ms").isNull(), 60).when(F.col("latency_ms") > 200, 40).when(F.col("latency_ms") > 100, 20).when(F.col("latency_ms") > 50, 10).otherwise(0)
    lossy = F.when(F.col("loss_pct") > 10, 40).when(F.col("loss_pct") > 2, 20).when(F.col("loss_pct") > 0, 5).otherwise(0)
    return out.withColumn("score", F.greatest(F.lit(0), 100 - slow - lossy))


def latency_jitter(rows: DataFrame, key: str = "process") -> DataFrame:
    """Mean latency, loss and jitter (0.7 mean absolute difference + 0.3 deviation) of each key's answered probes. A key's
    probes are scanned partition by partition, however many there are."""
    ok = scans.before(scans.laid(rows.where("latency_ms > 0").select(key, "seq", "latency_ms"), [key], ["seq", "latency_ms"]), [key], ["latency_ms"])
    ok = ok.withColumn("_d", F.abs(F.col("latency_ms") - F.col("before_latency_ms")))
    stats = ok.groupBy(key).agg(F.avg("latency_ms").alias("latency_ms"), (0.7 * F.avg("_d") + 0.3 * F.stddev_pop("latency_ms")).alias("jitter_ms"))
    loss = rows.groupBy(key).agg((F.avg((F.col("latency_ms") == 0).cast("double")) * 100).alias("loss_pct"))
    return loss.join(stats, key, "left")


def traffic(rows: DataFrame, every: str = "1 day") -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), every)
    out = rows.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.countDistinct("conn_id").alias("connections"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "connections")


def quality_map(quality: DataFrame) -> DataFrame:
    """Scores by the address's octets: x and y are the sums of the first and the last two, modulo 100."""
    o = F.transform(F.split("remote_ip", r"\."), lambda p: p.cast("int"))
    return quality.select("remote_ip", F.pmod(o[0] + o[1], F.lit(100)).alias("x"), F.pmod(o[2] + o[3], F.lit(100)).alias("y"), "score")
