"""Health scores out of penalties: stations by their reports, sources by their fetch log, networks by their medium.

Penalties are rows of (key, rule, penalty), so rules union and one grouped sum scores them; the weights are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.geo import floor_half

#: What a station loses by rule; "field" for each expected field that its latest report lacks.
STATION_PENALTIES = {"missing": 30, "very_late": 25, "late": 10, "irregular": 15, "field": 5, "offline": 20}
#: What a fetch loses by rule.
FETCH_PENALTIES = {"unreachable": 40, "very_slow": 15, "slow": 5, "half_empty": 20, "incomplete": 10, "duplicates": 10, "out_of_order": 10, "gaps": 15, "unreliable": 15, "odd_payload": 10}
#: Fixed values by medium: largest latency (ms), largest loss (percent), largest latency to be expected (ms).
MEDIA = {"fiber": (30.0, 2.0, 20.0), "copper": (100.0, 5.0, 50.0), "wireless": (150.0, 8.0, 100.0), "unknown": (100.0, 5.0, 100.0)}


def status_of(score: Column, good: int = 80, fair: int = 50) -> Column:
    return F.when(score >= good, "verified").when(score >= fair, "warning").otherwise("failed")


def recent_regularity(reports: DataFrame, last: int = 50) -> DataFrame:
    """max(0, 1 - sd/mean) of the gaps between the ``last`` reports before the latest one; null for fewer than three.

    Only the latest ``last`` + 1 rows of a station leave a task, as Spark limits ranked groups before it shuffles.
    """
    place = F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("seq")))
    recent = reports.select("station_id", "seq", "ts").withColumn("_r", place).where(F.col("_r") <= last + 1).where("_r > 1")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(Window.partitionBy("station_id").orderBy("seq"))
    out = recent.withColumn("gap", gap).groupBy("station_id").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    return out.select("station_id", F.when(F.col("n") >= 3, F.when(F.col("mean") > 0, F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean"))).otherwise(0.0)).alias("regularity"))


def station_penalties(
    stations: DataFrame, reports: DataFrame, as_of: Column, expected_s: Mapping[str, float], expected_fields: Mapping[str, Sequence[str]], misses: DataFrame | None = None, default_s: float = 3600.0, weights: Mapping[str, int] = STATION_PENALTIES
) -> DataFrame:
    """(station_id, rule, penalty) of late, irregular, incomplete and (``misses`` with ``consecutive``) offline stations.

    A station without reports is missing and lacks every field that its source is expected to send; sources without an
    interval take ``default_s``, those without a field list lack nothing. NaN counts as no value.
    """
    fields = sorted({f for names in expected_fields.values() for f in names})
    latest = reports.groupBy("station_id").agg(F.max("ts").alias("last_ts"), F.max_by(F.struct(*fields), "seq").alias("m"))
    interval = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in expected_s.items() for x in (k, float(v))]), F.col("source")), F.lit(default_s))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    lacking = sum(
        ((F.col("source").isin([s for s, names in expected_fields.items() if f in names])) & (F.col(f"m.{f}").isNull() | F.isnan(F.col(f"m.{f}").cast("double")))).cast("int") for f in fields
    )
    base = stations.select(F.col("id").alias("station_id"), "source").join(latest, "station_id", "left").join(recent_regularity(reports), "station_id", "left")
    base = base.join(misses.select("station_id", "consecutive"), "station_id", "left") if misses is not None else base.withColumn("consecutive", F.lit(0))
    liveness = F.when(age.isNull(), "missing").when(age > 2 * interval, "very_late").when(age > interval, "late")
    by_rule = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    found = F.array(
        F.struct(liveness.alias("rule"), F.try_element_at(by_rule, liveness).alias("penalty")),
        F.struct(F.when(F.col("regularity") < 0.4, "irregular").alias("rule"), F.lit(weights["irregular"]).alias("penalty")),
        F.struct(F.when(lacking > 0, "incomplete").alias("rule"), (lacking * weights["field"]).alias("penalty")),
        F.struct(F.when(F.col("consecutive") >= 3, "offline").alias("rule"), F.lit(weights["offline"]).alias("penalty")),
    )
    return base.select("station_id", F.explode(found).alias("p")).where("p.rule IS NOT NULL").select("station_id", "p.rule", F.col("p.penalty").cast("int").alias("penalty"))


def health_scores(stations: DataFrame, penalties: DataFrame) -> DataFrame:
    """100 less all penalties, not below 0, with its status; stations without penalties have 100."""
    total = penalties.groupBy("station_id").agg(F.sum("penalty").alias("penalty"))
    lost = F.coalesce("penalty", F.lit(0).cast("long"))
    out = stations.select(F.col("id").alias("station_id")).join(total, "station_id", "left").select("station_id", lost.alias("penalty"))
    score = F.greatest(F.lit(0).cast("long"), 100 - F.col("penalty"))
    return out.select("*", score.alias("score"), status_of(score).alias("status"))


def fetch_scores(fetches: DataFrame, packets: DataFrame, weights: Mapping[str, int] = FETCH_PENALTIES) -> DataFrame:
    """Each fetch of a source with its checks, score and status.

    ``fetches``: source, fetch_no (its order), latency_ms, payload, received, expected, ok. ``packets``: source, fetch_no,
    station_id, ts. A packet is a duplicate if the source's fetch before held the same station and time, out of order if
    the station's packet before was later; within a fetch a station's packets count in the order of their times. The log
    has a row a fetch, so its running figures are windows by source.
    """
    by = Window.partitionBy("source").orderBy("fetch_no")
    log = fetches.select(
        "*", F.lead("fetch_no").over(by).alias("_next"), F.avg(F.col("ok").cast("double")).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("success"), F.avg("payload").over(by.rowsBetween(-49, 0)).alias("_mean")
    )
    held = packets.select("source", "fetch_no", "station_id", "ts").distinct()
    before = held.join(log.select("source", "fetch_no", "_next"), ["source", "fetch_no"]).select("source", F.col("_next").alias("fetch_no"), "station_id", "ts")
    again = held.join(before, ["source", "fetch_no", "station_id", "ts"], "left_semi").groupBy("source", "fetch_no").agg(F.count("*").alias("duplicates"))
    last = F.lag("ts").over(Window.partitionBy("source", "station_id").orderBy("fetch_no", "ts"))
    back = packets.withColumn("_back", F.col("ts") < last).where("_back").groupBy("source", "fetch_no").agg(F.count("*").alias("out_of_order"))
    zero = F.lit(0).cast("long")
    out = log.join(again, ["source", "fetch_no"], "left").join(back, ["source", "fetch_no"], "left").withColumns({
        "duplicates": F.coalesce("duplicates", zero), "out_of_order": F.coalesce("out_of_order", zero), "gaps": F.greatest(F.lit(0), F.col("expected") - F.col("received")),
        "completeness": F.when(F.col("expected") > 0, 100.0 * F.col("received") / F.col("expected")).otherwise(0.0),
        "deviation": F.when(F.col("_mean") > 0, F.abs(F.col("payload") - F.col("_mean")) / F.col("_mean")).otherwise(0.0),
    })
    w, zero = weights, F.lit(0)
    lost = (
        F.when(~F.col("ok"), w["unreachable"]).otherwise(zero)
        + F.when(F.col("latency_ms") > 5000, w["very_slow"]).when(F.col("latency_ms") > 2000, w["slow"]).otherwise(zero)
        + F.when(F.col("completeness") < 60, w["half_empty"]).when(F.col("completeness") < 90, w["incomplete"]).otherwise(zero)
        + F.when(F.col("duplicates") > 5, w["duplicates"]).otherwise(zero) + F.when(F.col("out_of_order") > 3, w["out_of_order"]).otherwise(zero)
        + F.when(F.col("gaps") > 10, w["gaps"]).otherwise(zero) + F.when(F.col("success") < 0.8, w["unreliable"]).otherwise(zero)
        + F.when(F.col("deviation") > 0.6, w["odd_payload"]).otherwise(zero)
    )
    score = F.greatest(zero, 100 - lost)
    return out.drop("_next", "_mean").select("*", score.alias("score"), status_of(score).alias("status"))


def connectivity(networks: DataFrame, media: Mapping[str, tuple[float, float, float]] = MEDIA) -> DataFrame:
    """Status and score (0 to 100) of rows with medium, local, dns, internet (booleans), latency_ms and loss_pct.

    Each reachable layer is worth 25, latency up to 25 by how far it is beyond the medium's usual one; loss takes its share
    of the medium's largest loss off the whole. Media without a row count as "unknown"; null or 0 latency scores nothing.
    """

    def of(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in media.items() for x in (k, v[i])])
        return F.coalesce(F.try_element_at(table, F.col("medium")), F.lit(media["unknown"][i]))

    def holds(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    latency, loss = F.coalesce("latency_ms", F.lit(0.0)), F.coalesce("loss_pct", F.lit(0.0))
    status = F.when(~holds("local"), "offline").when(~holds("internet") | ~holds("dns"), "critical").when((loss > of(1)) | (latency > of(0)), "degraded").otherwise("healthy")
    speed = F.when(latency == 0, 0).when(latency <= of(2), 25).when(latency <= 2 * of(2), 20).when(latency <= 3 * of(2), 15).when(latency <= 5 * of(2), 10).otherwise(5)
    raw = 25 * (holds("local").cast("int") + holds("dns").cast("int") + holds("internet").cast("int")) + speed
    return networks.select("*", status.alias("status"), floor_half(raw * (1 - F.least(F.lit(1.0), loss / of(1)))).cast("int").alias("score"))
