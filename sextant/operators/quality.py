"""Sensor-integrity rules in long form: (station_id, field, seq, ts, value) rows, windows over them, and flags.

Every rule gives rows of (station_id, field, seq, rule, severity, ...), so rules union and one grouped sum scores them.
Windows are bounded (rows between) and keyed by station and field, so state per key stays small however long a series is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators import scans

#: Plausible physical ranges of the fields.
BOUNDS = {"water_temp": (-2.5, 40.0), "air_temp": (-60.0, 60.0), "salinity": (0.0, 42.0), "pressure": (850.0, 1100.0), "wind_speed": (0.0, 100.0), "wave_height": (0.0, 30.0)}
#: Largest plausible change from one report to the next.
MAX_STEP = {"water_temp": 5.0, "air_temp": 15.0, "salinity": 5.0, "pressure": 20.0, "wind_speed": 30.0, "wave_height": 8.0}


def to_long(measurements: DataFrame, fields: Sequence[str]) -> DataFrame:
    stacked = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in fields)
    return measurements.selectExpr("station_id", "seq", "ts", f"stack({len(fields)}, {stacked}) AS (field, value)").where("value IS NOT NULL")


def _series() -> Window:
    return Window.partitionBy("station_id", "field").orderBy("seq")


def _table(values: Mapping[str, float | tuple[float, float]]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.struct(*[F.lit(float(y)) for y in v]) if isinstance(v, tuple) else F.lit(float(v)))])


def bounds_flags(long: DataFrame, bounds: Mapping[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """Values outside their physical range."""
    low = F.create_map(*[x for k, v in bounds.items() for x in (F.lit(k), F.lit(float(v[0])))])
    high = F.create_map(*[x for k, v in bounds.items() for x in (F.lit(k), F.lit(float(v[1])))])
    out = (F.col("value") < low[F.col("field")]) | (F.col("value") > high[F.col("field")])
    return long.where(out).select("station_id", "field", "seq", F.lit("bounds").alias("rule"), F.lit("critical").alias("severity"), "value")


def jump_flags(long: DataFrame, steps: Mapping[str, float] = MAX_STEP) -> DataFrame:
    """Changes since the previous report above the largest plausible one; twice as much is critical."""
    step = _table(steps)[F.col("field")]
    change = F.abs(F.col("value") - F.lag("value").over(_series()))
    return long.withColumn("change", change).where(F.col("change") > step).select("station_id", "field", "seq", F.lit("jump").alias("rule"), F.when(F.col("change") > 2 * step, "critical").otherwise("warning").alias("severity"), "change")


def field_drops(reports: DataFrame, fields: Sequence[str], most: int = 2) -> DataFrame:
    """Reports that hold over ``most`` fields fewer than their station's report before: a sensor may be failing."""
    held = sum((F.col(c).isNotNull().cast("long") for c in fields), F.lit(0).cast("long"))
    before = F.lag("held").over(Window.partitionBy("station_id").orderBy("seq"))
    rows = reports.select("station_id", "seq", held.alias("held")).withColumn("before", before)
    return rows.where(F.col("before") - F.col("held") > most).select("station_id", "seq", F.lit("field_drop").alias("rule"), F.lit("warning").alias("severity"), "before", "held")


def cycle_jumps(long: DataFrame, steps: Mapping[str, float] = MAX_STEP, cycle: str = "cycle") -> DataFrame:
    """``jump_flags`` between reports of successive cycles only: after a missed cycle a change is no jump."""
    step = _table(steps)[F.col("field")]
    w = Window.partitionBy("station_id", "field").orderBy(cycle, "seq")
    change = F.when(F.col(cycle) == F.lag(cycle).over(w) + 1, F.abs(F.col("value") - F.lag("value").over(w)))
    severity = F.when(F.col("change") > 2 * step, "critical").otherwise("warning").alias("severity")
    return long.withColumn("change", change).where(F.col("change") > step).select("station_id", "field", "seq", F.lit("jump").alias("rule"), severity, "change")


def drift(long: DataFrame, least: int = 5, before: int = 100) -> DataFrame:
    """z-score of each value against up to ``before`` earlier ones of its series (population spread)."""
    return _scored(_with_base(long, before), least)


def _with_base(long: DataFrame, before: int) -> DataFrame:
    w = _series().rowsBetween(-before, -1)
    # a z of exactly 2 or 3 hangs on the last bit: covar_pop adds (x - old mean) * (x - new mean), as stddev_pop of the SQL does and Spark's does not
    return long.select("*", F.avg("value").over(w).alias("mean"), F.sqrt(F.covar_pop("value", "value").over(w)).alias("sd"), F.count("value").over(w).alias("n"))


def _scored(based: DataFrame, least: int) -> DataFrame:
    return based.where((F.col("n") >= least) & (F.col("sd") > 0)).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd"))


def drift_flags(long: DataFrame, warn: float = 2.0, critical: float = 3.0) -> DataFrame:
    z = F.abs(F.col("z"))
    return drift(long).where(z > warn).select("station_id", "field", "seq", F.lit("drift").alias("rule"), F.when(z > critical, "critical").otherwise("warning").alias("severity"), "z")


def stuck_flags(long: DataFrame, n: int = 3, tolerance: float = 0.01) -> DataFrame:
    """The last ``n`` values nonzero and within ``tolerance`` of the first of them."""
    w = _series().rowsBetween(-(n - 1), 0)
    spread = F.greatest(F.max("value").over(w) - F.first("value").over(w), F.first("value").over(w) - F.min("value").over(w))
    seen = long.select("*", spread.alias("spread"), F.count("value").over(w).alias("n"), F.min(F.abs("value")).over(w).alias("least"))
    return seen.where((F.col("n") == n) & (F.col("spread") <= tolerance) & (F.col("least") > 0)).select("station_id", "field", "seq", F.lit("stuck").alias("rule"), F.lit("warning").alias("severity"), "spread")


def regularity(measurements: DataFrame) -> DataFrame:
    """max(0, 1 - sd/mean) of the gaps between a station's reports; null below three gaps."""
    by_time = Window.partitionBy("station_id").orderBy("seq")
    gaps = measurements.select("station_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by_time).cast("timestamp"))).alias("gap")).where("gap IS NOT NULL")
    out = gaps.groupBy("station_id").agg(F.count("*").alias("gaps"), F.avg(F.col("gap") / 1e6).alias("mean_gap"), F.stddev_pop(F.col("gap") / 1e6).alias("sd_gap"))
    return out.withColumn("regularity", F.when((F.col("gaps") >= 3) & (F.col("mean_gap") > 0), F.greatest(F.lit(0.0), 1 - F.col("sd_gap") / F.col("mean_gap"))))


def liveness(stations: DataFrame, measurements: DataFrame, as_of: Column, expected: Mapping[str, float], default: float = 3600.0) -> DataFrame:
    """Age of each station's last report against its source's expected interval: on_time, late, very_late or missing."""
    last = measurements.groupBy("station_id").agg(F.max("ts").alias("last_ts"))
    interval = F.coalesce(F.try_element_at(_table(expected), F.col("source")), F.lit(default))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    out = stations.join(last, stations.id == last.station_id, "left").select("id", "source", age.alias("age_s"), interval.alias("expected_s"))
    state = F.when(F.col("age_s").isNull(), "missing").when(F.col("age_s") > 2 * F.col("expected_s"), "very_late").when(F.col("age_s") > F.col("expected_s"), "late").otherwise("on_time")
    return out.withColumn("status", state)


def completeness(measurements: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Which of ``fields`` a station's latest report holds."""
    latest = measurements.groupBy("station_id").agg(F.max_by(F.struct(*fields), "seq").alias("m"))
    present = sum((F.col(f"m.{f}").isNotNull().cast("int") for f in fields), F.lit(0))
    return latest.select("station_id", present.alias("present"), (F.lit(len(fields)) - present).alias("absent"))


def score_flags(stations: DataFrame, flags: DataFrame, critical: int = 25, warning: int = 10) -> DataFrame:
    """100 less 25 a critical and 10 a warning, not below 0, and the worst severity; stations without flags have 100."""
    n = flags.groupBy("station_id").agg(F.sum((F.col("severity") == "critical").cast("long")).alias("criticals"), F.sum((F.col("severity") == "warning").cast("long")).alias("warnings"))
    c, w = F.coalesce("criticals", F.lit(0)), F.coalesce("warnings", F.lit(0))
    out = stations.select(F.col("id").alias("station_id")).join(n, "station_id", "left")
    worst = F.when(c > 0, "critical").when(w > 0, "warning").otherwise("valid")
    return out.select("station_id", c.alias("criticals"), w.alias("warnings"), F.greatest(F.lit(0), 100 - critical * c - warning * w).alias("score"), worst.alias("status"))


def band_outliers(latest: DataFrame, field: str, width: float = 10.0, least: int = 5, limit: float = 3.0) -> DataFrame:
    """Latest values beyond ``limit`` deviations of their latitude band, for bands of ``least`` stations and some spread."""
    placed = latest.withColumn("band", F.floor(F.col("lat") / width) * width).select("station_id", "band", F.col(field).alias("value"))
    # a few bands hold all rows, so their sums are joined back rather than their rows gathered
    bands = placed.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n")).where((F.col("n") >= least) & (F.col("sd") >= 0.1))
    out = placed.join(bands, "band").select("station_id", "band", "value", "mean", "sd", "n")
    return out.withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd")).where(F.abs("z") > limit)


def sessions(events: DataFrame, key: str, bad: Column, order: str = "seq") -> DataFrame:
    """Stretches of consecutive bad rows of a key: first and last place, rows, and whether it has ended since. A key's rows
    are scanned partition by partition, however many there are; of equal places the bad row comes last."""
    marked = scans.laid(events.select(key, order, F.coalesce(bad, F.lit(False)).alias("_bad")), [key], [order, "_bad"])
    opens = F.col("_bad") & ~F.coalesce("before__bad", F.lit(False))
    numbered = scans.running(scans.before(marked, [key], ["_bad"]), [key], {"_n": opens.cast("int")})
    out = numbered.where("_bad").groupBy(key, "_n").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    ends = marked.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_last"))
    return out.join(ends, F.col(key).eqNullSafe(F.col("_key"))).select(key, "first", "last", "n", (F.col("last") < F.col("_last")).alias("resolved"))


def trend(long: DataFrame, n: int = 20) -> DataFrame:
    """Least-squares change per day over the last ``n`` values up to each row, for rows that have ``n``; NaN where all are of one time."""
    return _with_trend(long, n).where(F.col("_n") == n).drop("_n")


def _with_trend(long: DataFrame, n: int) -> DataFrame:
    w = _series().rowsBetween(-(n - 1), 0)
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400e6 - 19700
    # values all of one time have no slope: NaN as in the SQL's regr_slope, where Spark's gives null; null is left to rows without any time
    flat = F.when(F.regr_count(F.col("value"), day).over(w) > 0, F.lit(float("nan")))
    return long.select("*", F.coalesce(F.regr_slope(F.col("value"), day).over(w), flat).alias("slope_per_day"), F.count("*").over(w).alias("_n"))


def anomalies(long: DataFrame, n: int = 20, before: int = 100, warn: float = 2.0, critical: float = 3.0, horizon_days: float = 1.0) -> DataFrame:
    """z-score of each value against up to ``before`` earlier ones of its series, with the trend of the last ``n``.

    amplified: the trend goes the way the value has left its base; false where values of one time have none (NaN). confidence: the
    share of ``before`` earlier values there are. expected: the value carried on by the trend for ``horizon_days``. Rows below ``warn`` deviations are left out.
    """
    z = F.abs(F.col("z"))
    scored = _scored(_with_base(_with_trend(long, n), before), 5).where((F.col("_n") == n) & (z > warn))
    amplified = F.signum("slope_per_day") == F.signum("z")
    severity = F.when((z > critical) & amplified, "critical").when((z > critical) | amplified, "warning").otherwise("info")
    return scored.select("station_id", "field", "seq", "value", "z", "slope_per_day", amplified.alias("amplified"), severity.alias("severity"), (F.col("n") / float(before)).alias("confidence"), (F.col("value") + F.col("slope_per_day") * horizon_days).alias("expected"))
