from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators import network, quality, selection
from sextant.plans.views import view
from sextant.streaming import rules


def _run(stream, name, spark, tmp_path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_outage_sessions_equal_batch(spark, small, tmp_path):
    rows = view(spark, small, "connections").select("process", "seq", (F.col("latency_ms") == 0).alias("bad"), F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in _run(rules.outage_sessions(stream), "sessions_twin", spark, tmp_path).collect()}
    batch = quality.sessions(rows, "process", F.col("bad"))
    want = {(r.process, r["first"], r["last"], r.n) for r in batch.where("resolved").collect()}
    assert got == want and want


def test_windows_equal_batch(spark, small, tmp_path):
    rows = view(spark, small, "connections").select("conn_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {(str(r.start), r.n) for r in _run(rules.traffic_points(stream), "traffic_twin", spark, tmp_path, "complete").collect()}
    assert got == {(str(r.start), r.n) for r in network.traffic(rows).collect()}


def test_without_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert _run(rules.without_repeats(stream, ["id"]), "once", spark, tmp_path).count() == 2


def _stream_of(rows, spark, tmp_path):
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_cooldown_equals_batch(spark, small, tmp_path):
    rows = view(spark, small, "connections").select("process", "seq", F.col("ts").cast("timestamp").alias("ts"))
    got = {(r.process, r.seq) for r in _run(rules.cooldown_alerts(_stream_of(rows, spark, tmp_path), "process", 30000.0), "cooldown_twin", spark, tmp_path).collect()}
    assert got == {(r.process, r.seq) for r in selection.cooldown_alerts(rows, "process", 30000.0).collect()} and got


def test_last_values_equal_window(spark, small, tmp_path):
    rows = view(spark, small, "measurements").select("station_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "water_temp")
    got = {(r.station_id, r.seq): (r.n, round(r["mean"], 6)) for r in _run(rules.last_values(_stream_of(rows, spark, tmp_path), "station_id", "water_temp", 10), "ring_twin", spark, tmp_path).collect()}
    w = Window.partitionBy("station_id").orderBy("seq").rowsBetween(-9, 0)
    want = {(r.station_id, r.seq): (r.n, round(r.m, 6)) for r in rows.select("station_id", "seq", F.count("water_temp").over(w).alias("n"), F.avg("water_temp").over(w).alias("m")).collect()}
    assert got == want


def test_changes_are_against_the_batch_before(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    out = str(tmp_path / "feed")
    publish = rules.publish_changes(ids("a"), out)
    for epoch, batch in enumerate((ids("a", "b"), ids("b", "c"), ids("b", "c"))):
        publish(batch, epoch)
    publish(ids("b", "c"), 1)  # an epoch that runs again
    got = sorted((r.epoch, r.id, r.change) for r in spark.read.parquet(f"{out}/changes").collect())
    assert got == [(0, "b", "added"), (1, "a", "removed"), (1, "c", "added")]


def test_alerts_are_published_once_an_epoch(spark, tmp_path):
    alerts = spark.createDataFrame([("a", "critical"), ("b", "low"), ("c", "high"), (None, "high")], "id string, severity string")
    publish = rules.publish_alerts(spark.createDataFrame([("c",)], "id string"), str(tmp_path / "alerts"), "moderate")
    publish(alerts, 0)
    publish(alerts.limit(0), 1)
    publish(alerts, 0)  # an epoch that runs again
    assert sorted((r.epoch, r.id or "") for r in spark.read.parquet(str(tmp_path / "alerts")).collect()) == [(0, ""), (0, "a")]


def test_influences_of_the_latest_events(spark, tmp_path):
    events = spark.createDataFrame([("e", 0.0, 0.0, 1), ("e", 10.0, 10.0, 2), ("f", None, 0.0, 1)], "id string, lat double, lon double, ts int")
    assets = spark.createDataFrame([("near", 10.1, 10.0), ("old", 0.0, 0.1)], "id string, lat double, lon double")
    rules.publish_influences(assets, str(tmp_path / "met"), 50.0)(events, 7)
    assert [(r.epoch, r.id, r.r_id) for r in spark.read.parquet(str(tmp_path / "met")).collect()] == [(7, "e", "near")]


def test_follow_up(spark):
    asked = selection.FollowUp(limit=3)
    assert asked.ask(spark.range(10)).count() == 3
    first = {r.id for r in asked.rows.collect()}
    assert {r.id for r in asked.then(lambda d: d.where("id >= 0")).collect()} == first
    assert asked.then(lambda d: d.limit(0)).count() == 0
    try:
        selection.FollowUp().then(lambda d: d)
    except ValueError:
        return
    raise AssertionError("a follow-up without a question")
