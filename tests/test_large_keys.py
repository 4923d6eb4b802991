"""Cases of the third round's findings: keys beyond 32 bits' products, tables that must not be broadcast, ties."""

import math
import random


from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.geo import haversine_km
from sextant.operators import agreement, assets, corridors, grids, lines, quality, rollups, spatial
from sextant.plans import registry
from sextant.plans.views import view
from sextant.storage import cut
from tests.compare import same_rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows_joined(df):
    """The most rows that a join of the plan gave when it ran."""
    df._jdf.count()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    df._jdf.queryExecution().executedPlan().executeCollect()
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName().endswith("Join"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return most


def test_path_contacts_broadcasts_nothing_and_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.randrange(30), rng.randrange(30)) for _ in range(200)]
    out = assets.path_contacts(spark.createDataFrame(rows, "path int, x long, y long"))
    assert "Broadcast" not in _plan(out)
    met = {(a[0], b[0], a[1:]) for a in rows for b in rows if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < 9}
    want = {}
    for path, other, _ in met:
        want[path, other] = want.get((path, other), 0) + 1
    assert {(r.path, r.other): r.vertices for r in out.collect()} == want


def test_relief_far_south_has_heights(spark, tmp_path):
    keys = [0, 401, 400 * 30_000 + 7, 400 * 90_000 + 399]
    spark.createDataFrame([(k, 1) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.x, r.y): r.v for r in view(spark, str(tmp_path), "relief").collect()}
    want = {}
    for k in keys:
        x, y = k % 400, k // 400
        want[x, y] = abs(x % 60 - 30) + abs(y % 44 - 22) + (x * 7919 + y * 104729) % 13 / 2
    assert got == want


def test_knn_takes_neighbours_by_groups_and_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.0, -0.0, 0.5, 1.0]), rng.choice([179.9, -179.9, 3.0]), rng.choice([1.0, 2.0, None])) for i in range(60)] + [(60, None, 1.0, 1.0), (61, 80.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, depth double")
    gap = F.abs(F.coalesce("depth", F.lit(0.0)) - F.coalesce("r_depth", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("id").orderBy(gap, "distance_km", "r_id"))
    for out, k in ((spatial.knn(df, 100.0, 4, [gap], by=["depth"]), 4), (spatial.knn(df, 100.0, 60, [gap], by=["depth"]), 60)):
        want = spatial.radius_self_join(df, 100.0).withColumn("rank", place).where(F.col("rank") <= k)
        assert sorted(map(str, out.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_knn_meets_groups_not_rows(spark):
    df = spark.range(3000).select("id", F.lit(1.0).alias("lat"), (F.col("id") % 3 / 10.0).alias("lon"))
    out = spatial.knn(df, 500.0, 3)
    assert out.count() == 9000
    # pairs of rows would be nine million; the widest step has the rows and their neighbours
    assert _rows_joined(out) <= 20_000


def test_storm_water_leaves_the_edge_to_plain_subtraction(spark):
    # -6.1 + 16.1 is a hair over ten degrees, -120.5 + 130.5 is ten
    points = spark.createDataFrame([(0.0, -16.1, 5.0), (0.0, -130.5, 7.0), (0.0, 179.5, 9.0)], "lat double, lon double, v double")
    storms = spark.createDataFrame([("a", 0.0, -6.1), ("b", 0.0, -120.5), ("c", 0.0, -170.5)], "id string, lat double, lon double")
    assert {r.id: r.water for r in assets.storm_water(storms, points, "v").collect()} == {"a": 26.0, "b": 7.0, "c": 9.0}


def test_bearing_of_a_hair_west_of_north(spark):
    # beyond the pole the meridian of 160 W is that of 20 E
    df = spark.createDataFrame([(10.0, -160.0), (10.0, 19.0), (60.0, 20.0)], "lat double, lon double")
    over, west, north = [r.bearing for r in spatial.with_bearing(df, 10.0, 20.0).collect()]
    assert over == 360.0 and 270 < west < 271 and north == 0.0


def _greedy(rows, km):
    stay = []
    for i, lat, lon, score in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(_km(lat, lon, a, b) > km for _, a, b, _ in stay):
            stay.append((i, lat, lon, score))
    return {r[0] for r in stay}


def _km(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 12742 * math.asin(min(1.0, math.sqrt(h)))


def test_thinning_equals_going_through_in_order(spark):
    rng = random.Random(3)
    rows = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180), float(rng.randrange(20))) for i in range(150)] + [(500, 90.0, 0.0, 5.0), (501, 89.0, 170.0, 5.0), (502, -90.0, 10.0, 1.0)]
    df = spark.createDataFrame([*rows, (600, None, 1.0, 3.0), (601, 1.0, 1.0, None)], "id long, lat double, lon double, score double")
    assert {r.id for r in rollups.thin(df, 1500.0).collect()} == _greedy(rows, 1500.0) | {600, 601}


def test_thinning_writes_no_pairs_of_rows(spark, monkeypatch):
    sizes = []

    def counted(df, name):
        out = cut(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(rollups, "cut", counted)
    df = spark.range(2000).select("id", F.lit(1.0).alias("lat"), (F.col("id") / 1000.0).alias("lon"), (F.col("id") % 7).cast("double").alias("score"))
    assert rollups.thin(df, 800.0).count() == 1
    assert max(sizes) <= 2000


def test_distance_to_the_nearest_equals_all_pairs(spark):
    rng = random.Random(4)
    places = {(rng.randrange(-20, 300), rng.randrange(280)) for _ in range(80)}
    others = {(rng.randrange(-20, 300), rng.randrange(280)) for _ in range(120)}
    out = corridors._distances(spark.createDataFrame(list(places), "x int, y int"), spark.createDataFrame(list(others), "x int, y int"), 16.7)
    want = {p: min(math.hypot(p[0] - o[0], p[1] - o[1]) for o in others) for p in places}
    assert {(r.x, r.y): round(r.distance, 9) for r in out.collect()} == {p: round(d, 9) for p, d in want.items() if d < 16.7}


def test_samples_are_numbered_without_a_window_over_them(spark):
    cells = spark.createDataFrame([(x, y, float(x * y)) for x in range(5) for y in range(3) if (x, y) != (2, 1)], "x int, y int, v double")
    drawn = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.5, 1.0), (1, 3, 3.5, 1.0), (2, 1, 9.0, 9.0), (3, 1, 2.0, 2.0)], "line_id long, seq long, x double, y double")
    out = lines.sampled_lines(drawn, cells)
    assert "row_number" not in _plan(out)
    got = {(r.line_id, r.sample): (round(r.metres, 6), r.v) for r in out.collect()}
    assert [got[1, k][0] for k in range(5)] == [0.0, 30.0, 60.0, 90.0, round(30 * math.hypot(3.5, 1), 6)]
    assert len(got) == 7 and got[1, 0][1] == 0.0 and got[1, 4][1] == 3.5 and got[2, 0] == (0.0, None) and got[3, 0] == (0.0, 4.0)


def test_paths_never_broadcast_the_pointers(spark, monkeypatch):
    plans = []

    def noted(df, name):
        plans.append(_plan(df))
        return cut(df, name)

    monkeypatch.setattr(corridors, "cut", noted)
    pointers = spark.range(20).select("id", F.lit(0).cast("long").alias("y")).select(F.col("id").alias("x"), "y", (F.col("id") + 1).alias("to_x"), F.col("y").alias("to_y"))
    starts = spark.createDataFrame([(1, 0, 0), (2, 15, 0)], "case long, x long, y long")
    assert corridors.follow(pointers, starts, ["case"]).count() == 21 + 6
    assert not any("Broadcast" in p for p in plans)


def test_links_of_supply_sites_are_dealt_to_all_tasks(spark):
    sites = spark.range(40).select(F.concat(F.lit("as:"), "id").alias("id"), F.lit("substation").alias("type"), (F.col("id") / 100.0).alias("lat"), F.lit(1.0).alias("lon")).coalesce(1)
    out = agreement.asset_links(sites)
    assert out.count() == 40 * 39 // 2 and "REPARTITION_BY_NUM" in _plan(out)


def _crowd(spark, n):
    """Rows at five places, most of them at two that lie near each other."""
    places = [(0.0, 0.0), (0.0, 0.5), (-0.0, 0.5), (1.0, 179.9), (1.0, -179.9), (80.0, 20.0)]
    rows = [(i, *places[i % 2 if i % 10 else i // 10 % 6]) for i in range(n)] + [(n, None, 1.0)]
    return rows[:-1], spark.createDataFrame(rows, "id long, lat double, lon double")


def test_crowded_places_meet_as_one_and_equal_all_pairs(spark):
    rows, df = _crowd(spark, 700)
    out = spatial.radius_self_join(df, 100.0, decimals=6)
    assert _rows_joined(out) < 100  # of 400,000 pairs and more
    km = {(p, q): 12742.0 * math.asin(math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2)) for p in {r[1:] for r in rows} for q in {r[1:] for r in rows}}
    want = sorted((a[0], b[0], round(km[a[1:], b[1:]], 6)) for a in rows for b in rows if a[0] != b[0] and km[a[1:], b[1:]] <= 100)
    assert sorted(tuple(r) for r in out.select("id", "r_id", "distance_km").collect()) == want


def test_crowded_cells_are_dealt_and_lose_no_pair(spark, monkeypatch):
    rows, df = _crowd(spark, 400)
    want = sorted(tuple(r) for r in spatial.radius_self_join(df, 100.0).select("id", "r_id").collect())
    monkeypatch.setattr(spatial, "GATHER", 7)
    monkeypatch.setattr(spatial, "DEAL", 20)
    assert sorted(tuple(r) for r in spatial.radius_self_join(df, 100.0).select("id", "r_id").collect()) == want
    by_row = spatial.radius_join(df, df, F.when(F.col("id") < 200, 100.0).otherwise(1.0), most_km=100.0)
    assert by_row.where("id <> r_id AND id >= 200 AND distance_km > 1").isEmpty() and not by_row.where("id < 200 AND distance_km > 1").isEmpty()


def test_undirected_pairs_are_not_shuffled(spark, small):
    pairs = registry.queries()["u4_undirected_pairs"](spark, small)
    assert pairs.count() == pairs.distinct().count()
    assert _plan(pairs).find("Exchange") > _plan(pairs).find("SortMergeJoin")  # none above the join


def test_rings_close_in_their_blocks_and_equal_those_of_one_block(spark, monkeypatch):
    rng = random.Random(8)
    cells = [(g, x, y, 1.0) for g in (1, 2) for x in range(-9, 24) for y in range(30) if rng.random() < 0.55 or x == 4]
    seen = {}
    ranked = lines.ranked

    def counted(nodes):
        seen["n"] = nodes.count()
        return ranked(nodes)

    monkeypatch.setattr(lines, "ranked", counted)
    # one label a column of blocks' width: rings of many lengths, holes among them
    of = spark.createDataFrame([(g, x, y, float(x // 16)) for g, x, y, _ in cells], "grid_id int, x long, y long, component double")
    out = {}
    for block in (8, 4096):
        out[block] = sorted(tuple(r) for r in lines.zone_outlines(of, block=block).collect())
        seen[block] = seen["n"]
    assert out[8] == out[4096] and out[8]
    whole = lines.zone_outlines(of.where("x >= 0 AND x < 16"), block=32)
    assert whole.count() > 0 and seen["n"] == 0  # nothing is left to rank
    assert seen[8] > 0


def test_drift_of_exactly_two_or_three_deviations_is_decided_as_in_sql(spark, duck):
    series = [
        [20.0, 22.0, 36.0, 24.0, 24.0, 10.0, 4.0, 20.0, 2.0],
        [33.8, 35.0, 35.4, 33.8, 32.2, 37.4],
        [36.2, 33.4, 32.2, 33.8, 35.8, 35.8, 32.2, 31.0],
        [7.0, 7.0, 7.0, 7.0, 4.0, 4.0],
        [999.0, 991.0, 1009.0, 987.0, 1023.0, 997.0, 1025.0],
    ]
    rows = [(f"st:{k}", "f", i, v) for k, values in enumerate(series) for i, v in enumerate(values)]
    long = spark.createDataFrame(rows, "station_id string, field string, seq long, value double")
    oracle = registry.oracle_sql()["v4_drift"]
    given = ", ".join(f"('{s}', '{f}', {i}, {v}::DOUBLE)" for s, f, i, v in rows)
    flags = quality.drift_flags(long).withColumn("z", F.round("z", 6))
    same_rows(flags, duck, f"WITH long(station_id, field, seq, value) AS (VALUES {given}) " + oracle[oracle.index("SELECT station_id, field, seq, 'drift'") :])


def _z(values, value):
    """z of a value against those before it: their plain sum by their number, and Welford's spread in their order."""
    total = mean = spread = 0.0
    for n, x in enumerate(values, 1):
        total, before, mean = total + x, mean, mean + (x - mean) / n
        spread += (x - before) * (x - mean)
    return (value - total / len(values)) / math.sqrt(spread / len(values))


def test_anomalies_of_exactly_two_or_three_deviations_take_the_spread_in_order(spark):
    series = [
        [5.2, 5.2, 5.2, 5.3, 5.2, 5.2, 5.2, 5.2, 5.3, 5.3, 5.1, 5.1, 5.2, 5.2, 5.2, 5.3, 5.4, 5.4, 5.3, 5.3, 5.4],
        [6.2, 5.7, 6.7, 5.8, 5.1, 5.2, 6.0, 5.1, 6.8, 6.9, 5.6, 5.2, 5.8, 6.4, 6.1, 6.7, 6.5, 5.8, 5.2, 6.0, 7.1],
        [5.4, 5.3, 5.2, 5.8, 6.8, 6.9, 5.7, 5.6, 6.1, 5.7, 6.1, 6.3, 6.4, 6.5, 5.7, 5.6, 6.9, 7.0, 6.7, 5.9, 4.4],
        [5.1, 5.3, 5.5, 5.1, 5.2, 5.4, 5.6, 5.5, 5.3, 5.6, 5.4, 5.3, 5.3, 5.2, 5.3, 5.2, 5.6, 5.4, 5.4, 5.3, 5.8],
    ]
    rows = [(f"st:{k}", "f", i, v) for k, values in enumerate(series) for i, v in enumerate(values)]
    long = spark.createDataFrame(rows, "station_id string, field string, seq long, value double").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("seq") * 3600))
    want = {(f"st:{k}", i): z for k, values in enumerate(series) for i in (19, 20) if abs(z := _z(values[:i], values[i])) > 2}
    got = {(r.station_id, r.seq): r for r in quality.anomalies(long).collect()}
    assert {k: r.z for k, r in got.items()} == want
    for key, r in got.items():
        assert r.severity == ["info", "warning", "critical"][(abs(want[key]) > 3) + r.amplified]
    assert sorted(round(z, 6) for (_, i), z in want.items() if i == 20) == [-3.0, 2.0, 3.0]


def test_values_all_of_one_time_have_no_slope_as_in_sql(spark, duck):
    values = [5.1, 5.3, 5.5, 5.1, 5.2, 5.4, 5.6, 5.5, 5.3, 5.6, 5.4, 5.3, 5.3, 5.2, 5.3, 5.2, 5.6, 5.4, 5.4, 7.3, 3.1, 5.5, 9.9]
    # reports of one time, of one time but the last two, of no time but one, of no time
    times = [[0] * 23, [0] * 21 + [5, 9], [None] * 22 + [7], [None] * 23]
    rows = [(f"st:{k}", i, None if t is None else 1_700_000_000 + t * 3600, v) for k, ts in enumerate(times) for i, (t, v) in enumerate(zip(ts, values, strict=True))]
    reports = spark.createDataFrame(rows, "station_id string, seq long, at long, water_temp double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    given = ", ".join(f"('{s}', {i}, make_timestamp({'NULL' if t is None else t * 1_000_000}::BIGINT), {v}::DOUBLE)" for s, i, t, v in rows)
    given = f"WITH measurements(station_id, seq, ts, water_temp) AS (VALUES {given})"
    long = quality.to_long(reports, ["water_temp"])

    slope = quality.trend(long).select("station_id", "seq", F.round("slope_per_day", 3).cast("string").alias("slope"))
    oracle = registry.oracle_sql()["x1_trend"]
    want = duck.execute(f"{given} {oracle[oracle.index('SELECT station_id, seq, round(s, 3)') :]}").fetchall()
    text = lambda x: "none" if x is None else "NaN" if math.isnan(x) else str(x)
    assert sorted((r.station_id, r.seq, r.slope or "none") for r in slope.collect()) == sorted((s, i, text(x)) for s, i, x in want)
    assert {text(x) for s, _, x in want if s == "st:0"} == {"NaN"} and {text(x) for s, _, x in want if s == "st:3"} == {"none"}

    out = quality.anomalies(long).select("station_id", "seq", "slope_per_day", "amplified", "severity", "expected")
    oracle = registry.oracle_sql()["x1_anomalies"]
    want = duck.execute(f"{given}, long AS (SELECT station_id, seq, ts, 'water_temp' AS field, water_temp AS value FROM measurements) {oracle[oracle.index(', t AS (SELECT') :]}")
    names = [d[0] for d in want.description]
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    number = lambda x: text(x if x is None or math.isnan(x) else round(x, 3))
    form = lambda r: (r["station_id"], r["seq"], str(r["amplified"]), r["severity"], number(r["slope_per_day"]), number(r["expected"]))
    assert sorted(form(r.asDict()) for r in out.collect()) == sorted(map(form, want))
    assert len(want) == 12 and {r["amplified"] for r in want if r["station_id"] == "st:0"} == {False}


def test_tables_of_cells_are_never_broadcast_on_the_size_of_their_files(spark, small):
    for name in ("t15_flow_length", "t15_flood_risk", "t9_zones", "t10_class_zones"):
        plan = _plan(registry.queries()[name](spark, small))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
    cells = spark.createDataFrame([(x, y, float((x - 2) ** 2 + (y - 2) ** 2)) for x in range(5) for y in range(5)], "x int, y int, v double")
    assert "Broadcast" not in _plan(grids.pools(cut(grids.fill_depressions(cells), "filled"), 1, 0.0))


def test_profiles_of_stretches_equal_those_of_samples(spark, monkeypatch):
    # lines over many blocks, along their edges, beyond the cells, and back; blocks dealt, stretches and steps cut short
    for name, value in (("_STRETCH", 5), ("_STEP", 16), ("_DEAL", 64)):
        monkeypatch.setattr(lines, name, value)
    rng = random.Random(14)
    cells = [(x, y, rng.random() * 9) for x in range(-8, 30) for y in range(-8, 30) if rng.random() < 0.9 and not 12 <= x < 16]
    cells += [(3, 3, 50.0), (3, 4, float("nan"))]
    at = lambda: rng.choice([-9.0, -8.0, 0.0, 7.0, 8.0, 15.0, 16.0, rng.uniform(-12, 34)])
    drawn = [(n, k, at(), at()) for n in range(12) for k in range(rng.choice([1, 2, 9]))]
    drawn += [(20, 0, 2.0, 2.0), (20, 1, 2.0, 2.0), (21, 0, 99.0, 99.0), (21, 1, 70.0, 99.0), (22, 0, 8.0, -9.0), (22, 1, 8.0, 40.0), (None, 0, 1.0, 1.0), (None, 1, 6.0, 1.0)]
    table = spark.createDataFrame(cells, "x int, y int, v double")
    vertices = spark.createDataFrame(drawn, "line_id long, seq long, x double, y double")
    text = lambda v: v if v is None or isinstance(v, int) else f"{v:.9g}"
    samples = {}
    for block in (8, 256):
        rows = lines.sampled_lines(vertices, table, 21.0, 30.0, block).collect()
        samples[block] = sorted(tuple(map(str, r)) for r in rows)
        assert len(set(r[:2] for r in samples[block])) == len(rows) > 500
    assert samples[8] == samples[256] and any(r[5] == "nan" for r in samples[8]) and any(r[5] == "None" for r in samples[8])
    want = sorted(str([text(v) for v in r]) for r in lines.line_profiles(lines.sampled_lines(vertices, table, 21.0)).collect())
    for block in (8, 256):
        assert sorted(str([text(v) for v in r]) for r in lines.profiled_lines(vertices, table, 21.0, block=block).collect()) == want


def test_profiles_send_no_samples_between_tasks(spark, monkeypatch):
    cells = spark.range(400).select(F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(1.0).alias("v"))
    drawn = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 398.5, 0.5)], "line_id long, seq long, x double, y double")
    seen = []
    monkeypatch.setattr(lines, "cut", lambda df, name: seen.append((name, df.collect())) or cut(df, name))
    out = lines.profiled_lines(drawn, cells, 0.1)
    assert [(r.points, r.length_m, r.lowest, r.ascent) for r in out.collect()] == [(119_401, 11_940.0, 1.0, 0.0)]
    assert seen[0][0] == "crossed" and len(seen[0][1]) == 2
    assert _rows_joined(out) < 1000


def test_crowded_cells_are_dealt_on_both_sides(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, 0.2, 0.4]), rng.choice([0.0, 0.3])) for k in range(300)] + [(k, rng.uniform(-60, 60), rng.uniform(-180, 180)) for k in range(300, 400)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    want = sorted(tuple(r) for r in spatial.radius_join(df, df, 100.0, decimals=6, gather=False).select("id", "r_id").collect())
    monkeypatch.setattr(spatial, "GATHER", 4)
    monkeypatch.setattr(spatial, "DEAL", 16)
    out = spatial.radius_join(df, df, 100.0, decimals=6)
    assert sorted(tuple(r) for r in out.select("id", "r_id").collect()) == want and len(want) > 40_000
    plan = _plan(out)
    joined = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert "_lot#" in joined and "_deal#" in joined
    # the loop over pairs is compiled apart from the join
    assert "Coalesce" in plan[: plan.index("SortMergeJoin")]


def test_far_places_are_told_apart_before_the_distance(spark):
    rng = random.Random(6)
    rows = [(k, round(rng.uniform(-90, 90), 1), round(rng.uniform(-180, 180), 1)) for k in range(60)] + [(60, 90.0, 5.0), (61, -90.0, 7.0), (62, 0.0, 180.0), (63, 0.0, -180.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    out = spatial.radius_join(df, df, 700.0, decimals=6)
    joined = next(line for line in _plan(out).splitlines() if "SortMergeJoin" in line)
    assert 0 < joined.index("_p0#") < joined.index("ASIN")
    every = df.crossJoin(df.toDF("r_id", "r_lat", "r_lon")).select("id", "r_id", haversine_km(*map(F.col, ("lat", "lon", "r_lat", "r_lon"))).alias("km")).collect()
    km = sorted(r.km for r in every)
    # radii of none, of exactly a pair's distance, and beyond half the globe
    for radius in (0.0, km[1500], km[3000], 25_000.0):
        got = {(r.id, r.r_id) for r in spatial.radius_join(df, df, radius).select("id", "r_id").collect()}
        assert got == {(r.id, r.r_id) for r in every if r.km <= radius}
