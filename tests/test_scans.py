"""Scans along keys against plain loops, with one key that holds nine tenths of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sextant.operators import network, quality, scans


@pytest.fixture(autouse=True)
def _many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _rows():
    rng = random.Random(2)
    keys = ["hot"] * 900 + ["a", "b", None] * 30 + ["one"]
    rng.shuffle(keys)
    return [(k, n, rng.choice([0.0, 0.0, 5.0, 7.5, 20.0, None])) for n, k in enumerate(keys)]


def test_before_and_running(spark):
    rows = _rows()
    laid = scans.laid(spark.createDataFrame(rows, "process string, seq long, latency_ms double").repartition(7), ["process"], ["seq"])
    assert laid.where("process = 'hot'").select("_part").distinct().count() > 1
    out = scans.running(scans.before(laid, ["process"], ["latency_ms", "seq"]), ["process"], {"total": F.coalesce("latency_ms", F.lit(0.0)), "n": F.lit(1)})
    got = {(r.process, r.seq): (r.before_latency_ms, r.before_seq, r.total, r.n) for r in out.collect()}
    want, state = {}, defaultdict(lambda: (None, None, 0.0, 0))
    for k, n, v in rows:
        last, place, total, count = state[k]
        want[k, n] = (last, place, total + (v or 0.0), count + 1)
        state[k] = (v, n, *want[k, n][2:])
    assert got == want


def test_sessions_and_jitter_of_a_hot_key(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "process string, seq long, latency_ms double").repartition(7)
    got = {(r.process, r.first, r.last, r.n, r.resolved) for r in quality.sessions(df, "process", F.col("latency_ms") == 0).collect()}
    want, by = set(), defaultdict(list)
    for k, n, v in rows:
        by[k].append((n, v))
    for k, own in by.items():
        run = []
        for n, v in [*own, (None, 1.0)]:
            if v == 0:
                run.append(n)
            elif run:
                want.add((k, run[0], run[-1], len(run), run[-1] < own[-1][0]))
                run = []
    assert got == want
    jitter = {r.process: r.jitter_ms for r in network.latency_jitter(df.where("process IS NOT NULL")).collect()}
    ok = [v for _, v in by["hot"] if v]
    mean = sum(ok) / len(ok)
    expected = 0.7 * sum(abs(b - a) for a, b in zip(ok, ok[1:], strict=False)) / (len(ok) - 1) + 0.3 * (sum((v - mean) ** 2 for v in ok) / len(ok)) ** 0.5
    assert abs(jitter["hot"] - expected) < 1e-9
    none = df.limit(0)
    assert quality.sessions(none, "process", F.col("latency_ms") == 0).count() == 0 and network.latency_jitter(none).count() == 0
