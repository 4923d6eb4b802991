"""Stateful rules over shuffled arrivals and a restart, against plain loops."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from sextant.streaming import state

START = datetime(2024, 1, 1)
SCHEMA = "process string, seq long, ts timestamp, bad boolean"


@pytest.fixture(autouse=True)
def _store(spark):
    state.needs_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out, at = [], 0
    for n in range(240):
        at += rng.choice([20, 60, 300, 900])
        out.append((rng.choice(["a", "a", "b"]), n, START + timedelta(seconds=at), rng.random() < 0.7))
    return out


def _files(spark, rows, folder, names, seed=0):
    """A file for each of ``names``, each shuffled within itself; Spark reads one a batch, the oldest first."""
    rng, size = random.Random(seed), -(-len(rows) // len(names))
    for k, name in enumerate(names):
        part = rows[k * size : (k + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def _drain(spark, make, folder, out, mode="append"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    write = make(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    q = write.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")).start()
    assert q.awaitTermination(240)
    return spark.read.parquet(f"{out}/rows")


def test_recent_counts_after_a_restart(spark, rows, tmp_path):
    last = [("z", 10**6, START + timedelta(days=9), False)]
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    make = lambda s: state.recent_counts(s, "process", "30 minutes", "2 hours")
    _files(spark, rows[:120], folder, ["1", "2"])
    _drain(spark, make, folder, out)
    _files(spark, rows[120:], folder, ["3", "4"])
    _files(spark, last, folder, ["5"])
    got = {(r.key, r.seq): r.held for r in _drain(spark, make, folder, out).collect()}
    want = {(p, n): sum(q == p and t - timedelta(minutes=30) < u <= t and (u, m) <= (t, n) for q, m, u, _ in rows) for p, n, t, _ in rows}
    assert got == want


def test_quiet_sessions(spark, rows, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    _files(spark, rows, folder, ["1", "2", "3"])
    _files(spark, [("z", 10**6, START + timedelta(days=9), False)], folder, ["4"])
    got = Counter(tuple(r) for r in _drain(spark, lambda s: state.quiet_sessions(s, "process", quiet="12 minutes", late="2 hours"), folder, out).select("key", "first", "last", "n", "ended_by").collect())
    want, by = Counter(), defaultdict(list)
    for p, n, t, bad in rows:
        by[p].append((n, t, bad))
    for p, own in by.items():
        run = []
        for n, t, bad in [*own, (None, START + timedelta(days=9), False)]:
            if run and (t - run[-1][1] >= timedelta(minutes=12) or not bad):
                want[p, run[0][0], run[-1][0], len(run), "quiet" if t - run[-1][1] >= timedelta(minutes=12) else "good"] += 1
                run = []
            if bad:
                run.append((n, t))
    assert got == want and {k[4] for k in want} == {"quiet", "good"}


def test_arrival_counts(spark, rows, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    _files(spark, [*rows[:60], *rows[:20], rows[3]], folder, ["1", "2", "3"])
    last = _drain(spark, lambda s: state.arrival_counts(s, "process", "seq", "9 days", "9 days"), folder, out, "update").groupBy("key").agg({"n": "max", "repeated": "max", "backward": "max"}).collect()
    sent = [*rows[:60], *rows[:20], rows[3]]
    for key in ("a", "b"):
        own = [r for r in sent if r[0] == key]
        (got,) = [r for r in last if r.key == key]
        assert (got["max(n)"], got["max(repeated)"]) == (len(own), len(own) - len({r[1] for r in own}))
        assert 0 < got["max(backward)"] < len(own)
