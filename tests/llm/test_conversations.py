"""Conversation repair against a search over all edits, whole and stretch by stretch, and its edge cases."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import auditpaths, conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\t\n\x0b\x0c\r"


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def _search(kinds, rows):
    """(cost, audit, lines) of the cheapest and then least audit, by Dijkstra over (row, initials so far)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, lines
        state = (at, re.sub("(ua)+$", "ua", initials), len(initials) > 3)
        if state in seen or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        seen.add(state)
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, initials + r[0], (*lines, f"{r}:")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, initials, lines))
            if kinds[at] in ("", "truncated"):
                more = 3 * (kinds[at] == "truncated")
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + role[0], (*lines, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, initials + r[0], (*lines, f"{r}:{text}")))


def _brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds, seen = [], set()
        for r in own:
            bare = r[3].strip(SPACE)
            kinds.append("blank" if not bare else "duplicate" if r[2:] in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add(r[2:])
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = _search(kinds, own)
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _rows(rng, convs=60, most=9):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Hello.", "Why?", "cut off", "Yes!  ", " \t", "", None, "Hello.", "a. b", f"n{rng.randrange(9)}."])
            rows.append((c if c else None, rng.choice([t, t, t + 2, None if rng.random() < 0.3 else t]), role, text))
    return rows


def _got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", *conversations.COUNTS, "audit", "repaired_sha256").collect()}


def _plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rows = _rows(random.Random(seed))
    assert _got(conversations.Repair(spark.createDataFrame(rows, SCHEMA)).digests()) == _brute(_plain(rows))


def test_stretch_by_stretch_equals_whole(spark, monkeypatch):
    rng = random.Random(3)
    rows = _rows(rng, 12, 30)
    rows += rows[:7] + [(5, 3, "user", "Same.")] * 6 + [(6, 1, "user", " ")] * 5
    monkeypatch.setattr(conversations, "ROWS_WHOLE", 4)
    monkeypatch.setattr(conversations, "STRETCH", 2)
    repair = conversations.Repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got, want = _got(repair.digests()), _brute(_plain(rows))
    assert got == want
    turns = repair.turns().where("edit <> 'D'").orderBy("part", "step").collect()
    for conv, expected in want.items():
        lines = "\n".join(f"{t.role}:{t.text}" for t in turns if t.conv_id == conv)
        assert hashlib.sha256(lines.encode()).hexdigest() == expected[-1]


def test_damage_and_query(spark, tmp_path):
    rows = _rows(random.Random(4), 150)
    spark.createDataFrame(rows, SCHEMA).withColumn("cost", F.lit(1)).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = _got(queries.op11_conversation_repair(spark, f"file://{tmp_path}"))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: empty for c, *_ in rows} | _brute(_damage(rows))


def test_edges(spark):
    none = conversations.Repair(spark.createDataFrame([], SCHEMA))
    assert none.digests().count() == 0 and none.turns().count() == 0
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "x" * 3_000_000 + "."), (2, None, "s", "A."), (2, None, "s", "A.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("mine")).withColumn("edit", F.lit(0))
    assert _got(conversations.Repair(df).digests()) == _brute(rows)


def test_ranks_order_audits_and_long_sequences_stay_cheap():
    rng = np.random.default_rng(1)
    n = 5000
    rows = auditpaths.Rows(rng.integers(0, 4, n), rng.integers(0, 3, n), rng.integers(0, 2, n), np.array([0, 10, 10, n]))
    paths = auditpaths.Paths(rows, np.tile(auditpaths.AT_END, (3, 1)))
    at, node, state = paths.follow(np.zeros(3, np.int64))
    assert (np.diff(at) >= 0).all() and set(at.tolist()) == {0, 2} and len(node) >= n
    paid = np.where(paths.letter[node] == auditpaths.I, 3, 4 * rows.extra[node // 4] + np.array([4, 3, 0, 3])[paths.letter[node]] + 3 * ((rows.kind[node // 4] == 2) & (paths.letter[node] >= auditpaths.K)))
    assert np.bincount(at, paid, 3).astype(int).tolist() == (paths.value[paths.start] - auditpaths.AT_END[state]).tolist()
