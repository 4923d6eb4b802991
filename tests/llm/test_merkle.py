"""The Merkle manifest against a plain tree, its versions, and its edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sextant.llm import merkle, queries
from tests.llm.test_operators import DOCS, docs_of


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def _path(levels, at):
    out = []
    for level in levels[:-1]:
        pair = at - at % 2
        out.append((level[pair:at], level[at + 1 : pair + 2]))
        at //= 2
    return out


def _brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row"""
    key = lambda r: (r[0] is not None, r[0] or 0, _leaf(*r))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: _levels([_leaf(*r) for r in sorted((r for r in rows if r[2] == lang), key=key)]) for lang in langs}
    top, out = _levels([trees[lang][-1][0] for lang in langs]), []
    for k, lang in enumerate(langs):
        for at, r in enumerate(sorted((r for r in rows if r[2] == lang), key=key)):
            path = _path(trees[lang], at) + _path(top, k)
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = _leaf(*r[:4], r[4] + 1) if tampered else _leaf(*r)
            for left, right in path:
                node = _h(*left, node, *right)
            out.append((r[0], _leaf(*r), trees[lang][-1][0], top[-1][0], _h(*[x for left, right in path for x in left + right]), node, node == top[-1][0]))
    return sorted(out, key=str)


def _query(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("mine")).withColumn("grp", F.lit("mine"))
    df.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op12_merkle_manifest(spark, f"file://{tmp_path}").collect()), key=str)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_equals_a_plain_tree(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rng = random.Random(bits)
    rows = [(i, rng.choice([None, "", "é\n:", "x" * 50]), rng.choice(["en", "en", "en", "de", None, "é", ""]), rng.choice([None, "s"]), rng.choice([None, 3, 99])) for i in range(170)]
    rows += [rows[5], rows[5], (None, "a", "en", "s", 1), (None, None, None, None, None), (7, "other", "en", "s", 2), (300, "lone", "zz", "s", 7)]
    assert _query(spark, tmp_path, rows) == _brute(rows)


def test_one_group_one_leaf_none(spark, tmp_path):
    rows = [(14, "a", "en", "s", 1)]
    (got,) = _query(spark, tmp_path, rows)
    assert got[1] == got[2] == got[3] and got[4] == _h() and [got] == _brute(rows)
    assert merkle.merkle_manifest(docs_of(spark, []).selectExpr("doc_id", "lang AS grp", "text AS leaf", "text AS changed")).count() == 0


def test_very_long_text(spark, tmp_path):
    rows = [(k, "long text " * 300_000 if k == 3 else "t", "en", "s", 2**62) for k in range(9)]
    assert _query(spark, tmp_path, rows) == _brute(rows)


def test_versions_copy_ancestors_only(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 2)
    leaves = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("g").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.when(F.col("id") % 7 == 0, F.sha2(F.lit("new"), 256)).alias("changed"))
    rows = merkle.merkle_manifest(leaves, copies=True).orderBy("doc_id").collect()
    base = {node for level in _levels([r.leaf for r in rows]) for node in level}
    for r in rows:
        if r.doc_id % 7:
            assert r.verified and r.copied == [r.leaf]
        else:
            assert len(r.copied) == 7 and not base & set(r.copied) and r.copied[-1] == r.folded_root and not r.verified
