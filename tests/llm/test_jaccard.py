"""The Jaccard join against brute force, with sets on either side of the boundary, and its edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from sextant.llm import jaccard
from tests.llm.test_operators import DOCS, WORD, docs_of


def _set(text, width=4):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _brute(texts, percent=85, width=4):
    """(links between different sets, component of each row)"""
    sets, roots, links = [_set(t, width) for t in texts], list(range(len(texts))), set()

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
                if sets[a] != sets[b]:
                    links.add((a, b))
    return links, [find(k) for k in range(len(texts))]


def _texts(rng):
    texts = []
    for f in range(12):
        words = [f"f{f}w{k}" for k in range(rng.choice([8, 14, 18, 22, 40, 90, 200]))]
        for _ in range(12):
            w = list(words)
            for _ in range(rng.randrange(3)):
                w[rng.choice([0, len(w) - 1, rng.randrange(len(w))])] = f"x{rng.randrange(50)}"
            texts.append(" ".join(w[rng.randrange(2) : len(w) - rng.randrange(3)]))
    texts += [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 70)])
def test_equals_brute_force(spark, seed, percent):
    texts = _texts(random.Random(seed))
    links, roots = _brute(texts, percent)
    rows = {r.doc_id: r for r in jaccard.jaccard_components(docs_of(spark, texts), percent=percent).collect()}
    assert [rows[k].component_id for k in range(len(texts))] == roots
    assert [rows[k].n_shingles for k in range(len(texts))] == [len(_set(t)) for t in texts]


@pytest.mark.parametrize("light", [0, 16])
def test_any_boundary_gives_the_same_links(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard, "boundary", lambda *_: light)
    monkeypatch.setattr(jaccard, "PICKED", 10 * light)
    texts = _texts(random.Random(5))
    links, roots = _brute(texts)
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(frozenset(_set(t)), k)
    between = {tuple(sorted((first[frozenset(_set(texts[a]))], first[frozenset(_set(texts[b]))]))) for a, b in links}
    assert {(r.u, r.v) for r in jaccard.jaccard_links(docs_of(spark, texts)).collect()} == between
    assert [r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts)).orderBy("doc_id").collect()] == roots


def test_boundary_is_where_the_costs_meet():
    assert jaccard.boundary({20: 1000}, {20: 10}, 85) < 20
    assert jaccard.boundary({14: 10}, {14: 10**9}, 85) >= 14
    for s in range(1, 25):
        for t in jaccard.partners(s, 85):
            c = jaccard.shared(s, t, 85)
            assert 100 * c >= 85 * (s + t - c) and 100 * (c - 1) < 85 * (s + t - c + 1) and c <= min(s, t)


def test_edges(spark):
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(1, "a b c d e"), (2, "A B c d e"), (3, None), (4, ""), (5, " \t"), (6, "x"), (7, "X"), (8, long), (9, long + " end"), (None, "a b c d e"), (6, "x"), (10, "p q r s t u"), (10, "x")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("component_id", F.lit("mine")).withColumn("node", F.lit(0))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).select("doc_id", "n_shingles", F.coalesce("component_id", F.lit(-1)).alias("component_id")).collect())
    n = len(long.split()) - 3
    assert got == sorted([(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, n, 8), (9, n + 1, 8), (0, 2, -1), (6, 1, 6), (10, 3, 6), (10, 1, 6)])
    assert jaccard.jaccard_components(docs_of(spark, []).limit(0)).count() == 0


def test_a_family_of_thousands_is_one_component(spark):
    rng = random.Random(7)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(1500):
        w = list(base)
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = jaccard.jaccard_components(docs_of(spark, [" ".join(base), *texts])).collect()
    assert {r.component_id for r in rows} == {0}
