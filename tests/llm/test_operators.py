"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import bpe, components, hilbert, linewindows, mixing, neardup, pseudonyms, queries, repetition, secrets, textscan, tokenfiles, urlfilter
from tests.compare import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, small, duck, name):
    same_rows(queries.queries()[name](spark, small), duck, queries.oracle_sql()[name])


# -- text scans and repetition -----------------------------------------------------------------------------------------


def _longest(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_repetition_equals_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        texts = [" ".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefg") for _ in range(rng.randrange(40))) for _ in range(4)]
        words = textscan.scan(pa.array(texts))
        first = words.first
        got = repetition.longest_common_prefixes(textscan.hash_words(words), words.doc, np.repeat(first[1:], np.diff(first)))
        assert got.tolist() == [n for t in texts for n in _longest(t.split())]


def test_word_scan_equals_pattern():
    texts = ["", None, " a\tb\x0bc ", "é漢 x\x0c", "\x1cq\x85 z", "word" * 5000, "a b " * 3000]
    words = textscan.scan(pa.array(texts))
    found = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    by_word = defaultdict(set)
    for w, h in zip(found, textscan.hash_words(words).tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len({*map(min, by_word.values())}) == len(by_word)


def test_quality_rules_edges(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    filler = " ".join(f"u{i}" for i in range(700))
    texts = [None, "", "one two", " ".join(f"a{i}" for i in range(10)), "x " * 50, f"{passage} {filler} {passage}", "l l2 l3\nl l2 l3\n\n  \n" + filler]
    df = docs_of(spark, texts).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1))
    rows = {r.doc_id: r for r in repetition.quality_rules(df).collect()}
    assert [rows[i].n_words for i in range(4)] == [0, 0, 2, 10]
    assert [rows[i].kept for i in range(7)] == [False, False, False, True, False, False, True]
    assert rows[5].longest_repeat == 60 and not rows[5].base_failed
    assert rows[6].n_dup_lines == 1
    assert repetition.quality_rules(docs_of(spark, []).limit(0)).count() == 0


# -- near duplicates ---------------------------------------------------------------------------------------------------


def _shingles(t, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def _near(rows, width, percent=80):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, _shingles(t, width)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 60, 150]))]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 15)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [None, "", "  ", "one", "ONE", "long " * 4000]
    rng.shuffle(texts)
    want = _near(list(enumerate(texts)), 4)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, texts).withColumn("kept", F.lit(1)), width=4).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_shared_ids_null_ids_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v"), (None, "a b c d e f"), (4, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (4, 4, True)])
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_links_between_short_leaves(spark):
    # chains of nine words each, of which neighbours share eight: exactly 0.8, and others are further apart
    texts = [" ".join(f"f{chain}w{i + k}" for k in range(9)) for chain in range(60) for i in range(8)]
    want = _near(list(enumerate(texts)), 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, texts), width=1).collect()}
    assert got == want


def test_near_duplicates_all_texts_of_an_id_are_linked(spark):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (5, "m n o p q r"), (1, "a b c d e f"), (2, "g h i j k l"), (3, "m n o p q r")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.component_id for r in got} == {1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# -- line dedup --------------------------------------------------------------------------------------------------------


def _dedup(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (None, 0)
            continue
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not WORD.search("".join(w)):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.setdefault(w, (i, k))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice("abcdef") * rng.randrange(0, 2) for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    texts += [None, "", "a\nb", "\n\n\n\n", "x\ny\nz\nx\ny\nz\nx\ny\nz", "é\nü\nß", "é\nü\nß"]
    df = docs_of(spark, texts).withColumn("rid", F.lit(7)).withColumn("N_Lines", F.lit("mine")).withColumn("gaps", F.lit("mine"))
    got = linewindows.line_dedup(df, lines_name="line_count").collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == _dedup(list(enumerate(texts)))
    assert all(r.rid == 7 and r["N_Lines"] == "mine" and r.gaps == "mine" for r in got)
    assert linewindows.line_dedup(docs_of(spark, ["a"]).limit(0)).count() == 0


# -- mixing ------------------------------------------------------------------------------------------------------------


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left, w = total - sum(2 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / w > 2 * sizes[s]} if w else set()
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        capped |= over


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 40, 300]))), None if i % 7 == 0 else f"s{i % 5}") for i in range(900)]
    rows += [(5000, None, "s1"), (5001, "x " * 2000, "s2"), (5002, "same row", "s3"), (5002, "same row", "s3"), (None, "no id", "s4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine"))
    got = mixing.mixed_counts(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = _targets(dict(sizes))
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)
        assert all(r.taken <= 2 * r.size for r in mine)
    again = mixing.mixed_counts(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns
    want_rows = Counter()
    for r in got:
        want_rows[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want_rows
    assert mixing.mixed_counts(df.limit(0)).count() == 0


def test_pivotal_keeps_the_sum():
    rng = random.Random(7)
    for _ in range(50):
        n = rng.randrange(1, 40)
        p, size = [rng.choice([0.0, 1.0, rng.random()]) for _ in range(n)], [rng.randrange(1, 500) for _ in range(n)]
        out = mixing.pivotal(p, size, [rng.getrandbits(64) for _ in range(n)])
        assert sum(0 < x < 1 for x in out) <= 1
        assert abs(sum(a * s for a, s in zip(out, size, strict=True)) - sum(a * s for a, s in zip(p, size, strict=True))) < 1e-6
    tries = [mixing.pivotal([0.3, 0.3, 0.4], [1, 1, 1], [rng.getrandbits(64) for _ in range(3)]) for _ in range(4000)]
    assert abs(np.mean([t[2] for t in tries]) - 0.4) < 0.03


# -- BPE and token files -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def _fuzz():
    rng = random.Random(8)
    alphabet = "abcdeht  \n\t'slaaAB1290éßñ漢字🙂.,;-_()   "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)] + [
        "a" * 3000, "", "<|endoftext|>", "x<|endoftext|>  y<|endoftext|><|endoftext|> z ", "  lead", "trail  ", "don't I'll 'S", "\x1c a\x1db", "\r\n\r\n x", "ab" * 500, "=" * 700,
    ]


def test_bpe_equals_the_library(spark, tokenizer, small):
    texts = [*_fuzz(), None, *[r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]]
    df = docs_of(spark, texts).withColumn("N_tokens_", F.lit(1))
    got = {r.doc_id: r for r in bpe.bpe_round_trip(df, queries.vocabulary_path(), with_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and np.frombuffer(got[i].token_ids, "<u4").tolist() == ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.bpe_round_trip(df.limit(0), queries.vocabulary_path()).count() == 0


def test_bpe_cache_starts_afresh(monkeypatch, tokenizer):
    encoder = bpe.BpeEncoder(open(queries.vocabulary_path(), encoding="utf-8").read())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    for special in (False, True):
        for text in _fuzz()[::9]:
            tokenizer.encode_special_tokens = not special
            ids, counts, strings = encoder.encode_batch([text, "", text], special=special)
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]
    tokenizer.encode_special_tokens = False


def test_separator_scan(spark, tmp_path):
    rng = np.random.default_rng(9)
    end, names, want = 9, [], {}
    for k, body in enumerate(([], [9], [9, 9], [1, 2, 3], rng.integers(0, 10, 5000).tolist(), [1] * 300 + [9], [9] + [2] * 250)):
        (tmp_path / f"f{k}.bin").write_bytes(np.array(body, "<u2").tobytes())
        names.append((f"f{k}.bin",))
        lengths, n = [], 0
        for t in body:
            if t == end:
                lengths.append(n)
                n = 0
            else:
                n += 1
        want |= {(f"f{k}.bin", i): x for i, x in enumerate(lengths + [n] * (n > 0))}
    files = spark.createDataFrame([*names, names[3], (None,)], "file string")
    got = tokenfiles.count_tokens(files, f"file://{tmp_path}", end, block_tokens=64).collect()
    assert {(r.file, r.ordinal): r.n_tokens for r in got} == want and len(got) == len(want)


def test_token_files_count_what_was_encoded(spark, tmp_path, tokenizer):
    texts = [None, "", "<|endoftext|> is text here", "plain words", "é漢🙂 " * 50]
    written = tokenfiles.write_token_files(docs_of(spark, texts), queries.vocabulary_path(), 50256, f"file://{tmp_path}")
    counts = tokenfiles.count_tokens(written.select("file"), f"file://{tmp_path}", 50256)
    got = {r.doc_id: r.n_tokens for r in written.join(counts, ["file", "ordinal"], "full").collect()}
    tokenizer.encode_special_tokens = True
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    tokenizer.encode_special_tokens = False


def test_op4_query_equals_encoding(spark, small):
    got = {r.doc_id: r.n_tokens for r in queries.op4_separator_scan(spark, small).collect()}
    want = {r.doc_id: r.n_tokens for r in queries.op7_bpe_round_trip(spark, small).collect()}
    assert got == want


# -- neighbours --------------------------------------------------------------------------------------------------------


def test_neighbours(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] * 64), (None, rows[0][1]), (9050, rows[0][1]), (9051, rows[0][1]), (9052, [2.0 * x for x in rows[0][1]]), (9100, [1.0])]
    both = spark.createDataFrame(rows + odd + rows[:3], df.select("vec_id", "embedding").schema).withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in hilbert.nearest(both).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v, np.float64) for i, v in rows + odd[6:9]}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    asked = [i for i in good if i % 50 == 0]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        near = sorted(((-round(float(unit[q] @ unit[i]), 12), i) for i in good if i != q))[:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - unit[q] @ unit[i]) < 1e-12 for _, i, s in mine)
        assert [(-round(s, 12), i) for _, i, s in mine] == sorted((-round(s, 12), i) for _, i, s in mine)
        hits += len({i for _, i in near} & {i for _, i, _ in mine})
    assert hits >= 0.9 * 5 * len(asked)
    assert hilbert.nearest(both.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in hilbert.nearest(few).collect()) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]


def test_neighbours_of_many_ties_are_the_smallest_ids(spark):
    rng = np.random.default_rng(6)
    rows = [rng.integers(-1, 2, 6).astype(float).tolist() for _ in range(500)] + [[float(k % 6 == j) for j in range(6)] for k in range(60)]
    hot = rng.standard_normal(6)
    rows += [(hot * c).tolist() for c in rng.uniform(0.01, 99, 200)]
    good = {int(i): np.array(v) for i, v in zip(rng.permutation(len(rows)), rows, strict=True) if any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    want = {q: sorted((-round(float(unit[q] @ unit[i]), 11), i) for i in good if i != q)[:5] for q in good if q % 5 == 0}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in good.items()], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hilbert.nearest(df, "vec_id % 5 = 0").collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


@pytest.mark.parametrize("kind", ["manifold", "clusters", "independent"])
def test_windows_follow_the_structure(spark, kind):
    """20,000 vectors; recall of the operator's own output. With structure under a tenth of the rows is scored for a query."""
    rng = np.random.default_rng(5)
    n = 20_000
    if kind == "manifold":
        x = rng.standard_normal((n, 5)) @ rng.standard_normal((5, 64)) + 0.02 * rng.standard_normal((n, 64))
    elif kind == "clusters":
        x = rng.standard_normal((400, 64))[rng.integers(0, 400, n)] + 0.3 * rng.standard_normal((n, 64))
    else:
        x = rng.standard_normal((n, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    seen, got = {}, defaultdict(set)
    for r in hilbert.nearest(df, observed=seen).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 50):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argpartition(-near, 5)[:5].tolist()) & got[q])
    assert hits >= 0.9 * 5 * (n // 50)
    window = (2 * -(-seen["reach"] // seen["cell"]) + 1) * seen["cell"]
    share = 1 - (1 - min(1, window / n)) ** seen["curves"]
    assert share < (0.12 if kind == "clusters" else 0.1 if kind == "manifold" else 1)


def test_fitted_windows_hold_the_known_gaps():
    gaps = np.array([[5, 900], [7, 800], [600, 3], [10, 10]])
    used, reach, cell = hilbert.fit_windows(gaps, 100_000, recall=1.0)
    assert used == 2 and reach == 10 and cell == hilbert.LEAST_CELL
    assert hilbert.fit_windows(gaps[:, :1], 100_000, recall=0.75)[:2] == (1, 10)


def test_hilbert_order_is_a_path():
    side, n = 8, 3
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(side**n))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# -- secrets -----------------------------------------------------------------------------------------------------------


def _base(text):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark, small):
    texts = [None, "", 'k = "sk_live_abc123DEF"\nclient.api_key = k\n', 'a = "abc123"\nb = "DEF456ghi"\nSECRET_KEY = a + b', "<password>Zx9#kk2lmn</password>", "the keys: of the house are lost", "paſſword=abcdefgh1", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "0" * 31, "0" * 32 + "é" + "f" * 40, "token: short", "password = changeme", "x" * 30000 + " token=" + "y" * 30000]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: r for r in secrets.secret_scan(docs_of(spark, texts).withColumn("spans", F.lit("mine"))).collect()}
    for i, t in enumerate(texts):
        base = _base(t or "")
        named = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("lexed")] == named
    lexed = [[t[int(a) : int(b)] for _, a, b in (s.split(":") for s in got[i].spans.split(",") if s.startswith("lexed"))] for i, t in enumerate(texts[:13])]
    assert lexed[2] == ["sk_live_abc123DEF"] and lexed[3] == ["abc123", "DEF456ghi"] and lexed[4] == ["Zx9#kk2lmn"] and lexed[5] == [] and lexed[12] == []
    assert secrets.secret_scan(docs_of(spark, [""]).limit(0)).count() == 0


def test_secret_names_split_anywhere_are_lexed():
    for word in secrets.SENSITIVE:
        for k in range(len(word)):
            for joint in ("_", "-", ".", "$", "__"):
                name = word[:k] + joint * (k > 0) + word[k:]
                text = f'{name} = "Xy7/qQ9z!pL2"'
                assert secrets.sensitivity(name) and secrets.worth_lexing(text.lower())
                assert [text[a:b] for a, kind, b in secrets.scan_text(text) if kind == 3] == ["Xy7/qQ9z!pL2"]
    assert not secrets.worth_lexing("nothing of the kind - really")


# -- pseudonyms --------------------------------------------------------------------------------------------------------


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    texts = ["call +1 (017) 555-7713, 415-555-1234", "4111-1111-1111-1111 and 4111111111111112", "175.102.247.55 999.1.1.1", "1987-03-21 21.03.1987 2024/02/30", "a.b34@mail2.example.com", None, "", "no digits", "at 4111-1111-1111-1111 again", "9" * 30000]
    df = docs_of(spark, texts).withColumn("found", F.lit("mine"))
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    assert [got[i].n_pseudonyms for i in range(10)] == [2, 1, 1, 2, 1, 0, 0, 0, 1, 0]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}, \d{3}-\d{3}-\d{4}", got[0].text) and "7713" not in got[0].text
    card = got[1].text.split()[0]
    assert re.fullmatch(r"(\d{4}-){3}\d{4}", card) and _luhn(card) and got[1].text.endswith("4111111111111112") and card in got[8].text
    assert all(0 <= int(x) <= 255 for x in got[2].text.split()[0].split(".")) and got[2].text.endswith(" 999.1.1.1")
    a, b, c = got[3].text.split()
    assert a.split("-") == b.split(".")[::-1] and a != "1987-03-21" and c == "2024/02/30"
    assert re.fullmatch(r"[a-z]\.[a-z]\d\d@mail2\.example\.com", got[4].text)
    assert all(got[i].text == texts[i] for i in (5, 6, 7, 9)) and all(r.found == "mine" for r in got.values())
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(df, "other").collect()}
    assert other[0] != got[0].text
    assert pseudonyms.pseudonymise(df.limit(0), "k").count() == 0


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [card, f"{card} 123", f"{card} 12/27", "3 4111111111111111", f"1234 {card}", f"{card} 12.50", f"{card} 415-555-1234", f"{card} 2024-01-02", f"{card} 4111111111111111 7", f"{card}-12.50", f"7 {card} 5-12.50", "123 415-555-1234"]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs_of(spark, texts), "k").collect()}
    now = got[0].text
    assert now != card and _luhn(now)
    assert [got[i].text for i in (1, 2, 3, 4, 5)] == [f"{now} 123", f"{now} 12/27", "3 " + now.replace(" ", ""), f"1234 {now}", f"{now} 12.50"]
    assert got[6].text.startswith(now + " ") and got[7].text.startswith(now + " ")
    assert got[8].text == f"{now} {now.replace(' ', '')} 7" and got[9].text == texts[9] and got[10].text == f"7 {now} 5-12.50"
    assert got[11].text.startswith("123 ") and got[11].text != texts[11]
    assert [got[i].n_pseudonyms for i in range(12)] == [1, 1, 1, 1, 1, 1, 2, 2, 2, 0, 1, 1]


def test_permutations_are_one_to_one(spark):
    for width in (1, 2, 3):
        d = spark.range(10**width).select(F.lpad(F.col("id").cast("string"), width, "0").alias("x"))
        out = [r[0] for r in d.select(pseudonyms.permute_string(F.col("x"), 10, F.lit("k"), "t")).collect()]
        assert len(set(out)) == 10**width and all(len(x) == width for x in out)


# -- URL filter --------------------------------------------------------------------------------------------------------


def test_url_filter_edges(spark):
    entries = spark.createDataFrame(
        [("bad.org", "2024-01-10", "add"), ("bad.org", "2024-03-01", "remove"), ("bad.org", "2024-05-05", "add"), ("x.bad.org", "2024-01-15", "add"), ("b.net", "2024-02-01", "add"), ("b.net", "2024-02-01", "remove"), (None, "2024-01-01", "add"), ("c.net", None, "add"), ("c.net", "2024-01-01", "noise"), ("BAD.org", "2024-01-10", "add")],
        "domain string, listed_on string, action string",
    ).withColumn("listed_on", F.col("listed_on").cast("date"))
    urls = [("http://bad.org/", "2024-01-09"), ("http://bad.org/", "2024-01-10"), ("https://u:p@X.Bad.org:81/q", "2024-02-29"), ("http://y.bad.org", "2024-03-01"), ("http://bad.org.", "2025-01-01"), ("http://notbad.org", "2024-02-01"), ("http://b.net", "2024-02-01"), ("nonsense", "2024-02-01"), (None, "2024-02-01"), ("http://bad.org", None), ("http://c.net", "2024-02-01"), ("http://bad.org/", "2024-01-10")]
    captures = spark.createDataFrame([(i, u, d, "mine") for i, (u, d) in enumerate(urls)], "id int, url string, fetched_on string, blocked string").withColumn("fetched_on", F.col("fetched_on").cast("date")).withColumn("host", F.lit(1))
    got = {r.id: (r.blocked, r.blocked_by) for r in urlfilter.url_filter(captures, entries).collect()}
    no = (False, None)
    assert [got[i] for i in range(12)] == [no, (True, "bad.org"), (True, "x.bad.org"), no, (True, "bad.org"), no, no, no, no, no, no, (True, "bad.org")]
    assert urlfilter.url_filter(captures, entries.limit(0)).where("blocked").count() == 0
    assert urlfilter.url_filter(captures.limit(0), entries).count() == 0
