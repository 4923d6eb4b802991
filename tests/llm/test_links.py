"""Near duplicates of short texts, character classes of the encoder, widths of token files, hosts of the URL filter."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import bpe, neardup, queries, shingles, tokenfiles, urlfilter
from tests.llm.test_operators import _near, docs_of


def test_overlapping_short_families_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for f in range(8):
        words = [f"f{f}w{k}" for k in range(20)]
        for k in range(31):
            width = 7 + k % 2
            at = k // 2 % (20 - width)
            texts.append(" ".join(words[at : at + width]))
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts), width=4, percent=60).collect()}
    want = {}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    roots = list(range(len(texts)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 60 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(texts))}
    assert got == want


def test_ten_thousand_six_word_texts(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(6)) for _ in range(9000)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[:500]] + texts[:500]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, texts), width=4).collect()}
    assert got == {i: (n, root) for i, (n, root) in _near(list(enumerate(texts)), 4).items()}


def test_densified_bins_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(2)
    for common, each in ((4, 1), (8, 1), (40, 5)):
        agree = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, common + each, dtype=np.int64)).astype(np.uint64)
            a, b = np.sort(x), np.sort(x[rng.permutation(len(x))[:common]])
            s = shingles.signatures([a, b], 160)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - common / (common + each)) < 0.03


def test_code_points_are_classed_as_the_library_does():
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    encoder = bpe.BpeEncoder(open(queries.vocabulary_path(), encoding="utf-8").read())
    points = [*range(0x80, 0x1000), *range(0x1000, 0x40000, 17), *(c for pair in bpe.LATER for c in pair), *(c + 1 for _, c in bpe.LATER), *(c - 1 for c, _ in bpe.LATER)]
    for c in points:
        if not 0xD800 <= c < 0xE000:
            for before in ("a", "1", "!"):
                text = f"{before}{chr(c)} {chr(c)}{before}"
                assert [len(w.encode()) for w in encoder.words(text)] == [len(w) for w, _ in library.pre_tokenize_str(text)], hex(c)
    assert unicodedata.category(chr(bpe.LATER[0][0])) == "Cn"


def test_texts_of_later_code_points_equal_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    tokenizer.no_truncation()
    rng = random.Random(4)
    alphabet = [chr(c) for pair in bpe.LATER for c in pair] + list("ab1 .\n")
    texts = ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(300)]
    got = {r.doc_id: r.token_ids for r in bpe.bpe_round_trip(docs_of(spark, texts).withColumn("N_Tokens", F.lit(1)), queries.vocabulary_path(), with_ids=True).collect()}
    assert all(np.frombuffer(got[i], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="doesn't fit"):
        tokenfiles.write_token_files(docs_of(spark, ["x"]), queries.vocabulary_path(), 70_000, f"file://{tmp_path}")


def test_token_files_of_repeated_rows_and_of_none(spark, tmp_path):
    docs = docs_of(spark, ["a b", None]).coalesce(1)
    written = tokenfiles.write_token_files(docs.union(docs), queries.vocabulary_path(), 50256, f"file://{tmp_path}/x")
    counts = tokenfiles.count_tokens(written.select("file"), f"file://{tmp_path}/x", 50256)
    got = sorted((r.doc_id, r.n_tokens) for r in written.join(counts, ["file", "ordinal"], "full").collect())
    assert got == [(0, 2), (0, 2), (1, 0), (1, 0)]
    none = tokenfiles.write_token_files(docs.limit(0), queries.vocabulary_path(), 50256, f"file://{tmp_path}/y")
    assert none.count() == 0 and tokenfiles.count_tokens(none.select("file"), f"file://{tmp_path}/y", 50256).count() == 0


def test_addresses_have_no_parents_and_bare_labels_only_where_listed(spark):
    rows = [("http://a.b.com/x",), ("http://1.2.3.4/",), ("http://[::1]:80/",), ("http://com/",)]
    hosts = [r[0] for r in spark.createDataFrame(rows, "url string").select(urlfilter.host_of(F.col("url"))).collect()]
    assert hosts == ["a.b.com", "1.2.3.4", "[::1]", "com"]
    captures = spark.createDataFrame([(u, "2024-05-01") for (u,) in rows], "url string, fetched_on string")
    for listed, want in (("com", {"http://a.b.com/x", "http://com/"}), ("2.3.4", set()), ("[::1]", {"http://[::1]:80/"}), ("b.com", {"http://a.b.com/x"})):
        entries = spark.createDataFrame([(listed, "2024-01-01", "add")], "domain string, listed_on string, action string").withColumn("listed_on", F.to_date("listed_on"))
        assert {r.url for r in urlfilter.url_filter(captures, entries).where("blocked").collect()} == want


def test_worker_batches_are_bounded(spark):
    from sextant.llm.shipping import ship

    ship(spark)
    sizes = spark.range(0, 6000, 1, 1).selectExpr("repeat('x', 3000) AS t").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in it), "n long")
    assert max(r.n for r in sizes.collect()) < 5 << 20
    assert re.fullmatch(r"\d+[a-z]*", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
