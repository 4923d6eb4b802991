"""Each stage of the pipeline against a brute-force version over the rows it was given."""

import hashlib

import corpus_pipeline
from sextant.llm.storage import cut
from tests.llm.test_operators import WORD, _dedup, _near, _targets


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = cut(stage(spark, docs, small), "test")
        after = docs.collect()
        texts = {r.doc_id: r.text for r in before}
        if name == "quality rules":
            def keeps(t):
                w = WORD.findall(t or "")
                windows = {}
                for k in range(len(w) - 4):
                    windows.setdefault(tuple(w[k : k + 5]), []).append(k)
                marked = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
                long = {tuple(w[k : k + 51]) for k in range(len(w) - 50)}
                return len(w) >= 10 and 100 * len(marked) <= 20 * len(w) and len(long) == max(0, len(w) - 50)

            assert {r.doc_id for r in after} == {i for i, t in texts.items() if keeps(t)}
        elif name == "line dedup":
            want = {i: t for i, (t, gone) in _dedup(list(texts.items())).items() if not gone or WORD.search(t)}
            assert {r.doc_id: r.text for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after if r.text != texts[r.doc_id])
        elif name == "near copies":
            assert {r.doc_id for r in after} == {i for i, (_, root) in _near(list(texts.items()), 5).items() if i == root}
        elif name == "mix sources":
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
            for s, target in _targets(sizes).items():
                taken = sum(len(WORD.findall(r.text)) for r in after if r.source == s)
                assert abs(taken - target) <= max(len(WORD.findall(r.text)) for r in before if r.source == s)
        else:
            assert sorted((r.doc_id, r.decoded_sha256) for r in after) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
        if name != "encode":
            assert docs.columns == columns


def test_stages_on_edges(spark, small):
    """Nulls in any column, blank and very long texts, repeated rows, an extra and clashing columns, and an empty table."""
    plain = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, plain, None, None, 5), (4, plain, None, None, 5), (5, plain, "en", "a", 5), (None, plain + " more", "en", "a", 6),
        (6, " ".join(f"long{k}" for k in range(60_000)), "de", "b", 7), (7, "\n".join(" ".join(f"x{k}{c}" for c in "abcde") for k in range(9)), "de", "b", 8),
        (8, "\n".join(" ".join(f"x{k}{c}" for c in "abcde") for k in range(9)) + "\nand an end of its own here", "de", "b", 9), (9, "short", "fr", "c", 5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    clash = docs.selectExpr("*", "'mine' AS kept", "'mine' AS n_words", "1 AS rep", "'x' AS bucket")
    for given in (docs, clash, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = cut(stage(spark, now, small), "edges")
            if name != "encode":
                assert now.columns == docs.columns
            kept = now.collect()
            if given is not docs and given is not clash:
                assert kept == []
            elif name == "quality rules":
                assert sorted(r.doc_id or 0 for r in kept) == [0, 4, 4, 5, 6, 7, 8]
            elif name == "line dedup":
                assert {r.doc_id for r in kept} == {None, 4, 5, 6, 7, 8} and next(r for r in kept if r.doc_id == 8).text.endswith("end of its own here")
            elif name == "near copies":
                assert {r.doc_id for r in kept} == {None, 4, 6, 7, 8} and sum(r.doc_id == 4 for r in kept) == 2
            elif name == "mix sources":
                assert {r.doc_id for r in kept} <= {None, 4, 6, 7, 8}
            else:
                assert all(r.decoded_sha256 for r in kept)
