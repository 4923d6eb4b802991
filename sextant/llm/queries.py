"""The registered queries of this subpackage: each applies one operator to its whole table.

``queries`` and ``oracle_sql`` are read by ``__spark_entry__.py``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies; SEXTANT_VOCABULARIES names another folder."""
    folder = os.environ.get("SEXTANT_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The key of op6: SEXTANT_PSEUDONYM_SECRET of the driver's environment, or spark.sextant.pseudonym.secret, a name that
    Spark redacts where it shows settings; where neither is set, as in tests, a key that protects nothing."""
    return os.environ.get("SEXTANT_PSEUDONYM_SECRET") or spark.conf.get("spark.sextant.pseudonym.secret", None) or "no secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.repetition import quality_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")
    return quality_rules(docs).select(*columns)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.hilbert import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.mixing import mixed_counts

    counts = mixed_counts(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return counts.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.linewindows import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written from all documents, then counted by their separators alone."""
    from sextant.llm.storage import shared_folder
    from sextant.llm.tokenfiles import count_tokens, write_token_files

    end = 50256
    folder = f"{shared_folder(spark)}/sextant-tokens"
    written = write_token_files(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), end, folder)
    counts = count_tokens(written.select("file"), folder, end)
    return written.join(counts, ["file", "ordinal"], "full").select("doc_id", "n_tokens", "file", "ordinal")


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.pseudonyms import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=pseudonym_key(spark))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a list history made from the pages' own hosts: their fetch date and the list's dates follow
    from page ids, so that entries are added, taken off and added again while captures go on."""
    from sextant.llm.urlfilter import host_of, url_filter

    start = F.lit("2024-01-01").cast("date")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(start, F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched_on"))
    hosts = pages.groupBy(host_of(F.col("url")).alias("domain")).agg(F.min("page_id").alias("p")).where("domain IS NOT NULL AND p % 3 = 0")
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("action")) for k, a in enumerate(("add", "remove", "add"))])
    dated = hosts.select("domain", "p", F.explode(steps).alias("s")).where("s.k <= p % 4")
    entries = dated.select("domain", F.date_add(start, (F.pmod(F.col("p") * 13, F.lit(200)) + F.col("s.k") * 60).cast("int")).alias("listed_on"), "s.action")
    return url_filter(pages, entries)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.secrets import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.bpe import bpe_round_trip

    return bpe_round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by language; where 7 divides the CRC-32 of a doc_id its leaf is tampered with."""
    from sextant.llm.merkle import leaf_digest, merkle_manifest

    columns = ("doc_id", "source", "lang", "n_chars", "text")
    docs = _table(spark, sf_dir, "documents").select(*columns)
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(*[more if c == "n_chars" else F.col(c) for c in columns]))
    return merkle_manifest(docs.select("doc_id", F.col("lang").alias("grp"), leaf_digest(*map(F.col, columns)).alias("leaf"), changed.alias("changed")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says and repaired; those that lost all rows have nothing to repair."""
    from sextant.llm.conversations import COUNTS, Repair, damaged

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = Repair(damaged(rows)).digests().withColumnRenamed("conv_id", "_id")
    all_ids = rows.select("conv_id").distinct()
    out = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def queries() -> dict[str, Query]:
    return {"op11_conversation_repair": op11_conversation_repair, "op12_merkle_manifest": op12_merkle_manifest, "op13_jaccard_join": op13_jaccard_join, "op4_separator_scan": op4_separator_scan, "op6_feistel_pseudonyms": op6_feistel_pseudonyms, "op8_url_filter": op8_url_filter, "op9_secret_scan": op9_secret_scan, "op1_hilbert_neighbours": op1_hilbert_neighbours, "op7_bpe_round_trip": op7_bpe_round_trip, "op2_mix_sources": op2_mix_sources, "op10_line_dedup": op10_line_dedup, "op3_quality_rules": op3_quality_rules, "op5_minhash_near_dedup": op5_minhash_near_dedup}


def oracle_sql() -> dict[str, str]:
    from sextant.llm import oracles

    return {"op11_conversation_repair": oracles.CONVERSATION_REPAIR, "op12_merkle_manifest": oracles.MERKLE_MANIFEST, "op13_jaccard_join": oracles.JACCARD_JOIN, "op3_quality_rules": oracles.QUALITY_RULES, "op10_line_dedup": oracles.LINE_DEDUP, "op8_url_filter": oracles.URL_FILTER, "op5_minhash_near_dedup": oracles.NEAR_DUPLICATES}
