"""A corpus pipeline of five stages over ``documents``: quality rules, line dedup, near-duplicates, mixing, encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame; ``run`` writes its rows as Parquet in the shared folder and reads them
again as the next stage's docs. All but the last return the columns of documents.

In every stage nulls in any column do no harm: a null or blank text has no words, so the quality rules reject it; a null
doc_id has no near copies and stays; null sources are one source. Repeated rows (and other rows of one doc_id) stay or go
together, except that a line's later occurrences go from each later row. Of equal documents the least doc_id stays. Columns
beyond those of documents are left out, whatever their names. An empty table gives empty tables. Texts are never cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.bpe import bpe_round_trip
from sextant.llm.linewindows import line_dedup
from sextant.llm.mixing import mix_sources
from sextant.llm.neardup import near_duplicates
from sextant.llm.queries import vocabulary_path
from sextant.llm.repetition import quality_rules
from sextant.llm.storage import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; so do documents of which nothing but white space is left then."""
    out = line_dedup(docs)
    kept = out.where("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest doc_id (5-word shingles, 0.8)."""
    keep = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(keep, docs.doc_id.eqNullSafe(F.col("_kept_id")), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, at most twice."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the text decoded from them, a row for each row of the mix."""
    return bpe_round_trip(docs.select(*COLUMNS), vocabulary_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("mix sources", mix), ("encode", encode)]

#: Rounding and MinHash are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
