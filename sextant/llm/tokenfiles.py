"""Token counts of flat, unindexed token files by separator scan.

A token file is nothing but little-endian unsigned integers, documents one after another, each ended by the
end-of-document id. Files are cut into blocks of fixed size; each block is read by itself and its separators are found
with one vectorised comparison. A block knows its own separators only: how many came before, and where the last one of
the blocks before was, come from a prefix scan over one row a block, and stitch the documents that cross borders.

Files are opened through Arrow's file systems by URI, so the folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm import textscan
from sextant.llm.bpe import encoder
from sextant.llm.shipping import ship
from sextant.llm.storage import cut, shared_folder

#: Tokens in a block.
BLOCK_TOKENS = 1 << 20
_KINDS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, vocabulary_path: str, end_of_document: int, folder: str | None = None, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write one token file for each partition of ``docs``; return (file, ordinal, doc_id), a row a document.

    A null text is a document of no tokens. Strings of special tokens in a text are ordinary text, so that only the end of
    a document has its id. Each task attempt writes files of its own, and the rows returned name those of the attempt that
    counted, so tasks that are tried again leave nothing wrong. Repeated rows are written as often as they come; an empty
    table makes no file and no rows. ValueError if an id of the vocabulary, or the end's, doesn't fit ``width`` bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark)}/sextant-tokens"
    with open(vocabulary_path, encoding="utf-8") as f:
        spelled = f.read()
    model = json.loads(spelled)
    largest = max([end_of_document, *model["model"]["vocab"].values(), *(x["id"] for x in model.get("added_tokens", []))])
    if largest >= 1 << 8 * width:
        raise ValueError(f"token id {largest} doesn't fit {width} bytes")
    vocabulary = spark.sparkContext.broadcast(spelled)
    kind = _KINDS[width]
    run_id = spark.sparkContext.applicationId

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        bpe, task = encoder(vocabulary.value), TaskContext.get()
        fs, top = open_folder(folder)
        path = f"{run_id}/part-{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
        out, ordinal = None, 0
        try:
            for whole in batches:
                for batch in textscan.batches_by_bytes(whole, "text", 2 << 20):
                    if out is None:
                        fs.create_dir(f"{top}/{run_id}", recursive=True)
                        out = fs.open_output_stream(f"{top}/{path}")
                    ids, counts, _ = bpe.encode_batch([x or "" for x in batch.column("text").to_pylist()], special=False)
                    flat = np.insert(ids, np.cumsum(counts), end_of_document)
                    out.write(flat.astype(kind).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * batch.num_rows), pa.array(np.arange(ordinal, ordinal + batch.num_rows)), batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
                    ordinal += batch.num_rows
        finally:
            if out is not None:
                out.close()

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return cut(chosen.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-manifest")


def count_tokens(files: DataFrame, folder: str, end_of_document: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) for each document of the token files ``files`` (file: path below ``folder``).

    Two separators on end have a document of 0 tokens between them. Tokens after the last separator are a document; an
    empty file, and no tokens after the last separator, are none. Repeated file rows count once.
    """
    spark = files.sparkSession
    ship(spark)
    kind = _KINDS[width]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(folder)
        for batch in batches:
            names = batch.column("file").to_pylist()
            found = fs.get_file_info([f"{top}/{x}" for x in names])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.size // width for x in found], pa.int64())], names=["file", "tokens"])

    listed = files.select("file").where("file IS NOT NULL").distinct().mapInArrow(sizes, "file string, tokens long").where("tokens > 0")
    last = F.floor((F.col("tokens") - 1) / block_tokens)
    blocks = listed.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition("file", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(folder)
        for batch in batches:
            for file, tokens, block in zip(*(batch.column(c).to_pylist() for c in ("file", "tokens", "block")), strict=True):
                start = block * block_tokens
                with fs.open_input_file(f"{top}/{file}") as f:
                    data = np.frombuffer(f.read_at(min(block_tokens, tokens - start) * width, start * width), kind)
                at = np.flatnonzero(data == end_of_document) + start
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([tokens]), pa.array([at.tolist()], pa.list_(pa.int64()))], names=["file", "block", "tokens", "at"])

    found = cut(blocks.mapInArrow(scan, "file string, block long, tokens long, at array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.size("at").cast("long").alias("n"), F.when(F.size("at") > 0, F.get("at", F.size("at") - 1)).alias("last"))
    carried = summary.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open_from"))
    met = found.join(carried, ["file", "block"])
    each = met.select("file", "seen", "open_from", "at", F.posexplode("at").alias("k", "end"))
    ended = each.select("file", (F.col("seen") + F.col("k")).alias("ordinal"), (F.col("end") - F.when(F.col("k") > 0, F.get("at", F.col("k") - 1)).otherwise(F.col("open_from")) - 1).alias("n_tokens"))
    whole = found.groupBy("file").agg(F.max("tokens").alias("tokens"), F.max(F.array_max("at")).alias("last"), F.sum(F.size("at")).alias("n"))
    rest = whole.select("file", F.col("n").alias("ordinal"), (F.col("tokens") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens")).where("n_tokens > 0")
    return ended.union(rest)
