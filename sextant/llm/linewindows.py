"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed (96 bits). Windows found more than once anywhere keep their first place,
in the order of doc_id, then of the text's hash, then of the position; every later one is covered, and overlapping
covered windows merge. The rest of each text is sliced out between the covered stretches, in one pass over its lines.

Shuffles: the window hashes (about 32 bytes a line), twice, and the texts once, to meet their covered positions. Counting
is pre-aggregated and joined back, so a window that a third of all documents share is never gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.spark_names import Renamed

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def covered_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, starts): the ascending starts of the covered windows of each text that has any.

    docs: doc_id, rid, text. rid tells texts of one doc_id apart.
    """
    lines = docs.select("doc_id", "rid", _lines(F.col("text")).alias("lines"))
    spots = lines.where(F.size("lines") >= WINDOW).select("doc_id", "rid", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - WINDOW)).alias("pos"))
    at = [F.get("lines", F.col("pos") + k) for k in range(WINDOW)]
    words = F.concat(*at).rlike("[^\\x20\\x09-\\x0D]")
    windows = spots.where(words).select(F.xxhash64(*at).alias("h"), F.hash(*at).alias("g"), "doc_id", "rid", "pos")
    place = F.struct("doc_id", "rid", "pos")
    first = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    later = windows.join(first, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines_name: str = "n_lines", removed_name: str = "n_removed") -> DataFrame:
    """``docs`` with ``text`` rid of later occurrences, and two counts after its columns: lines before, lines removed.

    Lines are what stands between "\\n". A text of fewer than three lines, and a window without a word, stay as they
    are; a null text stays null (0 lines, 0 removed) and an empty one has one empty line. A text all of whose lines are
    covered becomes "". Rows equal in doc_id and text are the same document: what is first for one is first for the
    other. A null doc_id comes before all others. Other columns pass through, whatever their names.
    """
    own = Renamed(docs, (lines_name, removed_name))
    key, value = own[doc_id], own[text]
    keyed = own.df.withColumn("rid", F.xxhash64(key, value))
    cover = covered_windows(keyed.select(key.alias("doc_id"), "rid", value.alias("text")).where("text IS NOT NULL"))
    cover = cover.select(F.col("doc_id").alias("c_id"), F.col("rid").alias("c_rid"), "starts")
    met = keyed.join(cover, key.eqNullSafe(F.col("c_id")) & (F.col("rid") == F.col("c_rid")), "left").withColumn("lines", _lines(value))
    # stretches to keep: from the end of one covered window to the start of the next
    bounds = F.concat(F.array(F.lit(-WINDOW)), F.col("starts"), F.array(F.size("lines")))
    gap = F.transform(
        F.slice(bounds, 1, F.size(bounds) - 1),
        lambda x, k: F.struct((x + WINDOW).alias("at"), F.greatest(F.lit(0), F.get(bounds, k + 1) - x - WINDOW).alias("n")),
    )
    split = met.withColumn("gaps", F.when(F.col("starts").isNotNull(), gap))
    kept = F.flatten(F.transform("gaps", lambda g: F.slice("lines", g["at"] + 1, g["n"])))
    n_kept = F.aggregate("gaps", F.lit(0), lambda a, g: a + g["n"])
    return split.select(
        *own.back(**{text: F.when(F.col("gaps").isNull(), value).otherwise(F.array_join(kept, "\n"))}),
        F.when(value.isNull(), 0).otherwise(F.size("lines")).cast("long").alias(lines_name),
        F.when(F.col("gaps").isNull(), 0).otherwise(F.size("lines") - n_kept).cast("long").alias(removed_name),
    )
