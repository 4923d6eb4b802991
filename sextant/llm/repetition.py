"""Quality rules with suffix-array repetition.

Words are runs of ``[^\\x20\\x09-\\x0D]``. For each text the suffixes of its word sequence are ranked by prefix doubling,
many texts at once in NumPy. Suffixes whose rank is already unique inside their text are settled and leave the sort, so
ordinary prose costs two or three rounds. Neighbours in the suffix array give longest common prefixes; the deepest
common-prefix interval of a suffix is the larger of the two beside it, and [start, start + that length) is a maximal
repeated substring through it. The union of these spans is the covered text. A document goes when too few words, too
large a covered fraction or too long a single repeat is found.

Each document is scored alone: no shuffle, no state between rows, memory bounded by a slice of 1 MB of text (or the longest
single text). Of each round only the ranks that it changed are kept: 8 bytes for a word in repeats of
at least 2^k words, but no more than 4 for each word of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sextant.llm import textscan
from sextant.llm.shipping import ship

#: The symbols counted as markup or noise.
SYMBOLS = "#*$%&|<>"
#: Repeats shorter than this many words are ordinary phrasing.
MIN_REPEAT = 5
#: A single repeat of more words than this rejects a document.
MAX_LONGEST_REPEAT = 50
MAX_COVERED_PERCENT = 20
MIN_WORDS = 10

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


def longest_common_prefixes(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, least: int = 1) -> np.ndarray:
    """For each position of a batch of word sequences: words of the longest repeat that starts there, in its own text.

    ids: a hash of each word; doc: its text's number, ascending; end: where its text ends. Repeats shorter than
    ``least`` words may be given as 0.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    order = np.lexsort((ids, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    # the rank of a class is the place of its first member, from 1, so its refinements fit in; 0 stands for the end of a text
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0)) + 1
    words, former, step = rank.copy(), [], 1
    active = candidates = _shared(order, fresh)
    while len(active):
        after = active + step
        inside = after < end[active]
        second = np.zeros(len(active), np.int32)
        second[inside] = rank[after[inside]]
        order = np.lexsort((second, rank[active]))
        second, active = second[order], active[order]
        first = rank[active]
        opens = np.ones(len(active), bool)
        opens[1:] = first[1:] != first[:-1]
        fresh = opens.copy()
        fresh[1:] |= second[1:] != second[:-1]
        place = np.arange(len(active), dtype=np.int32)
        group_at = np.maximum.accumulate(np.where(opens, place, 0))
        class_at = np.maximum.accumulate(np.where(fresh, place, 0))
        former.append((active.astype(np.int32), first) if 2 * len(active) < n else (slice(None), rank.copy()))
        rank[active] += class_at - group_at
        step *= 2
        active = _shared(active, fresh)
        candidates = active if step <= least else candidates
    # suffix array of the suffixes that can begin a repeat of `least` words
    order = candidates[np.argsort(rank[candidates])]
    left, right = order[:-1], order[1:]
    same = words[left] == words[right]
    left, right = left[same], right[same]
    i, j, common = left.copy(), right.copy(), np.zeros(len(left), np.int64)
    while former:
        # ranks of half as many words come back by undoing the last refinement
        at, ranks = former.pop()
        rank[at] = ranks
        k = len(former)
        at = np.flatnonzero((i < end[left]) & (j < end[right]))
        at = at[rank[i[at]] == rank[j[at]]]
        common[at] += 1 << k
        i[at] += 1 << k
        j[at] += 1 << k
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _shared(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Members of classes with at least two of them; fresh marks the first of each class in order."""
    last = np.append(fresh[1:], True)
    return order[~(fresh & last)]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` words: the union of the spans."""
    at = np.flatnonzero(longest >= least)
    marks = np.zeros(len(longest) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + longest[at], -1)
    return np.cumsum(marks[:-1]) > 0


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The metrics of a slice of texts."""
    words = textscan.scan(texts)
    doc, first = words.doc, words.first
    rows = len(first) - 1
    longest = longest_common_prefixes(textscan.hash_words(words), doc, np.repeat(first[1:], np.diff(first)), MIN_REPEAT)
    in_repeat = covered(longest, MIN_REPEAT)

    def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    deepest = np.zeros(rows, np.int64)
    np.maximum.at(deepest, doc, np.where(longest >= MIN_REPEAT, longest, 0))
    symbol = np.zeros(256, bool)
    symbol[[ord(x) for x in SYMBOLS]] = True
    data = words.data
    lines = [_duplicate_lines(x or "") for x in texts.to_pylist()]
    return {
        "n_words": np.diff(first),
        "word_chars": per_doc(((data & 0xC0) != 0x80) & ~textscan._SPACE[data], words.offsets),
        "n_symbols": per_doc(symbol[data], words.offsets),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": per_doc(in_repeat, first),
        "longest_repeat": deepest,
    }


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of METRICS put before its own (clashing columns of ``docs`` are replaced).

    Null and empty texts have 0 everywhere; repeated rows are measured each by itself; an empty table stays empty.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in METRICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.batches_by_bytes(whole, text):
                made = measure(batch.column(text))
                yield pa.RecordBatch.from_arrays([pa.array(made[m], pa.int64()) for m in METRICS] + [batch.column(c) for c in kept], names=[*METRICS, *kept])

    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    return out.mapInArrow(run, StructType([StructField(m, LongType()) for m in METRICS] + list(out.schema.fields)))


def quality_rules(docs: DataFrame, text: str = "text", max_longest: int = MAX_LONGEST_REPEAT) -> DataFrame:
    """METRICS plus ``base_failed`` and ``kept`` for each row of ``docs``.

    base_failed: fewer than MIN_WORDS words, or over MAX_COVERED_PERCENT percent of the words inside repeats of
    MIN_REPEAT words or more. kept: not base_failed and no single repeat longer than ``max_longest`` words. Both are
    never null. A text of exactly MIN_WORDS words, exactly the covered percentage or exactly ``max_longest`` stays.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_COVERED_PERCENT * F.col("n_words"))
    out = quality_metrics(docs.drop("base_failed", "kept"), text)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("longest_repeat") <= max_longest))
