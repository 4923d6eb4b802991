"""Conversation structure repair: faults, least edits and repaired turns of conversations of any length.

Conversations of up to ROWS_WHOLE rows and BYTES_WHOLE bytes are dealt out by conv_id and repaired whole, many at a time. Of longer
ones equal rows are taken together, a range partition by (conversation, turn) cuts them into stretches of 2**STRETCH rows, and their cost tables and
state maps (4 x 4 numbers each) are combined stretch by stretch and then partition by partition, so no task holds more than
a stretch of rows, a partition's stretches or one entry for each partition. ``auditpaths`` has the DP and the ranking.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.auditpaths import AT_END, DUE, FAR, KEPT, LETTERS, TAILS, D, I, K, Paths, R, Rows, min_plus
from sextant.llm.shipping import ship
from sextant.llm.storage import cut

ROWS_WHOLE, BYTES_WHOLE, STRETCH = 4096, 8 << 20, 12
#: Rows of whole conversations repaired at once.
AT_ONCE = 8192
SPACE = " \t\n\x0b\x0c\r"
TURN = "struct<edit:string,role:string,text:string>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with nulls of role and text as one space and damaged by the CRC-32 of
    ``conv_id:turn`` (nulls one space there too) modulo 20: 0 drops a row, 1 empties its text, 2 takes its ends of
    sentences, 3 repeats it, 4 makes it the user's."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    k = (F.crc32(place) % 20).cast("int")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1)))
    return rows.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), text.alias("text"), times.alias("_")).drop("_")


def _marked(rows: DataFrame) -> DataFrame:
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    ends = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    return base.withColumns({"initial": code, "blank": ends == "", "whole": F.substring(ends, -1, 1).isin(".", "!", "?"), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", F.length("text"), "role")})


def _illegal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether initials may not follow each other; only su, ua and au may."""
    return ~(((before == 1) & (after == 2)) | ((before == 2) & (after == 3)) | ((before == 3) & (after == 2)))


def _edits(paths: Paths, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter, row, state after) of steps."""
    letter, row, state = paths.letter[node], node // 4, node % 4
    kept = KEPT[paths.rows.initial[row], state]
    return letter, row, np.where(letter == K, kept, np.where(letter == D, state, DUE[state]))


# -- whole conversations -----------------------------------------------------------------------------------------------


def _with(column: pa.ChunkedArray, *values: str) -> pa.Array:
    return pa.chunked_array([*column.chunks, pa.array(values, column.type)]).combine_chunks()


def _repaired(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    """A row for each of some whole conversations, whose rows lie in order."""
    t = t.combine_chunks()
    n, sequences = t.num_rows, len(first) - 1
    of = np.repeat(np.arange(sequences), np.diff(first))
    col = {c: t.column(c).to_numpy() for c in ("initial", "blank", "whole", "h1", "h2")}
    blank, initial = col["blank"].astype(bool), col["initial"].astype(np.int64)
    order = np.lexsort((col["h2"], col["h1"], of))
    same = np.zeros(n, bool)
    a, b = order[:-1], order[1:]
    same[b] = (of[a] == of[b]) & (col["h1"][a] == col["h1"][b]) & (col["h2"][a] == col["h2"][b])
    same &= ~blank
    broken = ~blank & ~same & ~col["whole"].astype(bool)
    null = t.column("turn").is_null().to_numpy().astype(bool)
    turn = t.column("turn").fill_null(0).to_numpy()
    opens = np.zeros(n, bool)
    opens[first[:-1]] = True
    new = ~null & (opens | np.r_[True, null[:-1] | (turn[1:] != turn[:-1])])
    low, high = np.full(sequences, np.iinfo(np.int64).max), np.full(sequences, np.iinfo(np.int64).min)
    np.minimum.at(low, of[~null], turn[~null])
    np.maximum.at(high, of[~null], turn[~null])
    distinct = np.bincount(of[new], minlength=sequences)
    gaps = np.where(distinct > 0, high - np.where(distinct > 0, low, 0) + 1 - distinct, 0)
    wrong = ~opens[1:] & _illegal(initial[:-1], initial[1:])
    paths = Paths(Rows(initial, np.where(blank | same, 0, 1 + broken), np.zeros(n, np.int64), first), np.tile(AT_END, (sequences, 1)))
    at, node, state = paths.follow(np.zeros(sequences, np.int64))
    letter, row, after = _edits(paths, node)
    # what is inserted at the end
    tail = np.array([len(x) for x in TAILS])[state]
    at, ends = np.concatenate([at, np.repeat(np.arange(sequences), tail)]), np.repeat(state, tail)
    second = np.r_[False, np.repeat(np.arange(sequences), tail)[1:] == np.repeat(np.arange(sequences), tail)[:-1]] if len(ends) else np.zeros(0, bool)
    letter, row, after = np.r_[letter, np.full(len(ends), I)], np.r_[row, np.zeros(len(ends), np.int64)], np.r_[after, np.where(second | (ends == 2), 3, 2)]
    order = np.argsort(at, kind="stable")
    letter, row, after = letter[order], row[order], after[order]
    offsets = np.r_[0, np.cumsum(np.bincount(at, minlength=sequences))].astype(np.int32)
    roles = _with(t.column("role"), "user", "assistant").take(pa.array(np.where(letter == K, row, n + (after == 3)), mask=letter == D))
    texts = _with(t.column("text"), "").take(pa.array(np.where(letter == I, n, row), mask=letter == D))
    turns = pa.StructArray.from_arrays([pa.array(list(LETTERS)).take(pa.array(letter)), roles, texts], names=["edit", "role", "text"])
    counts = [gaps, *[np.bincount(of[x], minlength=sequences) for x in (blank, same, broken)], np.bincount(of[1:][wrong], minlength=sequences), paths.value[paths.start]]
    spoken = np.array(list(LETTERS.encode()), np.uint8)[letter].tobytes().decode()
    audits = [spoken[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks().take(pa.array(first[:-1])), *[pa.array(c.astype(np.int64)) for c in counts], pa.array(audits, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), turns)], names=["conv_id", *COUNTS, "audit", "turns"])


def _whole(rows: DataFrame) -> DataFrame:
    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            starts = _starts(t)
            if len(starts) > 1:  # the last conversation may go on
                yield from some(t.slice(0, starts[-1]), starts)
                held = t.slice(starts[-1]).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from some(t, np.r_[_starts(t), t.num_rows])

    def _starts(t: pa.Table) -> np.ndarray:
        null, ids = t.column("conv_id").is_null().to_numpy().astype(bool), t.column("conv_id").fill_null(0).to_numpy()
        return np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]) if len(ids) else np.zeros(0, np.int64)

    def some(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        a = 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(first, first[a] + AT_ONCE, "right")) - 1)
            yield _repaired(t.slice(first[a], first[b] - first[a]), first[a : b + 1] - first[a])
            a = b

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    laid = rows.repartition("conv_id").sortWithinPartitions(*order)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return laid.mapInArrow(conversations, f"conv_id long, {counts}, audit string, turns array<{TURN}>")


# -- long conversations, stretch by stretch ----------------------------------------------------------------------------


def _stretches(units: DataFrame, extra: DataFrame | None, run: Callable, schema: str) -> DataFrame:
    """``run`` on the rows of each stretch, and with ``extra`` on its row there too."""
    kept = units.select("key", "at", "initial", "kind", "extra").groupBy("key", F.shiftright("at", STRETCH).alias("stretch"))
    if extra is None:
        return kept.applyInPandas(run, schema)
    return kept.cogroup(extra.groupBy("key", "stretch")).applyInPandas(run, schema)


def _as_rows(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Rows]:
    pdf = pdf.sort_values("at")
    return pdf, Rows(*[pdf[c].to_numpy().astype(np.int64) for c in ("initial", "kind", "extra")], np.array([0, len(pdf)]))


def _tables(lists: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, np.int64).reshape(4, 4) for x in lists])


def _product(tables: np.ndarray) -> np.ndarray:
    total = tables[0]
    for t in tables[1:]:
        total = min_plus(total[None], t[None])[0]
    return total


def _costs_to_go(tables: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(tables, 4): the costs to go behind each of the tables, where ``end`` are those behind the last."""
    out = [end]
    for t in tables[:0:-1]:
        out.append(np.minimum((t + out[-1][None]).min(axis=1), FAR))
    return np.array(out[::-1])


def _entered(maps: pd.Series, state: int) -> list[int]:
    """The state in which each of the state maps is entered."""
    out = [state]
    for m in maps[:-1]:
        out.append(int(m[out[-1]]))
    return out


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of long conversations: their counts (key, conv_id, COUNTS), and parts (conv_id, part, turns), one for each different row."""
    bits = STRETCH
    units = rows.groupBy("conv_id", "turn", "h1", "h2").agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("role", "text", "initial", "blank", "whole")])
    units = cut(units.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), "units")
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = units.groupBy("key", "h1", "h2").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.coalesce(turn > F.col("first"), F.lit(False)) & ~F.col("blank")
    units = units.join(first, ["key", "h1", "h2"], "left").withColumn("same", same).drop("first", "h1", "h2")
    kind = F.when(F.col("blank") | F.col("same"), 0).when(F.col("whole"), 1).otherwise(2)
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role")]
    laid = units.withColumns({"kind": kind, "extra": F.col("m") - 1}).repartitionByRange(*order, F.substring("text", 1, 256)).sortWithinPartitions(*order, "text")
    laid = cut(laid.withColumn("at", F.monotonically_increasing_id()), "laid")
    by_part = ["key", "part"]
    part = F.shiftright("stretch", 33 - bits).alias("part")

    def table(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = _as_rows(pdf)
        wrong = int(_illegal(rows.initial[:-1], rows.initial[1:]).sum() + rows.extra.sum())
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "stretch": [int(pdf["at"].iloc[0]) >> bits], "costs": [rows.costs()[0].reshape(-1).tolist()], "illegal": [wrong], "head": [int(rows.initial[0])], "foot": [int(rows.initial[-1])]})

    state = "costs array<long>, illegal long, head int, foot int"
    tables = cut(_stretches(laid, None, table, f"key string, stretch long, {state}").withColumn("part", part), "tables")

    def together(place: str) -> Callable:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(place)
            head, foot = pdf["head"].to_numpy(), pdf["foot"].to_numpy()
            wrong = int(pdf["illegal"].sum() + _illegal(foot[:-1], head[1:]).sum())
            return pd.DataFrame({"key": pdf["key"].iloc[:1], "part": pdf["part"].iloc[:1], "costs": [_product(_tables(pdf["costs"])).reshape(-1).tolist()], "illegal": [wrong], "head": [head[0]], "foot": [foot[-1]]})

        return run

    parts = cut(tables.groupBy(by_part).applyInPandas(together("stretch"), f"key string, part long, {state}"), "parts")
    totals = parts.groupBy("key").applyInPandas(together("part"), f"key string, part long, {state}")

    def ends_of_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return pdf[["key", "part"]].assign(exits=list(_costs_to_go(_tables(pdf["costs"]), AT_END).tolist()))

    ends = parts.groupBy("key").applyInPandas(ends_of_parts, "key string, part long, exits array<long>")

    def ends_of_stretches(pdf: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch")
        return pdf[["key", "part", "stretch"]].assign(exits=list(_costs_to_go(_tables(pdf["costs"]), np.asarray(end["exits"].iloc[0], np.int64)).tolist()))

    exits = tables.groupBy(by_part).cogroup(ends.groupBy(by_part)).applyInPandas(ends_of_stretches, "key string, part long, stretch long, exits array<long>")

    def audits(pdf: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = _as_rows(pdf)
        paths = Paths(rows, np.array([end["exits"].iloc[0]], np.int64))
        found = [paths.follow(np.array([q])) for q in range(4)]
        steps = ["".join(LETTERS[k] for k in paths.letter[node]) for _, node, _ in found]
        return pd.DataFrame({"key": end["key"], "part": end["part"], "stretch": end["stretch"], "goes": [[int(s[0]) for _, _, s in found]], "audits": [steps]})

    walked = cut(_stretches(laid, exits, audits, "key string, part long, stretch long, goes array<int>, audits array<string>"), "audits")

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        maps = pdf.sort_values("stretch")["goes"].tolist()
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "part": pdf["part"].iloc[:1], "goes": [[int(maps[-1][_entered(maps, q)[-1]]) for q in range(4)]]})

    maps = cut(walked.groupBy(by_part).applyInPandas(composed, "key string, part long, goes array<int>"), "maps")

    def entries_of_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        states = _entered(pdf["goes"].tolist(), 0)
        last = [*[-1] * (len(pdf) - 1), int(pdf["goes"].iloc[-1][states[-1]])]
        return pdf[["key", "part"]].assign(entry=states, final=last)

    entries = cut(maps.groupBy("key").applyInPandas(entries_of_parts, "key string, part long, entry int, final int"), "entries")

    def chosen(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch")
        states = _entered(pdf["goes"].tolist(), int(entry["entry"].iloc[0]))
        return pdf[["key", "stretch"]].assign(entry=states, audit=[a[q] for a, q in zip(pdf["audits"], states, strict=True)])

    picked = walked.groupBy(by_part).cogroup(entries.groupBy(by_part)).applyInPandas(chosen, "key string, stretch long, entry int, audit string")

    def by_row(pdf: pd.DataFrame, pick: pd.DataFrame) -> pd.DataFrame:
        """For each row the edits up to it, with the role that is due where one is given."""
        pdf, rows = _as_rows(pdf)
        state, at, out = int(pick["entry"].iloc[0]), 0, [[] for _ in range(len(pdf))]
        for letter in pick["audit"].iloc[0]:
            if letter == LETTERS[K]:
                state = int(KEPT[rows.initial[at], state])
            elif letter != LETTERS[D]:
                state = int(DUE[state])
            out[at].append({"edit": letter, "role": ("user" if state == 2 else "assistant") if letter in (LETTERS[I], LETTERS[R]) else None})
            at += letter != LETTERS[I]
        return pdf[["at"]].assign(edits=out)

    edits = _stretches(laid, picked, by_row, "at long, edits array<struct<edit:string,role:string>>")
    text = lambda e: F.when(e["edit"] == "I", "").when(e["edit"] != "D", F.col("text"))
    turns = F.transform("edits", lambda e: F.struct(e["edit"].alias("edit"), F.when(e["edit"] == "K", F.col("role")).otherwise(e["role"]).alias("role"), text(e).alias("text")))
    more = F.array_repeat(F.struct(F.lit("D").alias("edit"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")), F.col("extra").cast("int"))
    body = laid.select("conv_id", "at", "role", "text", "extra").join(edits, "at").select("conv_id", F.col("at").alias("part"), F.concat(turns, more).alias("turns"))
    inserted = [F.struct(F.lit("I").alias("edit"), F.lit(r).alias("role"), F.lit("").alias("text")) for r in ("user", "assistant")]
    tail = F.when(F.col("final") == 1, F.array(*inserted)).when(F.col("final") == 2, F.array(inserted[1]))
    tails = entries.where("final IN (1, 2)").select(F.col("key").try_cast("long").alias("conv_id"), F.lit(2**63 - 1).alias("part"), tail.alias("turns"))
    per = laid.groupBy("key", "conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("m")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("same"), F.col("m")).otherwise(F.col("m") - 1)).alias("duplicate"), F.sum((F.col("kind") == 2).cast("long")).alias("truncated"),
    )
    least = F.array_min(F.array(*[F.get("costs", F.lit(q)) + int(AT_END[q]) for q in range(4)]))
    counts = per.join(totals.select("key", "illegal", least.alias("cost")), "key").select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")
    return counts, body.union(tails)


# -- both ----------------------------------------------------------------------------------------------------------------


class Repair:
    """The repair of ``rows`` (conv_id, turn, role, text).

    Rows of a conversation stand by turn, nulls first, then by role and text. A null role or text counts as one space. The
    first fault of a row counts: blank (nothing but white space), duplicate (role and text stood before), truncated (it
    doesn't end in . ! or ?). Kept rows cost nothing, a new role 3, a deletion (required of blank and duplicate rows) 4, an
    inserted empty turn 3, and a truncated row that stays 3 more; the initials of what results are nothing or an s that may
    lack, then ua once or more. Of the cheapest audits the ASCII-least is taken. An empty role has no initial and is never
    kept as it is. Rows of a null conv_id are one conversation. No rows give none; other columns are ignored.
    """

    def __init__(self, rows: DataFrame):
        ship(rows.sparkSession)
        marked = _marked(rows)
        size = F.octet_length("text") + F.octet_length("role") + 32
        sizes = marked.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes")).where((F.col("n") > ROWS_WHOLE) | (F.col("bytes") > BYTES_WHOLE))
        ids = cut(sizes.select(F.col("conv_id").alias("_id")), "long-ones")
        self._whole, self._counts, self._parts = marked, None, None
        if not ids.isEmpty():
            of = F.col("conv_id").eqNullSafe(F.col("_id"))
            self._whole = marked.join(ids, of, "left_anti")
            self._counts, self._parts = _long(marked.join(ids, of, "left_semi"))
        self._whole = _whole(self._whole)

    def turns(self) -> DataFrame:
        """conv_id, part, step, edit (K, R, D or I), role and text (null where deleted) of every edit; (part, step) is the order."""
        out = self._whole.select("conv_id", F.lit(0).cast("long").alias("part"), "turns")
        out = out if self._parts is None else out.union(self._parts)
        return out.select("conv_id", "part", F.posexplode("turns").alias("step", "t")).select("conv_id", "part", "step", "t.*")

    def digests(self) -> DataFrame:
        """conv_id, COUNTS, audit and repaired_sha256 (of the lines ``role:text``) of each conversation that has rows."""
        line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
        stay = lambda c: F.transform(F.filter(c, lambda t: t["edit"] != "D"), line)
        out = self._whole.select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(stay("turns"), "\n"), 256).alias("repaired_sha256"))
        if self._parts is None:
            return out
        pieces = self._parts.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["edit"]), "").alias("audit"), stay("turns").alias("lines"))
        hashed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_hashed, "id long, audit string, repaired_sha256 string")
        longer = self._counts.join(hashed, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", *COUNTS, "audit", "repaired_sha256")
        return out.union(longer)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and hash of each conversation, piece after piece; SHA-256 can't be taken in parts, so a conversation is
    streamed through one task, which holds a batch of its lines and its audit."""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array(["".join(audit)]), pa.array([total.hexdigest()])], names=["id", "audit", "repaired_sha256"])

    at, audit, total, lines = None, None, None, 0
    for batch in batches:
        for k, conv in enumerate(batch.column("conv_id").to_pylist()):
            if audit is None or conv != at:
                if audit is not None:
                    yield done()
                at, audit, total, lines = conv, [], hashlib.sha256(), 0
            audit.append(batch.column("audit")[k].as_py())
            for line in batch.column("lines")[k]:
                total.update(("\n" * (lines > 0) + line.as_py()).encode())
                lines += 1
    if audit is not None:
        yield done()
