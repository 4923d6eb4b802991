"""Byte-level BPE by speculation and verification.

A text is cut into words by the vocabulary's pattern. For each distinct word, greedy longest match proposes tokens. A
proposal is what the merges would give exactly when each token is what its own bytes merge to and no merge would cross
the border of any two neighbours first; the borders of all proposals are tested together in NumPy. Words that fail are
merged exactly, by rank. Encoded words stay in a bounded cache of the worker; documents are then gathers from it.

Letters and numbers are those of Unicode 16, as for the tokenizers library; the ``regex`` package knows later ones too
(LATER), and texts that hold one of those are cut by a pattern without them.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from sextant.llm import textscan
from sextant.llm.shipping import ship

#: Fixed value: how byte-level vocabularies of this kind cut text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that Unicode 16 has not assigned and that later drafts, and so ``regex``, class as letters or numbers.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER_CLASS = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER)
#: Distinct words a worker remembers before it starts afresh.
CACHE_WORDS = 250_000
#: Words of more bytes than this are merged with a heap.
LONG_WORD = 100
_NEVER = 1 << 40
_SPACE_PAIRS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
#: White space that these pairs leave out; texts with any of it are cut by the slower pattern.
_OTHER_SPACE = re.compile(r"[^\S \n\t\r]")
_encoders: dict[str, BpeEncoder] = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeEncoder:
    """Tables of one vocabulary file (its JSON text) and a cache of encoded words."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)
        symbols = byte_symbols()
        spelled = {t: bytes(symbols[c] for c in t) for t in model["model"]["vocab"]}
        ids = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for t, i in ids.items():
            self.token_bytes[i] = spelled[t]
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.id_of = {spelled[t]: i for t, i in ids.items()}
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[a + b]
            self.merges[ids[a], ids[b]] = (rank, made)
            self.rank[made], self.left[made], self.right[made] = rank, ids[a], ids[b]
        codes = np.array([a << 20 | b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self._codes, self._code_rank = codes[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        joined = self.rank >= 0
        made = np.flatnonzero(joined)
        self.whole = np.zeros(size, bool)  # tokens that their own bytes merge to
        self.whole[[i for t, i in ids.items() if len(spelled[t]) == 1]] = True
        fits = np.zeros(size, bool)
        fits[made] = self.borders_hold(self.left[made], self.right[made], siblings=True)
        for i in made[np.argsort(self.rank[made])]:
            self.whole[i] = fits[i] and self.whole[self.left[i]] and self.whole[self.right[i]]
        self._rank_of = {pair: rank for pair, (rank, _) in self.merges.items()}
        self._made = [made for _, made in self.merges.values()]
        self._tree: dict = {}  # byte -> subtree; under -1 the token that ends there
        for t, i in self.id_of.items():
            at = self._tree
            for byte in t:
                at = at.setdefault(byte, {})
            at[-1] = i
        self._single = [self.id_of[bytes([b])] for b in range(256)]
        lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self._byte_at = np.concatenate([[0], np.cumsum(lengths)])
        self._bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self._words = regex.compile(PATTERN)
        self._later = re.compile(f"[{_LATER_CLASS}]")
        strict = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{_LATER_CLASS}])")
        strict = strict.replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{_LATER_CLASS}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{_LATER_CLASS}]]+")
        self._strict_words = regex.compile(strict, regex.V1)
        self._safe_space = regex.compile(r"(?<=\S) (?=\S)")
        self._special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget()

    def forget(self) -> None:
        # pieces by their text: those after a space, those at a start; then a place in the lists below
        self._inner: dict[str, int] = {}
        self._first: dict[str, int] = {}
        self._mark: dict[str, int] = {}
        self._text: list[str] = []
        self._ids, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self._word: dict[str, str] = {}

    # -- words ---------------------------------------------------------------------------------------------------------

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match. Every single byte is a token, so there always is a next one."""
        tree, out, start, n = self._tree, [], 0, len(word)
        while start < n:
            node, at = tree, start
            while at < n and (node := node.get(word[at])) is not None:
                at += 1
                if (token := node.get(-1)) is not None:
                    best, end = token, at
            out.append(best)
            start = end
        return out

    def borders_hold(self, a: np.ndarray, b: np.ndarray, siblings: bool = False) -> np.ndarray:
        """For each pair of neighbours whether no merge crosses their border before both are complete.

        Undoes the latest merge of either token step by step, on the border's side; at each step the two pieces there
        have stood beside each other, and a merge of them must not come before the merges that took them away. Of equal
        ranks the left place merges first. siblings: a and b are to merge with each other afterwards.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        gone_a, gone_b, good = np.full(len(a), _NEVER), np.full(len(a), _NEVER), np.ones(len(a), bool)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            if siblings:
                siblings, crosses = False, np.zeros(len(todo), bool)
            else:
                code = x << 20 | y
                at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
                found = np.where(self._codes[at] == code, self._code_rank[at], _NEVER)
                crosses = (found < gone_a[todo]) & (found <= gone_b[todo]) & (found < _NEVER)
            good[todo[crosses]] = False
            rank_a, rank_b = self.rank[x], self.rank[y]
            go = ~crosses & ((rank_a >= 0) | (rank_b >= 0))
            undo_a = go & (rank_a > rank_b)
            undo_b = go & ~undo_a
            gone_a[todo[undo_a]], a[todo[undo_a]] = rank_a[undo_a], self.right[x[undo_a]]
            gone_b[todo[undo_b]], b[todo[undo_b]] = rank_b[undo_b], self.left[y[undo_b]]
            todo = todo[go]
        return good

    def merge(self, word: bytes) -> list[int]:
        """The exact tokens of a word: the leftmost pair of the lowest rank merges until none is left."""
        one = self._single
        tokens = [one[x] for x in word]
        if len(tokens) <= LONG_WORD:
            get = self._rank_of.get
            ranks = [get(p, _NEVER) for p in zip(tokens, tokens[1:])]
            while ranks and (least := min(ranks)) < _NEVER:
                k = ranks.index(least)
                tokens[k] = self._made[least]
                del tokens[k + 1], ranks[k]
                if k < len(ranks):
                    ranks[k] = get((tokens[k], tokens[k + 1]), _NEVER)
                if k:
                    ranks[k - 1] = get((tokens[k - 1], tokens[k]), _NEVER)
            return tokens
        n, merges = len(tokens), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, tokens[k], tokens[k + 1], m[1]) for k in range(n - 1) if (m := merges.get((tokens[k], tokens[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            nxt = after[k]
            if tokens[k] != a or nxt >= n or tokens[nxt] != b:
                continue
            tokens[k], tokens[nxt] = made, -1
            after[k] = end = after[nxt]
            if end < n:
                before[end] = k
                if m := merges.get((made, tokens[end])):
                    heapq.heappush(heap, (m[0], k, made, tokens[end], m[1]))
            if (p := before[k]) >= 0 and (m := merges.get((tokens[p], made))):
                heapq.heappush(heap, (m[0], p, tokens[p], made, m[1]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """Tokens of each word, and which proposals failed the test and were merged exactly."""
        proposed = [self.propose(w) for w in words]
        lengths = np.array([len(p) for p in proposed], np.int64)
        flat = np.array([t for p in proposed for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        failed = np.zeros(len(words), bool)
        failed[owner[~self.whole[flat]]] = True
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][inner] << 20 | flat[1:][inner], return_inverse=True)
        holds = self.borders_hold(pairs >> 20, pairs & ((1 << 20) - 1))
        failed[owner[1:][inner][~holds[back]]] = True
        for k in np.flatnonzero(failed).tolist():
            proposed[k] = self.merge(words[k])
        return proposed, failed

    def words(self, text: str) -> list[str]:
        """The words that a text is cut into before merging."""
        return (self._strict_words if not text.isascii() and self._later.search(text) else self._words).findall(text)

    # -- texts ---------------------------------------------------------------------------------------------------------

    def _learn(self, pieces: Iterable[tuple[dict[str, int], str, str]]) -> None:
        """Add pieces (their table, key and text); a piece is a stretch between two safe borders."""
        pieces = list(pieces)
        # letters alone are one word
        cut = [[text] if key.isalpha() else self.words(text) for _, key, text in pieces]
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self._word]
        if new:
            tokens = self.encode_words([w.encode() for w in new])[0]
            self._word.update(zip(new, [",".join(map(str, t)) for t in tokens], strict=True))
        word = self._word
        texts = [word[ws[0]] if len(ws) == 1 else ",".join([word[w] for w in ws]) for ws in cut]
        for k, (table, key, _) in enumerate(pieces, len(self._text)):
            table[key] = k
        self._append(texts)

    def _append(self, texts: list[str]) -> None:
        self._text += texts
        joined = ",".join(t for t in texts if t)
        ids = np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32)
        counts = np.array([t.count(",") + 1 if t else 0 for t in texts], np.int64)
        self._ids = np.concatenate([self._ids, ids])
        self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(counts)])

    def _pieces(self, text: str) -> list[str]:
        """A text cut at spaces between two visible characters, each of which is always the start of a word."""
        if any(x in text for x in _SPACE_PAIRS) or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text):
            return self._safe_space.split(text)
        return text.split(" ")

    def encode_batch(self, texts: list[str], special: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All token ids, the number of each text, and each text's ids as decimals joined by commas.

        special: strings of special tokens in a text become those tokens; else they are ordinary text.
        """
        if len(self._text) > CACHE_WORDS:
            self.forget()
        # each text as stretches between special tokens: (special token before or None, pieces)
        stretches: list[list[tuple[str | None, list[str]]]] = []
        for text in texts:
            found, at, before = [], 0, None
            if special and self._special:
                for m in self._special.finditer(text):
                    found.append((before, self._pieces(text[at : m.start()]) if m.start() > at else []))
                    at, before = m.end(), m[0]
            found.append((before, self._pieces(text[at:]) if len(text) > at else []))
            stretches.append(found)
        parts = [p for found in stretches for _, p in found if p]
        inner = set(chain.from_iterable(p[1:] for p in parts)) - self._inner.keys()
        first = {p[0] for p in parts} - self._first.keys()
        marks = {m for found in stretches for m, _ in found if m is not None} - self._mark.keys()
        self._learn(chain(((self._inner, x, " " + x) for x in inner), ((self._first, x, x) for x in first)))
        for mark in marks:
            self._mark[mark] = len(self._text)
            self._append([str(self.special[mark])])
        index: list[list[int]] = []
        for found in stretches:
            row: list[int] = []
            for mark, p in found:
                if mark is not None:
                    row.append(self._mark[mark])
                if p:
                    row.append(self._first[p[0]])
                    row.extend(map(self._inner.__getitem__, p[1:]))
            index.append(row)
        text_of = self._text.__getitem__
        strings = [",".join(map(text_of, x)) for x in index]
        sizes = list(map(len, index))
        flat = np.fromiter(chain.from_iterable(index), np.int64, sum(sizes))
        starts = self._at[flat]
        counts = self._at[flat + 1] - starts
        ids = self._ids[_ranges(starts, counts)]
        per_piece = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum([0, *sizes])
        return ids, per_piece[ends[1:]] - per_piece[ends[:-1]], strings

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 of each text; bytes that are no character become U+FFFD."""
        starts, lengths = self._byte_at[ids], self._byte_at[ids + 1] - self._byte_at[ids]
        data = self._bytes[_ranges(starts, lengths)].tobytes()
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:], strict=False)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of [start, start + length) of each, one after another."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def encoder(vocabulary: str) -> BpeEncoder:
    """This worker's encoder of a vocabulary."""
    name = hashlib.sha256(vocabulary.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = BpeEncoder(vocabulary)
        gc.collect()
        gc.freeze()  # the tables hold no cycles and need not be walked again
    return _encoders[name]


RESULT = ("n_tokens", "ids_sha256", "decoded_sha256")


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` without its text, and RESULT: tokens, hash of the ids, hash of the text decoded from them again.

    vocabulary_path is read by the driver and broadcast (a few MB). with_ids adds ``token_ids``, the ids as little-endian
    uint32. A null text counts as empty: 0 tokens. Repeated rows give repeated results and an empty table none. Columns of
    ``docs`` named as results are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    extra = (*RESULT, "token_ids") if with_ids else RESULT
    names = [c for c in docs.columns if c.lower() not in extra and c != text]
    renamed = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary.value)
        for whole in batches:
            for batch in textscan.batches_by_bytes(whole, text, 2 << 20):
                texts = [x or "" for x in batch.column(text).to_pylist()]
                gc.disable()  # a batch makes very many small lists and no cycles
                ids, counts, strings = bpe.encode_batch(texts)
                gc.enable()
                made = [pa.array(counts, pa.int64())]
                made.append(pa.array([hashlib.sha256(s.encode()).hexdigest() for s in strings], pa.string()))
                made.append(pa.array([hashlib.sha256(b).hexdigest() for b in bpe.decode_batch(ids, counts)], pa.string()))
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
                    made.append(pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + made, names=[*names, *extra])

    kinds = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType(), "token_ids": BinaryType()}
    schema = StructType([renamed.schema[c] for c in names] + [StructField(c, kinds[c]) for c in extra])
    return renamed.mapInArrow(run, schema)
