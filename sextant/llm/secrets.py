"""Secret scans with assignment-aware lexing.

Three base patterns are matched everywhere. Texts that name something sensitive are also lexed (``lexing``): assignments
of source code and configuration give pairs of a target and a value of literals and names, and a name assigned a literal
is a constant, so that a sensitive target that refers to constants is traced to the literals' own places. The password in an
address (scheme://user:password@host) counts without a target. A value is
scored by how sensitive its target's name is and how much it looks like a key rather than like prose or a placeholder.

Each document is scanned whole and alone, in time linear in its length. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sextant.llm import lexing, textscan
from sextant.llm.shipping import ship

#: The base patterns, in the order of their kinds, and what a match needs to count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "lexed")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: The password of an address, which needs no target: what stands between a user's name and the host.
ADDRESS = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\s/:@"'<>]{0,200}:([^\s/@"'<>]{8,200})@[A-Za-z0-9\[]""", re.ASCII)
_BASE_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of names that make a target sensitive, and literals that stand for a value to be filled in.
SENSITIVE = ("password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "apikey", "credential", "credentials", "privatekey", "accesskey", "secretkey", "authkey", "signingkey", "encryptionkey", "bearer")
#: What makes a key of which a name speaks a secret one; "public key", "primary key" and "sort key" are none.
KEY_OWNERS = ("ssh", "rsa", "aes", "hmac", "pgp", "gpg", "tls", "ssl", "jwt", "api", "app", "auth", "host", "master", "access", "account", "client", "crypto", "decryption", "deploy", "encryption", "license", "private", "root", "secret", "service", "session", "shared", "signing", "storage", "webhook")
PLACEHOLDERS = ("changeme", "change_me", "placeholder", "example", "dummy", "redacted", "undefined", "your_", "your-", "xxxxxxxx", "********", "<", "${", "{{", "%(")
SENSITIVE_POINTS = 2
ENOUGH_POINTS = 4

_WORD_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> int:
    """SENSITIVE_POINTS if a part of the name, or two neighbouring ones together, is a sensitive word or a key with a secret
    owner just before it; else 0."""
    parts = [p.lower() for p in _WORD_PARTS.findall(name)]
    pairs = list(zip(parts, parts[1:], strict=False))
    joined = [*parts, *(a + b for a, b in pairs), name.lower()]
    return SENSITIVE_POINTS if any(p in SENSITIVE for p in joined) or any(a in KEY_OWNERS and b == "key" for a, b in pairs) else 0


def literal_points(value: lexing.Sum) -> int:
    """0 to 3: long enough, of mixed characters, of high entropy; -3 for prose and placeholders."""
    if value.length < 8 or value.spaced or value.placeholder:
        return -3
    chars = value.counts
    kinds = sum(any(map(test, chars)) for test in (_lower, _upper, _digit, _sign))
    entropy = -sum(n / value.length * math.log2(n / value.length) for n in chars.values())
    return 1 + (kinds >= 2) + (entropy >= 2.75)


def _lower(c: str) -> bool:
    return "a" <= c <= "z"


def _upper(c: str) -> bool:
    return "A" <= c <= "Z"


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _sign(c: str) -> bool:
    return not (_lower(c) or _upper(c) or _digit(c))


def is_placeholder(value: str) -> bool:
    low = value.lower()
    return any(p in low for p in PLACEHOLDERS)


def lex(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive target.

    A value without quotes counts only if it has all points and a digit, as a word or a path of names is mostly no literal.
    """
    read = lexing.assignments(text)
    chosen = []
    for made, value, place in read.resolve(lambda target: sensitivity(target) > 0, is_placeholder):
        bare_word = not value.quoted and not any(map(_digit, value.counts))
        if not bare_word and sensitivity(made.target) + literal_points(value) >= ENOUGH_POINTS + (not value.quoted):
            chosen.append(place)
    return sorted(s for s in read.literals(chosen) if s[1] > s[0])


def scan_text(text: str, may_hold_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, ascending; kind is a place in KINDS."""
    low = text.lower()
    spans = []
    if any(w in low for w in _BASE_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if may_hold_hex:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    lexed = set(lex(text)) if worth_lexing(low) else set()
    if "://" in text:
        lexed |= {m.span(1) for m in ADDRESS.finditer(text) if not is_placeholder(m[1])}
    return sorted([*spans, *((a, 3, b) for a, b in lexed)])


#: Every sensitive word holds one of these; in a text its parts may stand apart by what joins the parts of a name.
_LEX_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")
_JOINTS = ("_", "-", ".", "$")


def worth_lexing(low: str) -> bool:
    """Whether a text in lower case can name something sensitive."""
    if any(w in low for w in _LEX_WORDS):
        return True
    for joint in _JOINTS:
        low = low.replace(joint, "")
    return any(w in low for w in _LEX_WORDS)


def _long_hex_rows(column: pa.Array) -> np.ndarray:
    """Which texts hold a run of LEAST_HEX characters 0-9a-f."""
    data, offsets = textscan.utf8(column)
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(97, 103)]] = True
    other = np.flatnonzero(~table[data])
    edges = np.concatenate([[-1], other, [len(data)]])
    begins = edges[:-1][np.diff(edges) > LEAST_HEX] + 1
    out = np.zeros(len(offsets) - 1, bool)
    # a run over the border of two texts only makes the second look
    for a in begins:
        b = edges[np.searchsorted(edges, a)]
        out[np.searchsorted(offsets, a, "right") - 1 : np.searchsorted(offsets, b, "left")] = True
    return out


RESULT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, and RESULT.

    Counts of the base kinds; the hash of the base spans as kind:start:end joined by commas; all spans likewise, among
    them ``lexed`` ones. A null text counts as empty: no spans, the hash of "". Clashing columns are replaced.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in RESULT and c != text]
    chosen = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.batches_by_bytes(whole, text):
                hexes = _long_hex_rows(batch.column(text)).tolist()
                found = [scan_text(x or "", h) for x, h in zip(batch.column(text).to_pylist(), hexes, strict=True)]
                named = [[(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in spans] for spans in found]
                counts = [pa.array([sum(k == kind for k, _ in x) for x in named], pa.int64()) for kind in range(3)]
                base = pa.array([hashlib.sha256(",".join(s for k, s in x if k < 3).encode()).hexdigest() for x in named], pa.string())
                every = pa.array([",".join(s for _, s in x) for x in named], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [*counts, base, every], names=[*names, *RESULT])

    schema = StructType([chosen.schema[c] for c in names] + [StructField(c, LongType()) for c in RESULT[:3]] + [StructField(c, StringType()) for c in RESULT[3:]])
    return chosen.mapInArrow(run, schema)
