"""Word shingles of whole texts as sorted sets of 64-bit hashes, and their one-permutation MinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from sextant.llm import textscan

_U64 = np.uint64
_STEP = _U64(0x2545F4914F6CDD1D)
_EMPTY = _U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its distinct ``width``-word shingles, ascending; A-Z count as a-z.

    A text of fewer words has one shingle, its whole word sequence; one without words has none.
    """
    words = textscan.scan(texts, lower_ascii=True)
    hashes, first = textscan.hash_words(words), words.first
    rolled = np.zeros(max(0, len(hashes) - width + 1), _U64)
    for k in range(width):
        rolled = rolled * _STEP + hashes[k : k + len(rolled)]
    rolled = textscan.mix(rolled + _U64(width))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            whole = np.zeros(1, _U64)
            for k in range(a, b):
                whole = whole * _STEP + hashes[k : k + 1]
            out.append(textscan.mix(whole + _U64(b - a)))
        else:
            out.append(np.zeros(0, _U64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _probe(bins: int, turn: int) -> np.ndarray:
    """The bin that each of ``bins`` bins looks at in a turn of its probe sequence, the same for all sets."""
    return (textscan.mix(np.arange(bins, dtype=_U64) + _U64(turn * bins + 0x51ED270B)) % _U64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification, a row of ``bins`` values for each set that isn't empty.

    The hash range is cut into ``bins`` parts and each keeps its least hash. An empty bin borrows the value of the first
    filled bin along its own fixed random probe sequence, however far that is, which keeps P(equal) = Jaccard for every bin.
    """
    sets = [s for s in sets if len(s)]
    lengths = np.array([len(s) for s in sets], np.int64)
    if not len(lengths):
        return np.zeros((0, bins), _U64)
    flat = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)), lengths) * bins + ((flat >> _U64(32)) * _U64(bins) >> _U64(32)).astype(np.int64)
    opens = np.concatenate([[True], place[1:] != place[:-1]])
    raw = np.full(len(sets) * bins, _EMPTY, _U64)
    raw[place[opens]] = flat[opens]
    raw = raw.reshape(len(sets), bins)
    out = raw.copy()
    row, column = np.nonzero(out == _EMPTY)
    turn = 0
    while len(row):
        found = raw[row, _probe(bins, turn)[column]]
        filled = found != _EMPTY
        out[row[filled], column[filled]] = found[filled]
        row, column, turn = row[~filled], column[~filled], turn + 1
    return out


def bands(signature: np.ndarray, count: int) -> np.ndarray:
    """``count`` bucket names for each row, one for each band of bins/count values; bands don't share names."""
    rows, bins = signature.shape
    width = bins // count
    parts = signature.reshape(rows, count, width)
    out = np.broadcast_to(textscan.mix(np.arange(1, count + 1, dtype=_U64) * _STEP), (rows, count)).copy()
    for k in range(width):
        out = textscan.mix(out * _STEP + parts[:, :, k])
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """One bit of each value of a signature, 64 to a word; where values differ the bits do half the time, bin by bin."""
    rows, bins = signature.shape
    salted = textscan.mix(signature + np.arange(bins, dtype=_U64) * _STEP)
    return np.packbits((salted >> _U64(63)).astype(np.uint8), axis=1).view(_U64).reshape(rows, bins // 64)
