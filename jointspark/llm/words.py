"""Vectorised word kernel shared by the text operators.

A word is a maximal run of bytes other than space and \\t..\\r.  Texts arrive as Arrow string
batches; :func:`pieces` cuts a batch into slices of bounded size (one document at least), and
:func:`word_hashes` turns a slice into 64-bit word hashes with a few numpy passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one slice holds unless a single document is longer.
PIECE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 2
_INVERSE = pow(_BASE, -1, 1 << 64)
_COEFFICIENTS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[base] = known = out
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place where possible."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of each row's bytes) over whole rows; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the index of each row's first word (with a last entry: all words)."""
    white = _WHITE[data]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = white[:-1]
        after[:-1] = white[1:]
        before[edges] = True
        after[edges[1:] - 1] = True
    before &= ~white
    after &= ~white
    starts = np.flatnonzero(before)
    return starts, np.flatnonzero(after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased if asked), its byte span, and each row's first word index."""
    starts, ends, first = word_spans(data, offsets)
    running = np.zeros(len(data) + 1, np.uint64)
    np.multiply((_LOWER if lower else _TABLE)[data], _power(_BASE, len(data)), out=running[1:])
    np.cumsum(running[1:], out=running[1:])
    hashes = mix((running[ends] - running[starts]) * _power(_INVERSE, len(data) + 1)[starts])
    return hashes, starts, ends, first


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of every window of ``width`` words inside one row, and each row's first window index."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], counts), at


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` words from each start."""
    n = len(words) - width + 1
    if n <= 0 or not len(starts):
        return np.zeros(0, np.uint64)
    total = words[:n] * _COEFFICIENTS[0]
    for k in range(1, width):
        total += words[k : k + n] * _COEFFICIENTS[k]
    return mix(total[starts])
