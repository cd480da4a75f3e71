"""Word and shingle hashes of whole texts as numpy arrays, for the operators that run in Arrow batches.

A word's hash is a polynomial over its UTF-8 bytes modulo 2^64, read off prefix sums, so no word becomes a Python object.
Texts are hashed in pieces of at most PIECE bytes, cut at white space where there is any, so memory is bounded by the text
itself. All hashes are then mixed; sequences of words are combined in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD6E8FEB86659FD93
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        out = np.full(size, base, U)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(raw, np.uint8)
    solid = np.empty(len(buf) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[buf], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers(len(buf), BASE)[: len(buf)], out=sums[1:])
    inverse = powers(len(buf), pow(BASE, -1, 1 << 64))
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), starts, ends


def words(text: str | None, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of the text's words, their start and end in the bytes that come last; A-Z lower-cased on demand."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if lower:
        raw = raw.translate(LOWER)
    if len(raw) <= PIECE:
        return *_piece(raw), raw
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + PIECE)
        while to < len(raw) and not SPACE[raw[to]]:
            to += 1
        h, s, e = _piece(raw[at:to])
        parts.append((h, s + at, e + at))
        at = to
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), raw


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by first word."""
    if len(h) < k:
        return np.zeros(0, U)
    out = np.zeros(len(h) - k + 1, U)
    for j in range(k):
        out = out * U(STEP) + h[j : len(h) - k + 1 + j]
    return mixed(out + U(k))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of k words; a shorter text is one shingle, a text without words has none."""
    return np.unique(grams(h, k if len(h) >= k else len(h))) if len(h) else np.zeros(0, U)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from numpy arrays, without Python numbers."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that what is derived from them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
