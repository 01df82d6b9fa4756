"""Vectorised words of whole texts: positions and 64-bit hashes, a few MB of text at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A word's hash is a polynomial in its
bytes modulo 2^64 (one cumulative sum over the buffer, the difference at the word's ends, scaled
back to position 0), mixed with its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(_BASE) + np.uint64(2 * salt + 1) + (b ^ (b >> np.uint64(29))))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:  # as far as the longest piece so far needs and a quarter more, as workers keep them
        n += n >> 2
        for base, name in ((_BASE, "_powers"), (pow(_BASE, -1, 1 << 64), "_inverse")):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)


def _piece(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.ones(len(b) + 2, dtype=bool)
    edge[1:-1] = _SPACE[b]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = at[0::2], at[1::2]
    _grow(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * _powers[: len(b)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * _inverse[start] + (end - start).astype(np.uint64))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of lower-cased ``data``, cut at white space every few MB."""
    b, i, starts, hashes = np.frombuffer(data, dtype=np.uint8), 0, [], []
    while i < len(b):
        j = min(i + CHUNK, len(b))
        while j < len(b) and not (ends := _SPACE[b[j : j + CHUNK]]).any():
            j = min(j + CHUNK, len(b))
        if j < len(b):
            j += int(ends.argmax())
        s, _, h = _piece(b[i:j])
        starts.append(s + i)
        hashes.append(h)
        i = j
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def word_blocks(texts: pa.Array, block: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in blocks of a few MB: (first text, end, word bounds of each text, word hashes).

    Null texts count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    size = np.diff(np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]) if len(raw) else np.zeros(0, np.int64)
    first = 0
    while first < len(raw):
        end, room = first, block
        while end < len(raw) and (end == first or room >= size[end]):
            room -= size[end]
            end += 1
        starts, hashes = words(b"\n".join(raw.slice(first, end - first).to_pylist()).lower())
        at = np.concatenate(([0], np.cumsum(size[first:end] + 1)))
        yield first, end, np.searchsorted(starts, at), hashes
        first = end
