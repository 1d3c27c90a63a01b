"""Vectorised scans over the UTF-8 bytes of an Arrow column: words, hashes, windows.

A word hash mixes the word's bytes eight at a time, each step a keyed finaliser of all bytes
before, so that no family of words collides by its form. A span hash is a polynomial over a
random byte table modulo 2**64: prefix sums give the hash of any span of a chunk without a
Python loop, but chosen texts can collide, so it only ever groups what is compared later.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps its own ways
    _trim = None


def release() -> None:
    """Gives memory that is free in this worker back to the machine, for the workers beside it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        have = _powers[base] = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U64(29))) * U64(0xA0761D6478BD642F)
        return x ^ (x >> U64(32))


def chunks(column: pa.Array, max_bytes: int = 1 << 21):
    """(first row, bytes, offsets) of runs of rows, about ``max_bytes`` each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE):
    """Starts and ends of maximal runs outside ``separator``; runs stop at row ends.

    The third array has, for each row, the index of its first word (and the total).
    """
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Prefix sums of ``code[byte] * BASE**i``; ``span_hash`` reads them."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(code[data] * powers(BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free polynomial hash of [start, end) spans, not yet mixed."""
    with np.errstate(over="ignore"):
        return (prefix[ends] - prefix[starts]) * powers(BASE_INV, len(prefix))[starts]


#: Words of more than eight times as many bytes are hashed one by one.
LANES = 8
#: The first n of eight bytes.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros past the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << U64(8 * step)
    return x


def word_hashes(data, offs, separator=SPACE, lower=LOWER):
    """(hash of each word with bytes mapped by ``lower``, row boundaries in words)."""
    starts, ends, rows = word_spans(data, offs, separator)
    low = lower[data]
    size = ends - starts
    eight = lanes(low)
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F) + U64(0x27D4EB2F165667C5)
        live = np.arange(len(starts))
        for k in range(LANES):
            live = live[size[live] > 8 * k]
            if not len(live):
                break
            left = np.minimum(size[live] - 8 * k, 8)
            h[live] = mix(h[live] ^ mix((eight[starts[live] + 8 * k] & MASKS[left]) + U64(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(size > 8 * LANES):
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : ends[i]].tobytes(), 42)
    return h, rows


def sums_by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive boundaries ``rows``, each row on its own."""
    n = len(rows) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(rows)), weights=values, minlength=n)
