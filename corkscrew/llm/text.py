"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents is split into words and hashed without a Python object per
word. A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``; these
separators are single ASCII bytes, so byte boundaries are word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Odd multipliers of the polynomial hashes (bytes in a word, words in a window).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def row_slices(arr: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges holding about ``max_bytes`` of text each (one row at least)."""
    _, off = utf8(arr)
    lo = 0
    while lo < len(arr):
        hi = int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), len(arr))
        yield lo, hi
        lo = hi


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    _, offsets, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``inside`` bytes that do not cross a text's border.

    Returns starts, ends (byte positions) and ``bounds``: text ``d`` owns runs
    ``bounds[d]:bounds[d + 1]``.
    """
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = off[:-1][off[:-1] < n]
    before[first] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~SPACE[data], off)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each byte span (spans ascend and do not overlap)."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    byte = data[place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1 + seed)
    h = np.add.reduceat(byte * powers(BYTE_BASE + 2 * seed, int(size.max()))[place], first)
    return mix(h + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values, by one rolling sum.

    ``sum(h[i + j] * B**j)`` is taken from prefix sums; the base is odd, so
    its inverse modulo 2**64 exists and moves each sum back to exponent zero.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up = powers(WORD_BASE, len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    down = powers(pow(WORD_BASE, -1, 1 << 64), len(h) - n + 1)
    return mix((total[n:] - total[:-n]) * down)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Number of the text that owns each run."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def inside_text(owner: np.ndarray, n: int) -> np.ndarray:
    """For each window start of width ``n``: does the window stay in one text?"""
    return owner[: len(owner) - n + 1] == owner[n - 1 :]


def covered(marked: np.ndarray, n: int, total: int) -> np.ndarray:
    """Positions covered by a marked window of width ``n``."""
    seen = np.concatenate([[0], np.cumsum(marked)])
    at = np.arange(total)
    hi = np.minimum(at + 1, len(marked))
    lo = np.clip(at + 1 - n, 0, len(marked))
    return seen[hi] > seen[lo]


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found before, found twice or more) for each key, in place order."""
    later = np.zeros(len(key), bool)
    twice = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return later, twice


def stretches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A space put before each non-empty text, and where its stretches start:
    at spaces that stand alone between two other characters, the second of
    them visible.

    Returns the new bytes, the starts (with the total length at the end) and
    ``bounds``: text ``d`` owns stretches ``bounds[d]:bounds[d + 1]``.
    """
    has = np.diff(off) > 0
    shift = np.cumsum(has)
    out = np.full(len(data) + int(shift[-1] if len(shift) else 0), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift, np.diff(off))] = data
    new = off + np.concatenate([[0], shift])
    first = np.zeros(len(out) + 1, bool)
    first[new[:-1][has]] = True
    space = out == 0x20
    after = np.append(out[1:], 0x20)
    visible = (after > 0x20) & (after < 0x7F) | (after > 0xC2) & ((after < 0xE1) | (after > 0xE3))
    alone = np.concatenate([[False], ~space[:-1]]) & space & visible
    last = new[1:][has] - 1
    alone[last] = False
    first[:-1] |= alone
    start = np.flatnonzero(first[:-1])
    return out, np.append(start, len(out)), np.searchsorted(start, new)


def distinct_strings(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(number of each string ``data[start[i]:start[i + 1]]`` among the distinct ones, these)."""
    strings = pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()
