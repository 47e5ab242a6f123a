"""Vectorised text primitives over Arrow string batches (numpy, no per-row Python).

A *word* is a longest run of letters and digits, lower-cased. Word and word-run hashes are polynomial hashes over a
random 64-bit value per code point, obtained for all words at once from one prefix sum, so a batch costs a few array
operations per character however its characters are spread over rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters handled by one set of array operations; longer single texts are handled whole.
CHUNK_CHARS = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Letters and digits are all below this code point; above are tags, variation selectors and private use.
LETTERS_END = 0x40000


@lru_cache(maxsize=8)
def category_table(categories: tuple[str, ...]) -> np.ndarray:
    """Per code point: does its general category begin with one of ``categories`` (kinds of letters or digits)?"""
    out = np.zeros(0x110000, bool)
    out[:LETTERS_END] = [unicodedata.category(chr(c)).startswith(categories) for c in range(LETTERS_END)]
    return out


def alnum_table() -> np.ndarray:
    """Per code point: is it a letter or a digit (general categories L* and N*)."""
    return category_table(("L", "N"))


@lru_cache(maxsize=1)
def hash_table() -> np.ndarray:
    """Per code point: the 64-bit value of its lower-case form."""
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(LETTERS_END):
        s = chr(c).lower()
        if len(s) == 1:
            low[c] = ord(s)
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(BASE))[low]


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    have = _powers.get("pow")
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_CHARS)
        base = np.full(size, BASE, np.uint64)
        base[0] = 1
        inverse = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _powers["pow"], _powers["inv"] = np.cumprod(base), np.cumprod(inverse)
    return _powers["pow"][:n], _powers["inv"][:n]


def chunks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, str]]:
    """Split a string array into pieces of about ``size`` (CHUNK_CHARS) bytes: first row, code points, row offsets, the joined string.
    Nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    filled = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + n + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + (size or CHUNK_CHARS), side="right")) - 1
        end = min(max(end, row + 1), n)
        part = raw[offsets[row] : offsets[end]]
        text = part.tobytes().decode("utf-8")
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        rel = offsets[row : end + 1] - offsets[row]
        if len(cps) != len(part):
            lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            rel = lead[rel]
        yield row, cps, rel, text
        row = end


def words(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word of a chunk."""
    n = len(cps)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = alnum_table()[cps]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row boundary always ends a word
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    power, inverse = powers(n)
    value = hash_table()[cps] * power
    value[~inside] = 0
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    hashes = mix((total[e] - total[s]) * inverse[s])
    rows = np.searchsorted(offsets, s, side="right") - 1
    return hashes, rows, s, e


def runs(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every run of ``k`` consecutive words within one row, and the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], out=total[1:])
    first = np.flatnonzero(rows[k - 1 :] == rows[:n])
    return mix((total[first + k] - total[first]) * inverse[first]), first


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the sorted row numbers ``rows`` by row: n + 1 values."""
    return np.searchsorted(rows, np.arange(n + 1))


def sequence_hash(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One hash per row over its whole word sequence; rows without words get a fixed value."""
    power, inverse = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], out=total[1:])
    length = (off[1:] - off[:-1]).astype(np.uint64)
    return mix((total[off[1:]] - total[off[:-1]]) * inverse[off[:-1]] + length * np.uint64(0x632BE59BD9B4E019))


def minhashes(shingles: np.ndarray, off: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` minhash values (32 bits) per row from its shingle hashes; rows without shingles get the maximum."""
    rng = np.random.default_rng(seed)
    multipliers = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(off) - 1, count), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        at = off[full]
        for k in range(count):
            out[full, k] = np.minimum.reduceat(((shingles * multipliers[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a two-dimensional uint8 array."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def binary_rows(column: pa.Array, width: int) -> np.ndarray:
    """The reverse of fixed_binary."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), np.uint8)
    off = np.frombuffer(column.buffers()[1], np.int32)
    start = off[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + width * len(column)].reshape(len(column), width)
