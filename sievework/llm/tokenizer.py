"""Problem 8: encoding of a whole corpus with a public byte-level BPE vocabulary.

Pre-tokenisation runs without regular expressions. Every code point is mapped to a class; every class is a function on
the states of a small automaton; the functions are closed under composition (a few hundred in all), so composing two of
them is one table look-up and the state before every character is an associative prefix scan, done block-wise for all
rows of a batch at once. Where class and state together begin a piece is a second look-up. The slices then go through a
cache of merged pieces, and their offsets are kept, so decoding is exact.

Results: null and empty texts give an empty list; strings of special tokens are ordinary text; rows are independent.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm import vec

#: Where the vocabulary files are; pass another path to ``encode`` elsewhere.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces remembered per worker; a full cache is emptied.
CACHE_PIECES = 400_000

# Character classes. APOS1 and APOS2 are apostrophes followed by a one- or two-letter ending (fixed values of the
# vocabulary's pattern: 's 't 'm 'd and 're 've 'll).
LETTER, DIGIT, OTHER, BLANK, SPACE, APOS1, APOS2, EDGE_SPACE, FIRST = 0, 1, 2, 3, 4, 5, 6, 7, 8
# States after a character: inside a run of letters, digits or others; after white space; after a space that leads the
# next piece; one or two letters of an ending still to come; and the start of a row.
IN_LETTER, IN_DIGIT, IN_OTHER, IN_BLANK, LEAD, ONE_LEFT, TWO_LEFT, DONE = range(8)


def _step(kind: int, state: int) -> tuple[int, bool]:
    """The automaton: state after a character of class ``kind``, and whether that character begins a piece."""
    if state == ONE_LEFT:
        return DONE, False
    if state == TWO_LEFT:
        return ONE_LEFT, False
    lead = state == LEAD
    if kind == LETTER:
        return IN_LETTER, not (lead or state == IN_LETTER)
    if kind == DIGIT:
        return IN_DIGIT, not (lead or state == IN_DIGIT)
    if kind in (APOS1, APOS2) and not (lead or state == IN_OTHER):
        return (ONE_LEFT if kind == APOS1 else TWO_LEFT), True
    if kind in (OTHER, APOS1, APOS2):
        return IN_OTHER, not (lead or state == IN_OTHER)
    if kind == BLANK:
        return IN_BLANK, state != IN_BLANK
    return (LEAD if kind == SPACE else DONE), True  # the last white space of a run, before another character


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition table of all functions the classes generate, the function of each class, the result of each function
    from the start state, and where (state, class) begins a piece."""
    kinds, states = 8, 8
    functions = [tuple(range(states))]
    base = [tuple(_step(k, s)[0] for s in range(states)) for k in range(kinds)]
    base.append(tuple([DONE] * states))  # the first character of a row is preceded by a reset
    index = {functions[0]: 0}
    for f in base:
        if f not in index:
            index[f] = len(functions)
            functions.append(f)
    grown = True
    while grown:
        grown = False
        for f in list(functions):
            for g in base:
                h = tuple(g[x] for x in f)
                if h not in index:
                    index[h] = len(functions)
                    functions.append(h)
                    grown = True
    n = len(functions)
    compose = np.array([[index.get(tuple(g[x] for x in f), 0) for g in functions] for f in functions], np.uint16)
    own = np.array([index[f] for f in base], np.uint16)
    apply = np.array(functions, np.uint8)
    begins = np.array([[_step(k, s)[1] for k in range(kinds)] for s in range(states)], bool)
    return compose, own, apply, begins


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    kind = {"L": LETTER, "N": DIGIT}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    # White space of Unicode (fixed values).
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return out


def piece_starts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins, for all rows of a chunk (``offsets``: row offsets in code points)."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    compose, own, apply, begins = _monoid()
    kind = class_table()[cps]
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True  # last character of a row
    # White space directly before another character ends its run: a space leads that piece, anything else stands alone.
    blank = kind == BLANK
    edge = np.zeros(n, bool)
    edge[:-1] = blank[:-1] & ~blank[1:]
    edge &= ~last
    kind[edge] = EDGE_SPACE
    kind[edge & (cps == 32)] = SPACE
    for at in np.flatnonzero((cps == 39) & ~last):  # apostrophes
        a = cps[at + 1]
        if a in (115, 116, 109, 100):
            kind[at] = APOS1
        elif at + 2 < n and not last[at + 1] and (a, cps[at + 2]) in ((114, 101), (118, 101), (108, 108)):
            kind[at] = APOS2
    f = own[kind]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    f[heads] = compose[own[FIRST], f[heads]]
    # Blocked scan: compose inside blocks (all blocks at once), then over the blocks, then apply to the block's entry.
    width = 64
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint16)
    padded[:n] = f
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    for i in range(1, width):
        grid[i] = compose[grid[i - 1], grid[i]]
    total, step = grid[-1].copy(), 1
    while step < blocks:  # the same scan in logarithmic steps over the blocks
        total[step:] = compose[total[:-step], total[step:]]
        step *= 2
    entry = np.full(blocks, DONE, np.uint8)
    entry[1:] = apply[total[:-1], DONE]
    after = apply[grid, entry[None, :]].T.reshape(-1)[:n]
    before = np.empty(n, np.uint8)
    before[0] = DONE
    before[1:] = after[:-1]
    before[heads] = DONE
    return np.flatnonzero(begins[before, kind])


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest-ranked adjacent pair first, in O(n log n) by a heap over linked parts."""
    if piece in rank:
        return [rank[piece]]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != length:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := rank.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, len(parts[x]) + len(parts[y])))
    return [rank[p] for p in parts if p is not None]


class Pieces(dict):
    """Piece -> its place in a growing flat table of ids."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat: list[int] = []
        self.start: list[int] = []
        self.length: list[int] = []

    def __missing__(self, piece: str) -> int:
        ids = merge(piece.encode("utf-8"), self.rank)
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.flat.extend(ids)
        self[piece] = at = len(self.start) - 1
        return at


_caches: dict[str, Pieces] = {}


def encode_array(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows, row offsets into them, and for every id the code point at which its piece begins."""
    pieces = _caches.setdefault(path, Pieces(path))
    all_ids, counts, spots = [], [], []
    for _, cps, offsets, text in vec.chunks(texts):
        if len(pieces) > CACHE_PIECES:
            pieces.reset()
        starts = piece_starts(cps, offsets)
        ends = np.append(starts[1:], len(cps))
        a, b = starts.tolist(), ends[: len(starts)].tolist()
        at = np.fromiter(map(pieces.__getitem__, [text[i:j] for i, j in zip(a, b)]), np.int64, len(a))
        length = np.array(pieces.length, np.int64)[at] if len(a) else at
        total = np.concatenate(([0], np.cumsum(length)))
        first = np.array(pieces.start, np.int64)[at] if len(a) else at
        index = np.repeat(first - total[:-1], length) + np.arange(total[-1])
        all_ids.append(np.array(pieces.flat, np.int32)[index] if len(a) else np.zeros(0, np.int32))
        spots.append(np.repeat(starts - offsets[np.searchsorted(offsets, starts, side="right") - 1], length))
        counts.append(np.diff(total[np.searchsorted(starts, offsets)]))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    return np.concatenate(all_ids), np.concatenate(([0], np.cumsum(np.concatenate(counts)))), np.concatenate(spots)


def encode(df: DataFrame, key: str, text: str, directory: str = VOCABULARY_DIR, vocabulary: str = VOCABULARY, with_offsets: bool = False) -> DataFrame:
    """One row per input row: ``key``, ``ids`` and, if wanted, ``piece_offsets`` (the code point at which each id's piece
    begins). Repeated rows are encoded again; null and empty texts give empty lists; no text is cut."""
    path = os.path.join(directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, off, spots = encode_array(batch.column(1), path)
            columns = [batch.column(0), vec.list_array(ids, off, pa.int32())]
            names = [key, "ids"]
            if with_offsets:
                columns.append(vec.list_array(spots.astype(np.int32), off, pa.int32()))
                names.append("piece_offsets")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + (", piece_offsets array<int>" if with_offsets else "")
    return df.select(key, text).mapInArrow(run, schema)


def decode(ids: list[int], directory: str = VOCABULARY_DIR, vocabulary: str = VOCABULARY) -> str:
    """The text that ``ids`` stand for."""
    pieces = {v: k for k, v in ranks(os.path.join(directory, vocabulary)).items()}
    return b"".join(pieces[i] for i in ids).decode("utf-8", errors="replace")
