"""Problem 9: evaluation texts inside training texts, by greedy string tiling.

Every run of ``min_run`` consecutive words of the evaluation items is hashed (running Karp-Rabin); the corpus is scanned
once and its runs are looked up among them. Shared runs are the seeds: seeds on one diagonal grow into maximal matches,
then the longest match not yet covered is marked again and again, on both sides, until none of ``min_run`` words is
left. The marked words over the item's words are its coverage, so passages in another order count too.

The evaluation side is looked up by broadcast only while it has at most ``max_runs`` runs; beyond that corpus runs and
item runs meet in a shuffled join and only the matching (document, item) pairs are tiled.

Results: a null, empty or short text on either side gives no row; repeated rows give equal rows once; ties between
equally long matches go to the one that comes first in the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import vec

#: Most item runs that are broadcast (16 bytes each).
MAX_BROADCAST_RUNS = 2_000_000


def tile(seeds: np.ndarray, min_run: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds (document word, item word) of ``min_run`` equal words: tiles (document, item, words)."""
    if not len(seeds):
        return []
    diagonal = seeds[:, 0] - seeds[:, 1]
    order = np.lexsort((seeds[:, 0], diagonal))
    d, g = seeds[order, 0], diagonal[order]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 1) | (np.diff(g) != 0))))
    length = np.diff(np.append(cut, len(d))) + min_run - 1
    heap = [(-int(n), int(d[c]), int(d[c] - g[c])) for c, n in zip(cut, length)]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free, at = [], None
        for x in range(n + 1):
            ok = x < n and a + x not in in_doc and b + x not in in_item
            if ok and at is None:
                at = x
            elif not ok and at is not None:
                free.append((at, x - at))
                at = None
        if free == [(0, n)]:
            tiles.append((a, b, n))
            in_doc.update(range(a, a + n))
            in_item.update(range(b, b + n))
        else:
            for at, size in free:
                if size >= min_run:
                    heapq.heappush(heap, (-size, a + at, b + at))
    return tiles


class Items:
    """Runs of all evaluation items, sorted by hash."""

    def __init__(self, keys: list[int], texts: list[str], min_run: int):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.words: dict[int, int] = {}
        for row, cps, off, _ in vec.chunks(pa.array(texts, pa.string())):
            hashes, rows, _, _ = vec.words(cps, off)
            first_word = vec.bounds(rows, len(off) - 1)
            for i, n in enumerate(np.diff(first_word)):
                self.words[keys[row + i]] = int(n)
            run, first = vec.runs(hashes, rows, min_run)
            parts.append((run, np.array(keys[row : row + len(off) - 1], np.int64)[rows[first]], first - first_word[rows[first]]))
        run, item, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        order = np.argsort(run, kind="stable")
        self.run, self.item, self.at, self.min_run = run[order], item[order], at[order], min_run

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Row, item and tiles of every row that shares a run with an item."""
        for row, cps, off, _ in vec.chunks(texts):
            hashes, rows, _, _ = vec.words(cps, off)
            run, first = vec.runs(hashes, rows, self.min_run)
            if not len(run) or not len(self.run):
                continue
            low = np.searchsorted(self.run, run)
            hit = np.flatnonzero(self.run[np.minimum(low, len(self.run) - 1)] == run)
            if not len(hit):
                continue
            low, first = low[hit], first[hit]
            count = np.searchsorted(self.run, run[hit], side="right") - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            first = np.repeat(first, count)
            doc, item = rows[first], self.item[at]
            seeds = np.stack([first - vec.bounds(rows, len(off) - 1)[doc], self.at[at]], axis=1)
            order = np.lexsort((item, doc))
            doc, item, seeds = doc[order], item[order], seeds[order]
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0), [True])))
            for a, b in zip(cut[:-1], cut[1:]):
                yield row + int(doc[a]), int(item[a]), tile(seeds[a:b], self.min_run)


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_run: int = 12, max_runs: int = MAX_BROADCAST_RUNS) -> DataFrame:
    """(``key``, ``item_key``, ``longest``, ``covered_words``, ``coverage``): one row per document and leaked item. Both
    keys are longs; other columns, whatever their names, are ignored."""
    spark = corpus.sparkSession
    docs = corpus.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"))
    held = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("x")).distinct()
    schema = f"`{key}` long, `{item_key}` long, longest int, covered_words int, coverage double"
    names = [key, item_key, "longest", "covered_words", "coverage"]

    def row(d: int, i: int, tiles: list[tuple[int, int, int]], words: int) -> tuple:
        covered = sum(n for _, _, n in tiles)
        return d, i, max(n for _, _, n in tiles), covered, covered / words

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    size = held.select(F.coalesce(F.sum(F.length("x")), F.lit(0)).alias("n")).head()["n"]
    if size <= 2 * max_runs:  # a word and what parts it from the next have two characters at least
        rows = held.collect()
        shared = spark.sparkContext.broadcast(Items([r["i"] for r in rows], [r["x"] for r in rows], min_run))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                keys = batch.column(0)
                yield batch_of([row(keys[r].as_py(), i, tiles, table.words[i]) for r, i, tiles in table.matches(batch.column(1))])

        return docs.where(F.col("t").isNotNull()).mapInArrow(scan, schema).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, cps, off, _ in vec.chunks(batch.column(1)):
                hashes, rows, _, _ = vec.words(cps, off)
                run, first = vec.runs(hashes, rows, min_run)
                pair = np.unique(np.stack([rows[first], vec.int64(run)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[:, 0] + start)), pa.array(pair[:, 1])], ["k", "run"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                table = Items([i], [x], min_run)
                out += [row(d, i, tiles, table.words[i]) for _, _, tiles in table.matches(pa.array([t], pa.string()))]
            yield batch_of(out)

    wanted = held.mapInArrow(hashed, "k long, run long").withColumnRenamed("k", "i")
    found = docs.where(F.col("t").isNotNull()).mapInArrow(hashed, "k long, run long").withColumnRenamed("k", "d").join(wanted, "run").select("d", "i").distinct()
    return found.join(docs, "d").join(held, "i").select("d", "t", "i", "x").mapInArrow(pairs, schema).distinct()
