"""Word-shingle signatures and the exact check of candidate pairs, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import vec
from sievework.session import written


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row and the row offsets into them."""
    run, first = vec.runs(hashes, rows, k)
    row = rows[first] if len(first) else first
    order = np.lexsort((run, row))
    run, row = run[order], row[order]
    if len(run):
        keep = np.concatenate(([True], (np.diff(row) != 0) | (run[1:] != run[:-1])))
        run, row = run[keep], row[keep]
    return run, vec.bounds(row, n)


#: Ids that are broadcast to pick rows of a text table (a long each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000


def with_shingles(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, ``s`` array<int>): 32 bits of the hash of every distinct run of ``k`` words (inside one text two runs share
    them in about one of 100,000 texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, cps, off, _ in vec.chunks(batch.column(1)):
                hashes, rows, _, _ = vec.words(cps, off)
                values, bound = shingle_sets(hashes, rows, len(off) - 1, k)
                short = (values >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(off) - 1), vec.list_array(short, bound, pa.int32())], [key, "s"])

    return df.select(key, text).mapInArrow(run, f"`{key}` long, s array<int>")


def picked(texts: DataFrame, ids: DataFrame, key: str, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
    """The rows of ``texts`` whose ``key`` is in ``ids`` (a written table of distinct keys). Few ids are broadcast, so
    that the texts stay where they are; beyond ``limit`` both sides are shuffled."""
    return texts.join(F.broadcast(ids) if ids.count() <= limit else ids.hint("shuffle_merge"), key, "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, key: str, text: str, similarity: float, k: int) -> DataFrame:
    """The candidate ``pairs`` (a, b; a written table) whose texts really have a shingle similarity of at least
    ``similarity``, with it. Only texts named in a pair are shingled."""
    named = written(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "named")
    sets = with_shingles(picked(texts, named, key), key, text, k)
    left, right = sets.select(F.col(key).alias("a"), F.col("s").alias("sa")), sets.select(F.col(key).alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )
