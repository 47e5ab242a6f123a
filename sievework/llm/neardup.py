"""Problem 6: near-duplicate records by tensored banding.

Two small collections of ``bands`` hash groups, each over ``rows`` minhashes, are drawn. The tables of the banding are
all pairs (group i of the first, group j of the second): bands**2 tables from 2 * bands * rows minhashes, where plain
banding would need bands**2 * 2 * rows. The pairs of keys are never written out: rows travel once per group of the first
collection and carry their groups of the second, and the table (i, j) is formed inside the partition by a sort.

Recall at similarity s is (1 - (1 - s**rows)**bands)**2; with the defaults 0.990 at 0.6, 0.999 at 0.7.

Skew: rows with the same word sequence are one class and only its first row is banded; a group of the first collection
with more than ``hot`` rows is spread over its tables (i, j) before the shuffle. Pairs that share a table are compared
by their other minhashes in blocks, and only those that may reach the threshold leave the task. All remaining pairs are
checked against their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import vec
from sievework.llm.shingles import shingle_sets, verified
from sievework.llm.skew import hot_keys, spread
from sievework.session import written

BANDS = 12
ROWS = 2
#: Pairs compared at once inside a task.
BLOCK = 1 << 20


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that a pair of this similarity shares a table."""
    return (1 - (1 - similarity**rows) ** bands) ** 2


def floor(similarity: float, values: int) -> int:
    """Equal minhashes out of ``values`` that a pair of this similarity has, but for one case in 10,000."""
    from math import comb

    total = 0.0
    for equal in range(values + 1):
        total += comb(values, equal) * similarity**equal * (1 - similarity) ** (values - equal)
        if total > 1e-4:
            return equal
    return values


def signatures(df: DataFrame, k: int, min_words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """From (id, head, body): id, ``digest`` of the word sequence of head + body, ``groups`` of the first collection
    and ``sketch``, one byte per minhash: in its second half ``rows`` neighbouring bytes are a group of the second. Rows whose body has
    fewer than ``min_words`` words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = vec.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            heads = batch.column(1).to_numpy(zero_copy_only=False)
            head = np.array([len(h) for h in heads], np.int64)
            for start, cps, off, _ in vec.chunks(batch.column(2)):
                n = len(off) - 1
                hashes, row, first, _ = vec.words(cps, off)
                body = np.bincount(row[first - off[row] >= head[start : start + n][row]], minlength=n)
                values, bound = shingle_sets(hashes, row, n, k)
                digest = vec.sequence_hash(hashes, vec.bounds(row, n))
                keep = np.flatnonzero((body >= min_words) & (bound[1:] > bound[:-1]))
                low = vec.minhashes(values, bound, 2 * bands * rows)[keep]
                first_part = low[:, : bands * rows].reshape(len(keep), bands, rows).astype(np.uint64)
                groups = np.zeros((len(keep), bands), np.uint64)
                for r in range(rows):
                    groups = vec.mix(groups + first_part[:, :, r] + salt)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keep + start)),
                        pa.array(vec.int64(digest[keep])),
                        vec.list_array(vec.int64(groups.reshape(-1)), np.arange(len(keep) + 1) * bands, pa.int64()),
                        vec.fixed_binary(low.astype(np.uint8)),
                    ],
                    ["id", "digest", "groups", "sketch"],
                )

    return df.select("id", F.coalesce("head", F.lit("")).alias("head"), F.concat_ws(" ", F.coalesce("head", F.lit("")), F.coalesce("body", F.lit(""))).alias("text")).mapInArrow(
        run, "id long, digest long, groups array<long>, sketch binary"
    )


def runs_of(order: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions with an equal key, in blocks. ``order`` sorts ``key``."""
    k = key[order]
    for gap in range(1, len(k)):
        at = np.flatnonzero(k[gap:] == k[:-gap]) if gap == 1 else at[(at + gap < len(k))]  # noqa: F821
        if gap > 1:
            at = at[k[at + gap] == k[at]]
        if not len(at):
            return
        for s in range(0, len(at), BLOCK):
            yield order[at[s : s + BLOCK]], order[at[s : s + BLOCK] + gap]


def candidates(sig: DataFrame, similarity: float, bands: int = BANDS, rows: int = ROWS, hot: int = 50_000) -> DataFrame:
    """Distinct pairs (a < b) that share a table and whose other minhashes don't rule the similarity out."""
    half = bands * rows
    least = floor(similarity, 2 * half)
    keyed = sig.select(F.explode("groups").alias("g"), "id", "sketch")
    keyed = spread(keyed, "g", hot_keys(keyed, "g", "id", hot), bands, F.substring("sketch", half + rows * F.col("only") + 1, F.lit(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        g = whole.column(0).to_numpy().view(np.uint64)
        ids = whole.column(1).to_numpy()
        sketch = vec.binary_rows(whole.column(2), 2 * half)
        only = whole.column(3).to_numpy() if whole.num_columns > 3 else np.full(len(ids), -1)
        del whole, got
        out = []
        for j in range(bands):
            at = np.flatnonzero((only < 0) | (only == j))
            second = np.zeros(len(at), np.uint64)
            for r in range(rows):
                second = (second << np.uint64(8)) | sketch[at, half + rows * j + r]
            key = vec.mix(g[at] + second * np.uint64(vec.BASE))
            order = np.argsort(key, kind="stable")
            for x, y in runs_of(order, key):
                x, y = at[x], at[y]
                near = (sketch[x] == sketch[y]).sum(axis=1) >= least
                x, y = ids[x[near]], ids[y[near]]
                out.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        found = found[found[:, 0] != found[:, 1]]
        for s in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[s : s + 100_000, 0]), pa.array(found[s : s + 100_000, 1])], ["a", "b"])

    return keyed.repartition("g").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str, head: str | None, body: str, similarity: float = 0.6, k: int = 3, min_words: int = 30, bands: int = BANDS, rows: int = ROWS, hot: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Links and classes. Links: (a, b, similarity) between the first rows of classes whose texts (head + space + body)
    reach ``similarity`` on runs of ``k`` words. Classes: (id, rep) of every compared row, rep being the least id with
    the same word sequence. Rows with a null, empty or short body are not compared; null heads count as empty; rows with
    equal ids are one row; other columns are ignored."""
    rows_in = df.select(F.col(key).cast("long").alias("id"), (F.col(head) if head else F.lit("")).alias("head"), F.col(body).alias("body"))
    sig = written(signatures(rows_in.where(F.length("body") >= 2 * min_words - 1), k, min_words, bands, rows), "signatures")
    classes = sig.groupBy("digest").agg(F.min("id").alias("rep"))
    members = sig.select("id", "digest").join(classes, "digest").select("id", "rep")
    firsts = sig.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    pairs = written(candidates(firsts, similarity, bands, rows, hot), "candidates")
    text = rows_in.select("id", F.concat_ws(" ", F.coalesce("head", F.lit("")), F.coalesce("body", F.lit(""))).alias("text"))
    return verified(pairs, text, "id", "text", similarity, k), members


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of rows that the links and classes stand for."""
    a, b = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, F.col("a") == F.col("b")).where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
