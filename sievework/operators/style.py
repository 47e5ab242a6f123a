"""Stylometry: style vectors, distances between them, families of one template, and shifts along a sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.session import ship, written

#: Function words whose rates are part of the style (fixed values).
FUNCTION_WORDS = "the and to of a in that is was for it with as at by this".split()
MARKS = [",", ";", ":", "!", "?", "-"]


def fingerprint(text: Column) -> Column:
    """Style as an array of doubles: word length, sentence length, variety, share of capitals, rates of marks per 100
    characters and of function words per word. Null for texts without words."""
    t = F.coalesce(text, F.lit(""))
    words = T.tokens(t)
    n, chars = F.size(words), F.length(t)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    parts = [letters / n, n / T.sentences(t), F.size(F.array_distinct(words)) / n, F.regexp_count(t, F.lit("[A-Z]")) / chars]
    parts += [F.regexp_count(t, F.lit("[" + ("\\-" if m == "-" else m) + "]")) * 100.0 / chars for m in MARKS]
    parts += [F.size(F.filter(words, _equal(w))) / n for w in FUNCTION_WORDS]
    return F.when(n > 0, F.array(*[p.cast("double") for p in parts]))


def _equal(word: str):
    return lambda x: x == word


def distance(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Weighted Euclidean distance of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    if weights is not None:
        squares = F.zip_with(squares, weights, lambda s, w: s * w)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, n, centre, variance): per dimension mean and sample variance, one row per label."""
    rows = df.where(F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s"))
    return rows.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m", "s"))), lambda x: x["m"]).alias("centre"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m", "s"))), lambda x: x["s"]).alias("variance"))


def shifts(df: DataFrame, who: str, order: str, vector: str) -> DataFrame:
    """Distance of every style vector of ``who`` from the one before it; null for the first."""
    w = W.partitionBy(who).orderBy(order)
    return df.select(who, order, vector, F.lag(vector).over(w).alias("_p")).select(who, order, distance(F.col(vector), F.col("_p")).alias("shift"))


#: Buckets in which word pairs are counted; the counts only fix the order in which word pairs are looked at.
BUCKETS = 1 << 20
#: Shared word pairs that two texts must have among their rarest ones to be compared in full.
SHARED = 4
#: Bits of the sketch that holds, for every bit, whether an odd number of word pairs falls on it.
BITS = 256
#: Texts of one block at most.
BLOCK = 200_000


def _word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of texts made of ASCII words between single blanks: hashes of the distinct word pairs of every row in the order of
    the rows, and the offsets of the rows."""
    lists = pc.split_pattern(texts, " ")
    ends = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.dictionary_encode()
    hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) for w in words.dictionary.to_pylist()], np.uint64)[words.indices.to_numpy()]
    rows = np.repeat(np.arange(len(texts)), np.diff(ends))
    pairs, of = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:], rows[1:]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inner = rows[1:] == rows[:-1]
    pairs, of = pairs[inner], of[inner]
    order = np.lexsort((pairs, of))
    pairs, of = pairs[order], of[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])
    return pairs[new], np.searchsorted(of[new], np.arange(len(texts) + 1))


def _spaced(text: Column) -> Column:
    """The words of ``T.tokens`` with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " "))


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _least_shared(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """What sets of sizes n and m must share for a Jaccard similarity of ``least``."""
    return np.ceil(least / (1 + least) * (n + m) - 1e-9).astype(np.int64)


def families(df: DataFrame, key: str, text: str, least: float = 0.75) -> DataFrame:
    """Pairs (a, b, similarity) of texts whose sets of word pairs have a Jaccard similarity of at least ``least``. Exact
    prefix filtering: sets of sizes n and m that share t word pairs share SHARED of them among the n - t + SHARED and
    m - t + SHARED rarest ones, in any fixed order. Texts are cut into blocks by size, every two blocks of sizes that can
    be similar meet in one task, which counts by posting lists what two texts share there. The sketches of two sets differ in
    no more bits than the sets in word pairs, so pairs whose sketches differ too much are left out; the others are compared
    in full. The hashes in the lists have 32 bits; those that clash can only add candidates."""
    spark = ship(df.sparkSession)
    rows = written(df.select(F.col(key).alias("k"), _spaced(F.col(text)).alias("t")).where("instr(t, ' ') > 0"), "style-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, sizes = np.zeros(BUCKETS, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pairs, off = _word_pairs(batch.column(0))
            often += np.bincount((pairs >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
            n = np.bincount(np.diff(off))
            sizes = np.pad(sizes, (0, max(0, len(n) - len(sizes)))) + np.pad(n, (0, max(0, len(sizes) - len(n))))
        for what, counts in ((0, often), (1, sizes)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), what, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["what", "at", "n"])

    counts = rows.select("t").mapInArrow(count, "what int, at int, n long").groupBy("what", "at").agg(F.sum("n").alias("n")).toArrow()
    what, at, n = (counts.column(c).to_numpy() for c in ("what", "at", "n"))
    often = np.zeros(BUCKETS, np.int64)
    often[at[what == 0]] = n[what == 0]
    meetings, low = _blocks(at[what == 1], n[what == 1], least)
    shared = spark.sparkContext.broadcast(often)
    salt = F.col("k") if dict(rows.dtypes)["k"] in ("int", "bigint") else F.xxhash64("k")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            pairs, off = _word_pairs(batch.column(1))
            size = np.diff(off)
            of = np.repeat(np.arange(len(size)), size)
            pairs = pairs[np.lexsort((pairs, often[(pairs >> np.uint64(44)).astype(np.int64)], of))]
            ids = (pairs >> np.uint64(32)).astype(np.uint32).view(np.int32)
            part = np.searchsorted(low, size, side="right") - 1
            salts = batch.column(2).to_numpy()
            odd = np.bincount(of * BITS + ((pairs >> np.uint64(16)) % np.uint64(BITS)).astype(np.int64), minlength=len(size) * BITS) & 1
            sketches = np.packbits(odd.astype(bool).reshape(-1, BITS), axis=1)
            for meeting, (i, pi, ni, j, pj, nj) in enumerate(meetings):
                for side, (x, p, parts, other) in enumerate(((i, pi, ni, j), (j, pj, nj, i))):
                    if side and (i, pi) == (j, pj):
                        continue
                    mine = np.flatnonzero((part == x) & (salts % parts == p))
                    n = size[mine]
                    partner = np.maximum(low[other], np.ceil(least * n - 1e-9).astype(np.int64))
                    take = np.minimum(n, n - _least_shared(n, partner, least) + SHARED)
                    fits = (take > 0) & (least * partner <= n + 1e-9)
                    mine, n, take = mine[fits], n[fits], take[fits]
                    if not len(mine):
                        continue
                    ends = np.cumsum(take)
                    values = ids[np.arange(ends[-1]) + np.repeat(off[mine] - ends + take, take)]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), meeting, np.int32)), pa.array(np.full(len(mine), 2 if (i, pi) == (j, pj) else side, np.int32)), batch.column(0).take(pa.array(mine)), pa.array(n.astype(np.int32)), lists, _binary(sketches[mine])], ["meeting", "side", "k", "n", "ids", "sketch"])

    kind = rows.schema["k"].dataType.simpleString()
    near = rows.select("k", "t", salt.cast("long").alias("salt")).mapInArrow(prefixes, f"meeting int, side int, k {kind}, n int, ids array<int>, sketch binary")
    pairs = near.groupBy("meeting").applyInArrow(lambda table: _meet(table, least), f"a {kind}, b {kind}")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "style-pairs")
    grams = F.array_distinct(T.ngrams(F.split("t", " "), 2))
    asked = written(rows.join(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k").select("k", grams.alias("s")), "style-sets")
    both = pairs.join(asked.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(asked.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", T.jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)


def _blocks(sizes: np.ndarray, rows: np.ndarray, least: float, ranges: int = 8) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The meetings (range, part, parts of the one side and of the other), and the least size of every range of sizes.
    Ranges have about equal numbers of rows; one of more than BLOCK rows is cut into parts."""
    if not len(sizes):
        return [], np.zeros(0, np.int64)
    order = np.argsort(sizes)
    sizes, rows = sizes[order].astype(np.int64), rows[order]
    of = np.minimum(ranges - 1, (np.cumsum(rows) - rows) * ranges // rows.sum())
    of = np.unique(of, return_inverse=True)[1]
    low = np.array([sizes[of == r].min() for r in range(of.max() + 1)])
    high = [sizes[of == r].max() for r in range(of.max() + 1)]
    parts = [int(-(-rows[of == r].sum() // BLOCK)) for r in range(of.max() + 1)]
    every = [(r, p) for r in range(len(low)) for p in range(parts[r])]
    return [(i, p, parts[i], j, q, parts[j]) for x, (i, p) in enumerate(every) for j, q in every[x:] if high[i] >= least * low[j] - 1e-9], low


def _meet(table: pa.Table, least: float) -> pa.Table:
    """The pairs of keys (a, b) of one meeting that share enough of their rarest word pairs. Sides 0 and 1 are two blocks,
    2 is a block that meets itself."""
    side, n = table.column("side").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    lists = table.column("ids").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    off = lists.offsets.to_numpy()
    ids = np.unique(lists.values.to_numpy()[off[0] : off[-1]], return_inverse=True)[1]
    off = off - off[0]
    one, other = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
    alone = bool((side == 2).any())
    held = side[np.repeat(np.arange(len(n)), np.diff(off))] != 1
    local = np.cumsum(side != 1) - 1
    owner = np.repeat(local, np.diff(off))[held]
    order = np.argsort(ids[held], kind="stable")
    post = owner[order]
    start = np.searchsorted(ids[held][order], np.arange((ids.max() if len(ids) else 0) + 2))
    sizes = n[one]
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(n), BITS // 64)
    first, second = [], []
    for row in (one if alone else other).tolist():
        mine = ids[off[row] : off[row + 1]]
        got = np.concatenate([post[x:y] for x, y in zip(start[mine].tolist(), start[mine + 1].tolist())])
        if not len(got):
            continue
        count = np.bincount(got, minlength=len(one))
        at = np.flatnonzero(count >= min(SHARED, int(_least_shared(n[row], sizes.min(), least))))
        at = at[count[at] >= np.minimum(SHARED, _least_shared(n[row], sizes[at], least))]
        at = one[at]
        if alone:
            at = at[at > row]
        at = at[np.minimum(n[at], n[row]) >= least * np.maximum(n[at], n[row]) - 1e-9]
        apart = np.bitwise_count(sketches[at] ^ sketches[row]).sum(axis=1, dtype=np.int64)
        at = at[apart <= n[at] + n[row] - 2 * _least_shared(n[row], n[at], least)]
        first.append(at)
        second.append(np.full(len(at), row))
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (first, second))
    keys = table.column("k")
    return pa.table({"a": keys.take(pa.array(x)), "b": keys.take(pa.array(y))})


def template_families(df: DataFrame, key: str, text: str, least: float = 0.75) -> DataFrame:
    """(key, family) of all texts that are of one template with another one: families are the components of the pairs of
    ``families``, named by their least key. Texts with the same set of word pairs are one class before any pairing, so
    copies never meet each other."""
    from sievework.operators.graph import components
    from sievework.session import written


    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, off = _word_pairs(batch.column(1))
            sets = [hashlib.blake2b(pairs[x:y].tobytes(), digest_size=16).digest() for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["k", "h"])

    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), _spaced(F.col(text)).alias("t")).where("instr(t, ' ') > 0")
    rows = written(rows.mapInArrow(hashed, f"k {rows.schema['k'].dataType.simpleString()}, h binary"), "style-rows")
    classes = written(rows.groupBy("h").agg(F.min("k").alias("k"), F.count("*").alias("n")), "style-classes")
    pairs = families(df.join(classes, df[key] == classes["k"], "left_semi"), key, text, least)
    member = components(pairs, "a", "b").withColumnRenamed("node", "k")
    found = classes.join(member, "k", "left").where("n > 1 or component is not null").select("h", F.coalesce("component", "k").alias("family"))
    return rows.join(found, "h").select(F.col("k").alias(key), "family")
