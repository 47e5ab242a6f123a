"""Problem 1: new batches against all history.

Every posting leaves hashes only: of its page address, of its source and external number, of its whole normalised
description, and one per paragraph (a line or sentence, or a part of a very long one) of it with a small sketch. A row repeats an earlier one if an
exact hash of it is already there, or if descriptions that share a paragraph hash really reach the similarity.
``History`` keeps the hashes in a bucketed table, joins one new batch to it bucket by bucket, and appends;
``repeats_by_batch`` sends all batches of a table through it. ``repeats`` gives the same answer for all batches in one
pass and serves to test it.

Skew: exact hashes are reduced to one row per key and batch before they meet; equal descriptions are one content; hot
paragraphs are cut into blocks that all of a batch meets, and whoever has met a practically certain earlier copy takes no later one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm import vec
from sievework.llm.neardup import floor, runs_of
from sievework.llm.shingles import shingle_sets, verified, with_shingles
from sievework.llm.skew import blocked, hot_keys
from sievework.session import written

SKETCH = 32
#: Of the sketch's values equal in a practically certain copy: a pair below 0.6 has so many in 2 of 1,000,000 cases.
CERTAIN = 31
#: Paragraphs below this many words are no evidence.
PARAGRAPH_WORDS = 4
#: Paragraphs above this many words are cut at words that their hash picks (one in eight).
LONG_PARAGRAPH = 24
#: Buckets up to this size are compared all with all at once, larger ones in rising order with early ends.
SMALL_BUCKET = 48
#: Query parameters that don't choose the page (fixed values), besides all that begin with utm_.
TRACKING = ("ref", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid", "sessionid", "trk")


def page_key(url: Column) -> Column:
    """The page a url names: no scheme, www, default port, fragment, final slash or tracking parameters; the host in
    lower case; the other parameters sorted. Null for blank urls."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(u, r"^(?i)(?:https?:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "[&;]"), lambda p: (p != "") & ~p.rlike(r"^(?i)(?:utm_[^=]*|" + "|".join(TRACKING) + r")(?:=|$)")))
    return F.when(host != "", F.concat(host, path, F.lit("?"), F.concat_ws("&", kept)))


def number_key(external_id: Column) -> Column:
    """The number an external id stands for (its last run of digits without leading zeros); null without digits."""
    digits = F.regexp_extract(external_id, r"(\d+)\D*$", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))


def described(df: DataFrame, k: int, min_words: int) -> DataFrame:
    """From (id, batch, text): digest of the word sequence, paragraph hashes and the sketch, for texts with at least
    ``min_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, cps, off, _ in vec.chunks(batch.column(2)):
                n = len(off) - 1
                hashes, row, first, _ = vec.words(cps, off)
                word_off = vec.bounds(row, n)
                values, bound = shingle_sets(hashes, row, n, k)
                keep = np.flatnonzero((np.diff(word_off) >= min_words) & (bound[1:] > bound[:-1]))
                # A paragraph ends at a line break, or after . ! ? before white space.
                stop = (cps == 10) | (cps == 13)
                closing = (cps == 46) | (cps == 33) | (cps == 63)
                stop[1:] |= closing[:-1] & ((cps[1:] == 32) | (cps[1:] == 9))
                number = np.cumsum(stop)[first] if len(first) else first
                new_part = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(number) != 0))) if len(row) else np.zeros(0, bool)
                # Very long paragraphs are cut again where their own words say so, so that an edit spoils a part only.
                place = np.flatnonzero(new_part)
                lasting = np.repeat(np.diff(np.append(place, len(row))) > LONG_PARAGRAPH, np.diff(np.append(place, len(row))))
                new_part[1:] |= (lasting & ((hashes >> np.uint64(9)) % np.uint64(8) == 0))[:-1]
                cut = np.flatnonzero(new_part)
                seg_off = np.append(cut, len(row))
                long = np.diff(seg_off) >= PARAGRAPH_WORDS
                seg_hash, seg_row = vec.sequence_hash(hashes, seg_off)[long], row[cut][long]
                inside = np.isin(seg_row, keep)
                order = np.lexsort((seg_hash[inside], seg_row[inside]))
                seg_hash, seg_row = seg_hash[inside][order], seg_row[inside][order]
                if len(seg_row):
                    new = np.concatenate(([True], (np.diff(seg_row) != 0) | (seg_hash[1:] != seg_hash[:-1])))
                    seg_hash, seg_row = seg_hash[new], seg_row[new]
                sketch = vec.minhashes(values, bound, SKETCH, seed=11)[keep].astype(np.uint8)
                at = pa.array(keep + start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(vec.int64(vec.sequence_hash(hashes, word_off)[keep])),
                        vec.list_array(vec.int64(seg_hash), np.searchsorted(seg_row, np.append(keep, n)), pa.int64()),
                        vec.fixed_binary(sketch),
                    ],
                    ["id", "batch", "digest", "paragraphs", "sketch"],
                )

    return df.select("id", "batch", "text").mapInArrow(run, "id long, batch int, digest long, paragraphs array<long>, sketch binary")


def paragraph_pairs(contents: DataFrame, similarity: float, hot: int = 50_000) -> DataFrame:
    """From contents (id, first, last, paragraphs, sketch): pairs (a, first_a, b) of contents that share a paragraph,
    where ``a`` comes before ``b`` and may be a copy of it. ``first`` and ``last`` are batches."""
    least = floor(similarity, SKETCH)
    keyed = contents.select(F.explode("paragraphs").alias("g"), "id", "first", "last", "sketch")
    keyed = blocked(keyed, "g", "id", hot_keys(keyed, "g", "id", hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        g, ids, first, last = (whole.column(i).to_numpy() for i in range(4))
        sketch = vec.binary_rows(whole.column(4), SKETCH)
        side = whole.column(5).to_numpy()
        del got, whole
        order = np.lexsort((ids, first, g))
        cut = np.flatnonzero(np.concatenate(([True], np.diff(g[order]) != 0, [True])))
        size = np.diff(cut)
        out: list[np.ndarray] = []

        def emit(x: np.ndarray, y: np.ndarray) -> None:
            near = (last[y] > first[x]) & (ids[x] != ids[y]) & ((side[x] == -1) | (side[x] != side[y]))
            x, y = x[near], y[near]
            near = (sketch[x] == sketch[y]).sum(axis=1) >= least
            out.append(np.unique(np.stack([ids[x[near]], first[x[near]].astype(np.int64), ids[y[near]]], axis=1), axis=0))

        small = np.repeat((size > 1) & (size <= SMALL_BUCKET), size)
        for x, y in runs_of(order[small], g):
            emit(x, y)
        for i in np.flatnonzero(size > SMALL_BUCKET):
            members = order[cut[i] : cut[i + 1]]
            # What waits for each side: all that it may be paired with (side -1 with itself).
            waits = {s: members[(side[members] == -1) | (side[members] != s)] for s in np.unique(side[members])}
            for a in members[:-1]:
                waiting = waits[side[a]]
                if side[a] == -1:
                    waiting = waiting[waiting != a]
                else:
                    waiting = waiting[(first[waiting] > first[a]) | ((first[waiting] == first[a]) & (ids[waiting] > ids[a]))]
                waiting = waiting[last[waiting] > first[a]]
                if len(waiting):
                    equal = (sketch[waiting] == sketch[a]).sum(axis=1)
                    near = waiting[equal >= least]
                    if len(near):
                        near = near[ids[near] != ids[a]]
                        out.append(np.stack([np.full(len(near), ids[a]), np.full(len(near), first[a], np.int64), ids[near]], axis=1))
                        waiting = waiting[equal < CERTAIN]
                waits[side[a]] = waiting
                if not any(len(w) for w in waits.values()):
                    break
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
        for s in range(0, len(found), 100_000):
            part = found[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1].astype(np.int32)), pa.array(part[:, 2])], ["a", "first_a", "b"])

    return keyed.select("g", "id", "first", "last", "sketch", "side").repartition("g").mapInArrow(run, "a long, first_a int, b long").distinct()


def exact_keys(df: DataFrame) -> DataFrame:
    """(id, batch, key): the hashes of page and external number."""
    number = number_key(F.col("external_id"))
    page = page_key(F.col("url"))
    return df.select(
        "id",
        "batch",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(page.isNotNull(), F.xxhash64(F.lit("page"), page)),
                    F.when(number.isNotNull() & F.col("source").isNotNull(), F.xxhash64(F.lit("number"), "source", number)),
                )
            )
        ).alias("key"),
    )


def repeats(df: DataFrame, key: str = "id", batch: str = "batch_no", similarity: float = 0.6, k: int = 3, min_words: int = 30, hot: int = 50_000) -> DataFrame:
    """(id_a, id_b): every row that repeats a row of a lower batch, with the least id among those rows. Ids rise with
    the batch. Null or blank urls, external ids and descriptions, and descriptions below ``min_words`` words, never
    match; rows of one batch never match each other; rows without id or batch are left out; other columns are ignored."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(batch).cast("int").alias("batch"), "source", "url", "external_id", F.col("description").alias("text")).where(
        F.col("id").isNotNull() & F.col("batch").isNotNull()
    )
    sig = written(described(rows.where(F.length("text") >= 2 * min_words - 1), k, min_words), "descriptions")
    keys = exact_keys(rows).unionByName(sig.select("id", "batch", F.xxhash64(F.lit("text"), "digest").alias("key")))
    per_batch = keys.groupBy("key", "batch").agg(F.min("id").alias("least"))
    before = F.min("least").over(W.partitionBy("key").orderBy("batch").rowsBetween(W.unboundedPreceding, -1))
    seen = per_batch.select("key", "batch", before.alias("id_a")).where(F.col("id_a").isNotNull())
    exact = keys.join(seen, ["key", "batch"]).select("id_a", F.col("id").alias("id_b"))

    contents = sig.groupBy("digest").agg(F.min("id").alias("id"), F.min("batch").alias("first"), F.max("batch").alias("last"))
    firsts = sig.drop("batch").join(contents.select("id", "first", "last"), "id")
    pairs = written(paragraph_pairs(firsts, similarity, hot), "paragraph-pairs")
    true = verified(pairs.select("a", "b"), rows.select("id", "text"), "id", "text", similarity, k).join(pairs, ["a", "b"]).select("a", "first_a", "b")
    members = sig.select("id", "batch", "digest").join(contents.select("digest", F.col("id").alias("b")), "digest").select("b", "id", "batch")
    near = true.join(members, "b").where(F.col("batch") > F.col("first_a")).select(F.col("a").alias("id_a"), F.col("id").alias("id_b"))
    return exact.unionByName(near).groupBy("id_b").agg(F.min("id_a").alias("id_a")).select("id_a", "id_b")


def sketch_words(sketch: Column) -> list[Column]:
    """The sketch's 32 bytes as four longs."""
    return [F.conv(F.hex(F.substring(sketch, 8 * i + 1, F.lit(8))), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]


def agreeing(old: str, new: str) -> Column:
    """How many bytes of two sketches (columns ``old``.s0 ... and ``new``.s0 ...) are equal: in generated code, a few bit
    operations a long. Of a byte of the difference, the lowest bit ends as the union of its bits."""
    total = F.lit(SKETCH)
    for i in range(4):
        x = F.col(f"{old}.s{i}").bitwiseXOR(F.col(f"{new}.s{i}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def prepared(rows: DataFrame, k: int, min_words: int) -> DataFrame:
    """From (id, batch, source, url, external_id, text): (batch, id, key, digest, paragraphs, s0 ... s3): one row per exact key
    of a row (``key`` set), and one per description of at least ``min_words`` words (``digest`` set)."""
    exact = exact_keys(rows).select("batch", "id", "key", F.lit(None).cast("long").alias("digest"), F.lit(None).cast("array<long>").alias("paragraphs"), *[F.lit(None).cast("long").alias(f"s{i}") for i in range(4)])
    texts = described(rows.where(F.length("text") >= 2 * min_words - 1), k, min_words)
    return exact.unionByName(texts.select("batch", "id", F.xxhash64(F.lit("text"), "digest").alias("key"), "digest", "paragraphs", *sketch_words(F.col("sketch"))))


def probes(prep: DataFrame) -> DataFrame:
    """(batch, key, id, near, s0 ... s3) of prepared batches: an exact hash with the least id that has it, or (``near``) a
    paragraph of a description, whose id is the least of the batch with the same description."""
    exact = prep.groupBy("batch", "key").agg(F.min("id").alias("id")).select("batch", "key", "id", F.lit(False).alias("near"), *[F.lit(None).cast("long").alias(f"s{i}") for i in range(4)])
    firsts = prep.where("digest is not null").groupBy("batch", "digest").agg(F.min(F.struct("id", "paragraphs", "s0", "s1", "s2", "s3")).alias("c"))
    paragraphs = firsts.select("batch", F.explode("c.paragraphs").alias("key"), F.col("c.id").alias("id"), F.lit(True).alias("near"), *[f"c.s{i}" for i in range(4)])
    return exact.unionByName(paragraphs)


class History:
    """Accepted postings as one bucketed table of hashes under ``path`` (a folder all executors share): of every load one row
    per exact hash with the least id that has it, and one per paragraph of every description with its sketch, bucketed by
    hash. A batch is joined to it bucket by bucket: only the batch moves, the history is read where it lies and neither
    shuffled nor sorted. Texts are read for candidates only.

    A load counts once its number stands in ``commits``, written last; rows of a load that broke off are never read, so a
    batch may simply be sent again. One writer at a time is assumed. Whoever opens ``path`` later must give the same
    number of buckets; ``buckets`` should keep a bucket of history within an executor's memory."""

    COLUMNS = ("key", "id", "near", "s0", "s1", "s2", "s3", "load")
    SCHEMA = "key long, id long, near boolean, s0 long, s1 long, s2 long, s3 long, load long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, similarity: float = 0.6, k: int = 3, min_words: int = 30, hot: int = 50_000):
        import uuid

        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.similarity, self.k, self.min_words, self.hot = similarity, k, min_words, hot
        self.table = f"sievework_history_{uuid.uuid4().hex}"  # the name is this session's; the files are found by the path
        spark.sql(f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{self.path}/hashes'")
        self.loads: list[int] = []
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            rows = spark.read.schema("load long, rows long").parquet(f"{self.path}/commits").collect()  # one row per load
            self.loads, self.rows = sorted(r["load"] for r in rows), sum(r["rows"] for r in rows)
        else:
            self.rows = 0
        self.listed, self.counted = None, 0

    def accepted(self) -> DataFrame:
        return self.spark.table(self.table).where(F.col("load").isin(self.loads)) if self.loads else self.spark.createDataFrame([], self.SCHEMA)

    def _hot(self) -> DataFrame | None:
        """Hot paragraph hashes, counted anew whenever ``hot`` rows have come since: none exceeds twice the bound."""
        if self.rows - self.counted >= self.hot:
            self.listed, self.counted = hot_keys(self.accepted().where("near").select("key", "id"), "key", "id", self.hot), self.rows
        return self.listed

    def hits(self, probe: DataFrame) -> DataFrame:
        """(near, a, b): what a batch's ``probe`` (a written table) finds. Exact hashes: the least accepted id ``a`` of hash
        ``b``. Paragraphs: an accepted description ``a`` and one of the batch ``b`` that share a paragraph and whose sketches
        admit the similarity."""
        least = floor(self.similarity, SKETCH)
        old, new = self.accepted().alias("o"), probe.alias("n")
        match = F.col("o.key") == F.col("n.key")  # nothing but the bucketing column, or the history would be shuffled
        admit = (~F.col("o.near") & ~F.col("n.near")) | (F.col("o.near") & F.col("n.near") & (F.col("o.id") != F.col("n.id")) & (agreeing("o", "n") >= least))
        b = F.when(F.col("o.near"), F.col("n.id")).otherwise(F.col("n.key"))
        hot = self._hot()
        if hot is None:
            found = old.join(new.hint("shuffle_hash"), match & admit).select(F.col("o.near").alias("near"), F.col("o.id").alias("a"), b.alias("b"))
        else:
            # Hot paragraphs: their accepted rows fall into blocks, the batch's rows go to every block, so no pair is lost.
            # Whoever has met a practically certain copy needs no later one, so the first such is found beforehand.
            listed = F.broadcast(hot) if hot.count() <= 1_000_000 else hot
            plain = self.accepted().join(listed, "key", "left_anti").alias("o").join(probe.hint("shuffle_hash").alias("n"), match & admit)
            cut = self.accepted().where("near").join(listed, "key").withColumn("block", F.pmod(F.xxhash64(F.lit(31), "id"), F.col("blocks").cast("long")).cast("int")).alias("o")
            sent = probe.where("near").join(listed, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("n")
            met = cut.join(sent, match & (F.col("o.block") == F.col("n.block")) & admit)
            sure = written(met.where(agreeing("o", "n") >= CERTAIN).groupBy(F.col("n.id").alias("c")).agg(F.min("o.id").alias("sure")), "certain-copies")
            left = met.join(sure, F.col("n.id") == F.col("c"), "left").where(F.col("sure").isNull() | (F.col("o.id") <= F.col("sure")))
            found = plain.select(F.col("o.near").alias("near"), F.col("o.id").alias("a"), b.alias("b")).unionByName(left.select(F.lit(True).alias("near"), F.col("o.id").alias("a"), F.col("n.id").alias("b")))
        return found.groupBy("near", "b", F.when(F.col("near"), F.col("a")).alias("_pair")).agg(F.min("a").alias("a")).select("near", "a", "b")

    def append(self, probe: DataFrame, load: int, rows: int) -> None:
        """Accept a batch's hashes (``rows`` of them) as load number ``load``. A load that is accepted already is left as it is."""
        if load in self.loads:
            return
        probe.withColumn("load", F.lit(load).cast("long")).select(*self.COLUMNS).repartition(self.buckets, "key").write.insertInto(self.table)
        self.spark.range(1).select(F.lit(load).cast("long").alias("load"), F.lit(rows).cast("long").alias("rows")).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.loads, self.rows = sorted({*self.loads, load}), self.rows + rows

    def check(self, probe: DataFrame, load: int, rows: int) -> DataFrame:
        """Hits of a batch's ``probe`` (a written table of ``rows`` rows) with what is accepted so far; then the batch is
        accepted. The hits are written, so they don't depend on the table afterwards."""
        found = written(self.hits(probe), "hits") if self.loads else self.spark.createDataFrame([], "near boolean, a long, b long")
        self.append(probe, load, rows)
        return found

    def check_and_append(self, batch: DataFrame, load: int, texts: DataFrame) -> DataFrame:
        """(id_a, id_b) for the rows of ``batch`` (id, source, url, external_id, description) that repeat an accepted one,
        id_a being the least such id. ``texts`` (id, description) are the accepted postings, of which only candidates are read."""
        rows = batch.select("id", F.lit(load).alias("batch"), "source", "url", "external_id", F.col("description").alias("text"))
        prep = written(prepared(rows, self.k, self.min_words), "batch")
        sent = written(probes(prep), "probe").drop("batch")
        found = self.check(sent, load, sent.count()).withColumn("batch", F.lit(load))
        everything = texts.select("id", F.col("description").alias("text")).unionByName(rows.select("id", "text"))
        return resolved(prep, found, everything, self.similarity, self.k)


def resolved(prep: DataFrame, found: DataFrame, texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """(id_a, id_b) from the hits (batch, near, a, b) of batches whose rows are ``prep``: candidates are held against their
    whole ``texts`` (id, text)."""
    exact = prep.select("batch", "id", "key").join(found.where("not near").select("batch", F.col("b").alias("key"), "a"), ["batch", "key"]).select(F.col("a").alias("id_a"), F.col("id").alias("id_b"))
    pairs = written(found.where("near").select("a", "b").distinct(), "paragraph-pairs")
    true = verified(pairs, texts, "id", "text", similarity, k).select("a", "b")
    described_rows = prep.where("digest is not null")
    members = described_rows.groupBy("batch", "digest").agg(F.min("id").alias("b")).join(described_rows.select("batch", "digest", "id"), ["batch", "digest"]).select("b", "id")
    near = true.join(members, "b").select(F.col("a").alias("id_a"), F.col("id").alias("id_b"))
    return exact.unionByName(near).groupBy("id_b").agg(F.min("id_a").alias("id_a")).select("id_a", "id_b")


def repeats_by_batch(
    df: DataFrame, path: str, key: str = "id", batch: str = "batch_no", similarity: float = 0.6, k: int = 3, min_words: int = 30, buckets: int = 64, hot: int = 50_000
) -> DataFrame:
    """(id_a, id_b) as ``repeats``, by sending the batches of ``df`` one after another through a ``History`` below ``path``."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(batch).cast("int").alias("batch"), "source", "url", "external_id", F.col("description").alias("text")).where(
        F.col("id").isNotNull() & F.col("batch").isNotNull()
    )
    prep = written(prepared(rows, k, min_words), "batches", "batch")
    sent = written(probes(prep), "probes", "batch")
    history = History(df.sparkSession, path, buckets, similarity, k, min_words, hot)
    found = None
    for number, count in sorted((r["batch"], r["count"]) for r in sent.groupBy("batch").count().collect()):
        hits = history.check(sent.where(F.col("batch") == number).drop("batch"), number, count).withColumn("batch", F.lit(number))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return df.sparkSession.createDataFrame([], "id_a long, id_b long")
    return resolved(prep, found, rows.select("id", "text"), similarity, k)
