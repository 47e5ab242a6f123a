"""Spreading of hot keys before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import written

#: One row in so many is counted to see which keys are hot. Only where rows go depends on it, never a result.
SAMPLE = 32
#: Hot keys that are broadcast (12 bytes each); a longer list is joined by a shuffle.
MAX_BROADCAST_KEYS = 1_000_000


def hot_keys(df: DataFrame, key: str, row_id: str, hot: int) -> DataFrame | None:
    """A written table of the keys (longs) that hold more than about ``hot`` rows, with the number of blocks of about so
    many rows (``blocks``), or None. The bound is the same for every size of the input."""
    sample = df.where(F.pmod(F.xxhash64(F.lit(17), row_id), F.lit(SAMPLE)) == 0)
    size = max(hot / SAMPLE, 8)
    counts = sample.groupBy(key).count().where(F.col("count") > size)
    found = written(counts.select(key, F.ceil(F.col("count") / size).cast("int").alias("blocks")), "hot-keys")
    return found if found.limit(1).count() else None


def _list(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot) if hot.count() <= MAX_BROADCAST_KEYS else hot.hint("shuffle_merge")


def spread(df: DataFrame, key: str, hot: DataFrame | None, parts: int, part_value: Column) -> DataFrame:
    """Where keys are hot, add ``only`` (-1, or a part 0..parts-1) and replace each row with a hot key by one row per part
    whose key also depends on ``part_value`` (an expression over ``only``)."""
    if hot is None:
        return df
    plain = df.withColumn("only", F.lit(-1).cast("byte"))
    listed = _list(hot.select(key))
    cut = df.join(listed, key, "left_semi").withColumn("only", F.explode(F.array(*[F.lit(i).cast("byte") for i in range(parts)]))).withColumn(key, F.xxhash64(key, "only", part_value))
    return plain.join(listed, key, "left_anti").unionByName(cut)


def blocked(df: DataFrame, key: str, row_id: str, hot: DataFrame | None) -> DataFrame:
    """``df`` with ``side``, without loss of a pair: the rows of a hot key fall into blocks, and each two blocks (and each
    block alone) become a key of their own. Two rows of a key are to be paired if ``may_pair`` holds for their sides; that is
    so under exactly one key for each pair."""
    if hot is None:
        return df.withColumn("side", F.lit(-1).cast("byte"))
    listed = _list(hot)
    own = F.pmod(F.xxhash64(F.lit(29), row_id), F.col("blocks").cast("long")).cast("int")
    cut = df.join(listed, key).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), -1).when(F.col("_own") < F.col("_other"), 0).otherwise(1).cast("byte")
    cut = cut.withColumn("side", side).withColumn(key, F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other", "blocks")
    plain = df.withColumn("side", F.lit(-1).cast("byte"))
    return plain.join(listed, key, "left_anti").unionByName(cut)


def may_pair(x: Column, y: Column) -> Column:
    """May two rows of one key be paired, given their sides?"""
    return (x == -1) | (x != y)
