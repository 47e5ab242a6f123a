"""Mutations of stored tables as joins: column-wise merges, accumulating upserts, insert-or-ignore, and what a batch did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key. The new value wins unless it is null; for columns in ``keep`` the old one wins. ``new`` has one
    row per key and the columns of ``old``."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c in keep or c == key else F.coalesce(f"b.{c}", f"a.{c}")
    return both.select(*[pick(c).alias(c) for c in old.columns])


def accumulated(old: DataFrame, new: DataFrame, key: str, add: tuple[str, ...], last: tuple[str, ...]) -> DataFrame:
    """Counters of both added by key; columns in ``last`` take the new value where there is one."""
    rows = old.select(key, *add, *last, F.lit(0).alias("_o")).unionByName(new.select(key, *add, *last, F.lit(1).alias("_o")))
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in add], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in last])


def first_kept(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Insert-or-ignore: one row per key set with its earliest ``at``."""
    return old.select(*keys, at).unionByName(new.select(*keys, at)).groupBy(*keys).agg(F.min(at).alias(at))


def batch_effect(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(inserted, updated, rejected): what writing ``new`` would do; rows with a blank key are rejected, repeated keys
    count once."""
    blank = F.trim(F.coalesce(F.col(key), F.lit(""))) == ""
    rejected = new.agg(F.count_if(blank).alias("rejected"))
    known = old.select(key, F.lit(True).alias("_k")).where(~blank).distinct()
    fresh = new.where(~blank).select(key).distinct().join(known, key, "left").agg(F.count_if(F.col("_k").isNull()).alias("inserted"), F.count_if(F.col("_k").isNotNull()).alias("updated"))
    return fresh.join(F.broadcast(rejected))  # one row each


def verdicts(jobs: DataFrame, reports: DataFrame, key: str, at: str, order: str, verdict: str) -> DataFrame:
    """Jobs with the verdict of their latest report (ties by ``order``), null without one."""
    last = reports.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(verdict, F.struct(at, order)).alias("verdict"), F.count("*").alias("reports"))
    return jobs.join(last, key, "left").withColumn("reports", F.coalesce("reports", F.lit(0)))
