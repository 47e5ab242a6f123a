"""Operational store: upserts, lookups, phrase and ranked search, queues, pages and statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import squeezed, tokens


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Rows by key, the highest ``version`` winning. One shuffle on the key; the winner is picked by a mergeable
    aggregate, so a key with very many versions is reduced before the shuffle."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"), F.count("*").alias("versions")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "versions")


def unseen(incoming: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't in the store; blank keys always pass."""
    blank = F.trim(F.coalesce(F.col(key), F.lit(""))) == ""
    known = store.select(key).where(~blank).distinct()
    return incoming.where(~blank).join(known, key, "left_anti").unionByName(incoming.where(blank).select(key, *[c for c in incoming.columns if c != key]))


def phrase_search(df: DataFrame, phrase: str, columns: list[str]) -> DataFrame:
    """Rows in which the words of ``phrase`` stand next to each other in one of the columns; none for a phrase without words."""
    words = re.findall(r"[a-z0-9]+", phrase.lower())  # parted as the texts are
    if not words:
        return df.limit(0)
    pattern = r"(^|[^a-z0-9])" + r"[^a-z0-9]+".join(words) + r"([^a-z0-9]|$)"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).rlike(pattern)
    return df.where(hit)


def bm25(df: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of rows with any query word, Okapi BM25. Only per-row counts of the query words are shuffled."""
    words = tokens(F.col(text))

    def times(word: str) -> Column:
        return F.size(F.filter("w", lambda x: x == word))

    rows = df.select(F.col(key).alias("k"), words.alias("w")).select("k", F.size("w").alias("len"), *[times(q).alias(f"f{i}") for i, q in enumerate(query)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(query))])
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    any_hit = sum((F.col(f"f{i}") for i in range(len(query))), F.lit(0)) > 0
    # stats is one row, so the join is a broadcast of one row
    return rows.where(any_hit).join(F.broadcast(stats)).select(F.col("k").alias(key), score.alias("score"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order (a top-k: no full sort is materialised)."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of an order, with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def search(df: DataFrame, text: str | None = None, place: str | None = None, remote: bool | None = None, source: str | None = None, least_pay: float | None = None, most_score: float | None = None) -> DataFrame:
    """Composed filters; every one given is pushed to the scan where its form allows."""
    out = df
    if source is not None:
        out = out.where(F.col("source") == source)
    if remote is not None:
        out = out.where(F.col("is_remote") == int(remote))
    if most_score is not None:
        out = out.where(F.col("scam_score") <= most_score)
    if least_pay is not None:
        out = out.where(F.coalesce(F.nanvl("salary_max", F.lit(0.0)), F.lit(0.0)) >= least_pay)
    if text is not None:
        out = out.where(F.lower("title").contains(text.lower()) | F.lower("company").contains(text.lower()) | F.lower("description").contains(text.lower()))
    if place is not None:
        out = out.where(F.lower("location").contains(place.lower()))
    return out


def copied_elsewhere(df: DataFrame, key: str, text: str, owner: str) -> DataFrame:
    """Texts that stand under more than one owner: (digest, owners, rows, first). Owners are compared without case."""
    digest = F.sha2(squeezed(F.col(text)), 256)
    rows = df.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(digest.alias("digest"), F.lower(F.coalesce(F.col(owner), F.lit(""))).alias("owner"), F.col(key).alias("k"))
    by_owner = rows.groupBy("digest", "owner").agg(F.count("*").alias("rows"), F.min("k").alias("first"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("rows").alias("rows"), F.min("first").alias("first")).where("owners > 1")


def latest_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order within each key."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
