"""String similarities that Spark has no built-in for, as Arrow-batched UDFs, and joins by similarity without loss."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings; 1 for equal ones, 0 when either is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for j, c in enumerate(b) if taken[j]]
    moved = sum(x != y for x, y in zip(matched, other)) / 2
    m = len(matched)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    base = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * weight * (1 - base)


def jaro_winkler_udf():
    """The similarity as a Column function of two string columns, Arrow-batched; null if either side is null."""

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")

    return similar


def within_edits(df: DataFrame, key: str, name: str, most: int = 3) -> DataFrame:
    """Pairs (a, b, edits), a < b, of all non-empty names within ``most`` edits. Of ``most`` + 1 parts of the shorter name
    one is untouched by so few edits, so it stands in the longer one, at most ``most`` places away: pairs meet by such
    parts. Names of up to 2 * ``most`` letters, which may have empty parts, meet one another without them as well."""
    rows = df.select(F.col(key).alias("k"), F.col(name).alias("t")).where(F.length(name) > 0).withColumn("n", F.length("t"))
    parts = most + 1
    start = lambda n, i: F.floor(n * i / parts).cast("int")
    own = F.array(*[F.struct(F.col("n").alias("m"), F.lit(i).alias("i"), F.substring("t", start(F.col("n"), i) + 1, start(F.col("n"), i + 1) - start(F.col("n"), i)).alias("part")) for i in range(parts)])
    looks = []
    for less in range(most + 1):
        m = F.col("n") - less
        for i in range(parts):
            size = start(m, i + 1) - start(m, i)
            for moved in range(-most, most + 1):
                at = start(m, i) + moved
                looks.append(F.when((m >= parts) & (at >= 0) & (at + size <= F.col("n")), F.struct(m.alias("m"), F.lit(i).alias("i"), F.substring("t", at + 1, size).alias("part"))))
    left = rows.where(F.col("n") >= parts).select("k", "t", F.explode(own).alias("p")).select("k", "t", "p.*")
    right = rows.select("k", "t", F.explode(F.array_distinct(F.array_compact(F.array(*looks)))).alias("p")).select("k", "t", "p.*")
    long = left.alias("x").join(right.alias("y"), ["m", "i", "part"])
    small = rows.where(F.col("n") <= 2 * most)
    short = small.alias("x").join(small.alias("y"), F.col("x.k") < F.col("y.k"))
    both = [p.where("x.k != y.k").select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b"), F.when(F.col("x.k") < F.col("y.k"), F.col("x.t")).otherwise(F.col("y.t")).alias("s"), F.when(F.col("x.k") < F.col("y.k"), F.col("y.t")).otherwise(F.col("x.t")).alias("t")) for p in (long, short)]
    pairs = both[0].unionByName(both[1]).distinct()
    return pairs.select("a", "b", F.levenshtein("s", "t", most).cast("long").alias("edits")).where("edits >= 0")


def alike(df: DataFrame, key: str, name: str, least: float = 0.9, letters: str = "abcdefghijklmnopqrstuvwxyz0123456789 ") -> DataFrame:
    """Pairs (a, b, similarity), a < b, of all non-empty names with a Jaro-Winkler similarity of at least ``least``. Every
    pair is looked at: the letters that two names have in common (those outside ``letters`` count as common) and their
    equal beginning bound the similarity from above, and only pairs whose bound reaches ``least`` are compared."""
    similar = jaro_winkler_udf()
    t = F.col(name)
    counts = [F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in letters]
    other = F.length(t) - reduce(lambda x, y: x + y, counts)
    rows = df.where(F.length(name) > 0).select(F.col(key).alias("k"), t.alias("t"), F.length(t).alias("n"), F.array(*counts, other).alias("c"))
    x, y = rows.alias("x"), rows.alias("y")
    common = F.aggregate(F.zip_with("x.c", "y.c", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    prefix: Column = F.lit(0)
    for i in (1, 2, 3, 4):
        prefix = F.when((F.least("x.n", "y.n") >= i) & (F.substring("x.t", 1, i) == F.substring("y.t", 1, i)), i).otherwise(prefix)
    bound = lambda c: (c / F.col("x.n") + c / F.col("y.n") + 1) / 3
    reaches = lambda c, p: bound(c) + 0.1 * p * (1 - bound(c)) >= least - 1e-9
    near = x.join(y, (F.col("x.k") < F.col("y.k")) & reaches(F.least("x.n", "y.n"), 4) & reaches(common, prefix))
    return near.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), similar("x.t", "y.t").alias("similarity")).where(F.col("similarity") >= least)
