"""A registry of sources and their deduplicated union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources import connectors, postings

Reader = Callable[[SparkSession, str], DataFrame]
#: Readers by name; add further ones with ``register``.
SOURCES: dict[str, Reader] = {"json": postings.read_json} | {board: lambda spark, path, board=board: connectors.read_board(spark, path, board) for board in connectors.BOARDS}


def register(name: str, reader: Reader) -> None:
    SOURCES[name] = reader


def union_of(parts: list[DataFrame], key: str = "url") -> DataFrame:
    """Union by name in which the first part that has a key keeps it; rows with a blank key all stay."""
    every = None
    for i, part in enumerate(parts):
        one = part.withColumns({"_part": F.lit(i), "_row": F.monotonically_increasing_id()})
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    blank = F.trim(F.coalesce(F.col(key), F.lit(""))) == ""
    columns = [c for c in every.columns if c not in (key, "_part", "_row")]
    # A mergeable aggregate: a key that very many rows share is reduced before the shuffle.
    kept = every.where(~blank).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("_part", "_row")).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
    return kept.unionByName(every.where(blank).select(key, *columns))


def fetch(spark: SparkSession, wanted: dict[str, str]) -> DataFrame:
    """Postings of all sources named (source name -> path), deduplicated by url."""
    return union_of([SOURCES[name](spark, path) for name, path in wanted.items()])
