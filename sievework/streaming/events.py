"""Streaming variants of the stateful operators; each gives what its batch twin gives on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievework.session import shared_dir


def stream_of(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A parquet table or folder as a stream."""
    kind = schema or spark.read.parquet(path).schema
    import os

    folder = path if os.path.isdir(path.removeprefix("file://")) else os.path.dirname(path)
    name = {} if folder == path else {"pathGlobFilter": os.path.basename(path)}
    return spark.readStream.schema(kind).options(**name).parquet(folder)


def windowed(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` behind the newest are dropped."""
    rows = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.unix_micros("w.start").alias("start_us"), "n")


def first_seen(stream: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark."""
    return stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def running_average(stream: DataFrame, key: str, at: str, value: str, alpha: float) -> DataFrame:
    """(key, n, ema) after every micro-batch: an exponential moving average kept as state. Rows of a batch are taken in
    the order of ``at``."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["at", "value"])
        for v in rows["value"]:
            ema = float(v) if n == 0 else ema * (1 - alpha) + float(v) * alpha
            n += 1
        state.update((n, ema))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [ema]})

    rows = stream.select(F.col(key), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("value"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there now and give its result as a table in the shared folder: every micro-batch is a
    folder of its own, so one that is run again replaces itself. In mode complete the last one is the result."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/sievework/{name}_{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows" if mode == "complete" else f"{base}/rows/batch={number}")

    run = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows") if run.lastProgress else spark.createDataFrame([], stream.schema)


def sliding(stream: DataFrame, at: str, key: str, width: str, slide: str, late: str) -> DataFrame:
    """Counts per key and sliding window."""
    rows = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width, slide).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.unix_micros("w.start").alias("start_us"), "n")


def sessions(stream: DataFrame, at: str, key: str, pause: str, late: str) -> DataFrame:
    """Counts per key and session; a session ends after ``pause`` without an event."""
    rows = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", pause).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
