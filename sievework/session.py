"""Session helpers: table loading, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of a data directory, projected to ``columns`` when given so that the scan is pruned."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is read from ``spark.checkpoint.dir``; a folder of our own is used only
    where that setting is absent (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="sievework-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors and
    keeps a costly stage from being computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievework/{label}-{uuid.uuid4().hex}"
    out = df.write.mode("errorifexists")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on every executor (once per application), however the session was started."""
    import os
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_sievework_shipped", False):
        return spark
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sievework-code-"), "sievework.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(home):
            for name in files:
                if not name.endswith(".pyc"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("sievework", os.path.relpath(full, home)))
    context.addPyFile(target)
    context._sievework_shipped = True
    return spark
