"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings every job relies on. Shuffle partition counts are left to the cluster: AQE
# coalesces small ones and splits skewed ones at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "voicegrid", cores: str | int | None = None,
                  memory: str = "8g", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    cores = cores or os.cpu_count() or 8
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(cores)))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one job below the shared folder named in ``spark.checkpoint.dir``.

    Executors must all see it, so a machine-local folder is used only for a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="voicegrid-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup table for broadcast after counting that it has at most ``rows`` rows.

    A larger one is returned without the mark: the join then shuffles, and the adaptive planner
    splits its skewed keys. Counting stops at the limit.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def materialize(df: DataFrame) -> DataFrame:
    """Store a result that several later jobs read, in the shared checkpoint folder.

    The stored rows outlive a lost executor, and the plan behind them is not run again.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()



FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several parts of a plan read to the shared work folder, as Parquet, and read it back.

    What was shuffled for it is not needed any more and is removed from the executors' disks at once.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
