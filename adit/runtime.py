"""Session settings and the few runtime services that operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Sides of at most this many rows may be sent to every executor; each caller counts before it broadcasts.
BROADCAST_ROWS = 20_000


def local_session(cpus: int | None = None, app: str = "adit", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    n = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of this machine only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + str(Path(tempfile.gettempdir()) / "adit-checkpoints")


def _own(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/adit/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; DataFrames made of it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back, so that what follows doesn't compute it again.

    Parquet keeps the columns apart, so later readers prune them; a checkpoint would keep whole rows.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that are written to be read again."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; looks at no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
