"""Session helpers: shared scratch folder, checkpoints, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Above this many rows a side is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="burstlens-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/burstlens/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a small fitted table is computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a large intermediate table below the shared folder and read it back.

    Later passes read only their columns, and a lost executor costs no
    recomputation of what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hint_if_small(fixed: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a settled table has at most ``max_rows`` rows.

    Beyond that the table is returned unhinted: the join is then a shuffle
    join whose skewed partitions the adaptive planner splits.
    """
    return F.broadcast(fixed) if fixed.count() <= max_rows else fixed


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``hint_if_small`` of a table that is settled here first."""
    return hint_if_small(settle(df), max_rows)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder that no later step reads."""
    if "/burstlens/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
