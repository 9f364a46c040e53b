"""Stored bursts and prompt banks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.schemas import FLOWLET, PROMPT_BANK


def read_flowlet_json(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Burst records from JSON, one per line, which splits across tasks;
    ``multi_line=True`` reads files that hold one list each, whole."""
    return spark.read.schema(FLOWLET).json(path, multiLine=multi_line)


def read_flowlet_table(spark: SparkSession, path: str, capture_id: int | None = None) -> DataFrame:
    """The stored burst table; the capture filter prunes partitions."""
    table = spark.read.parquet(path)
    return table if capture_id is None else table.where(F.col("capture_id") == int(capture_id))


def load_flowlets(
    spark: SparkSession, path: str, source: str = "json", *, capture_id: int | None = None, **options
) -> DataFrame:
    if source == "json":
        return read_flowlet_json(spark, path, **options)
    if source == "table":
        return read_flowlet_table(spark, path, capture_id)
    raise ValueError(f"unsupported source type: {source}")


def read_prompt_bank(
    spark: SparkSession, path: str, *, missing_ok: bool = False, multi_line: bool = True
) -> DataFrame:
    """Prompt chains from a JSON list of objects.

    A missing file is empty with ``missing_ok`` and an error otherwise.  A file
    that does not hold a list of objects is an error on first use.
    """
    try:
        bank = spark.read.schema(PROMPT_BANK).json(path, multiLine=multi_line, mode="FAILFAST")
        bank.inputFiles()
        return bank
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if not missing_ok:
            raise FileNotFoundError(f"prompt bank not found at {path}") from e
        return spark.createDataFrame([], PROMPT_BANK)
