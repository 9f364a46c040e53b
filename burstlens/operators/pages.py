"""Pages of a long listing, stored so that a page is found without sorting or skipping.

``write_pages`` sorts once by range, numbers the rows, and writes parts of exactly ``page_rows`` rows, as many of them per folder as make
``ROWS_A_FOLDER`` rows, with a directory of each part's first and last key. A page by number reads the one or two folders that hold its
parts; a cursor (the last key seen) reads the directory and from its part on. Keys must be distinct: end the order with an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from burstlens.session import scratch_path, stage

ROWS_A_RANGE = 1_000_000
# Folders grow in number with the rows, not with the pages, however small these are.
ROWS_A_FOLDER = 1_000_000


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``row``, its place from 0 in the whole order; only the sizes of the ranges are summed in one place."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_RANGE))
    path = scratch_path(spark, "ranges")
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    shift = sizes.select("_range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"))
    return rows.join(F.broadcast(shift), "_range").withColumn("row", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def write_pages(df: DataFrame, path: str, *, order: Sequence[str], page_rows: int = 1000) -> None:
    """Rows below ``path``/rows/in_part=k, and the directory below ``path``/directory: part, rows, first and last key."""
    spark = df.sparkSession
    rows = numbered(stage(df, "listing"), order).withColumn("part", F.expr(f"row div {int(page_rows)}"))
    rows = rows.withColumn("in_part", _folder(F.col("part"), page_rows))
    if rows.isEmpty():
        rows.write.parquet(f"{path}/rows")  # no part folder could carry the columns
    else:
        rows.write.partitionBy("in_part").parquet(f"{path}/rows")
    key = F.struct(*order)
    stored = spark.read.parquet(f"{path}/rows")
    stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).withColumn(
        "page_rows", F.lit(page_rows)).write.parquet(f"{path}/directory")


def _folder(part: Column, page_rows: int) -> Column:
    """The folder that holds a part."""
    return F.floor(part / max(1, ROWS_A_FOLDER // page_rows)).cast("long")


def directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/directory")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def _between(rows: DataFrame, first: int, last: int, page_rows: int) -> DataFrame:
    """The rows of some parts; only their folders are read."""
    folders = F.col("in_part").between(_folder(F.lit(first), page_rows), _folder(F.lit(last), page_rows))
    return rows.where(folders & F.col("part").between(first, last)).drop("in_part")


def page(spark: SparkSession, path: str, *, skip: int = 0, limit: int = 1000) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of the order; only their parts are read."""
    size = directory(spark, path).select("page_rows").first()
    if size is None or limit <= 0:
        return _rows(spark, path).limit(0).drop("part", "in_part")
    first, last = skip // size[0], (skip + limit - 1) // size[0]
    rows = _between(_rows(spark, path), first, last, size[0])
    return rows.where(F.col("row").between(skip, skip + limit - 1)).drop("part")


def after(spark: SparkSession, path: str, cursor: Row | None, *, order: Sequence[str], limit: int = 1000) -> DataFrame:
    """The ``limit`` rows behind the key ``cursor`` (from the beginning without one)."""
    parts = directory(spark, path)
    if cursor is not None:
        key = F.struct(*[F.lit(cursor[c]).cast(parts.schema["last"].dataType[c].dataType).alias(c) for c in order])
        parts = parts.where(F.col("last") > key)
    first = parts.agg(F.min("part"), F.max("page_rows")).first()
    if first[0] is None:
        return _rows(spark, path).limit(0).drop("part", "row", "in_part")
    rows = _between(_rows(spark, path), first[0], first[0] + -(-limit // first[1]), first[1])
    rows = rows if cursor is None else rows.where(F.struct(*order) > key)
    return rows.orderBy(*order).limit(limit).drop("part", "row")


