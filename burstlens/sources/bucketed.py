"""Stored bursts in hash buckets of their id: predictions are joined to them where they lie.

A store is a folder with tables bucketed and sorted by ``id``: ``bursts``, and ``predictions`` that are appended to and joined in when
read. Both have the same buckets, so that neither the join nor the choice of the newest prediction moves a stored burst. The id, not
the capture, sets the bucket: a capture that holds a third of all rows spreads over all buckets. Ids that begin with the capture
number (``sinks.with_row_ids``) put a capture's rows side by side in every bucket, so that a filter by capture skips the other row
groups; there is no folder per capture.

The folder is the truth; the catalog names are made again by ``open_store`` in every session. The bucket count is part of
the folder's name: a store opened with another count is not found.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS = 2_000_000
PREDICTION = "id bigint, model_llm_prediction string, model_llm_confidence double, version bigint"
PREDICTED = ("model_llm_prediction", "model_llm_confidence")


def bucket_count(rows: int, *, bucket_rows: int = BUCKET_ROWS) -> int:
    """A power of two, so that stores of different sizes still join bucket by bucket."""
    return 1 << (max(1, -(-rows // bucket_rows)) - 1).bit_length()


def _named(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z]\w*", name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def _folder(path: str, kind: str, buckets: int) -> str:
    return f"{path.rstrip('/')}/{kind}-{buckets}"


def _append(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """One file a bucket: the exchange before the write deals rows as the buckets do."""
    dealt = df.repartition(buckets, "id").sortWithinPartitions("id")
    dealt.write.format("parquet").mode("append").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(table)


def create_store(flowlets: DataFrame, name: str, path: str, *, buckets: int) -> None:
    """Write ``flowlets`` (a distinct, non-null long ``id``) as a new store; an empty table makes an empty store."""
    spark = flowlets.sparkSession
    name = _named(name)
    for kind, rows in (("bursts", flowlets), ("predictions", spark.createDataFrame([], PREDICTION))):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")  # the name alone; an outside folder stays
        _append(rows, f"{name}_{kind}", _folder(path, kind, buckets), buckets)


def open_store(spark: SparkSession, name: str, path: str, *, buckets: int) -> None:
    """Name the tables of the store at ``path`` in this session's catalog."""
    name = _named(name)
    for kind in ("bursts", "predictions"):
        folder = _folder(path, kind, buckets)
        try:
            schema = spark.read.parquet(folder).schema if kind == "bursts" else spark.createDataFrame([], PREDICTION).schema
        except AnalysisException as e:
            raise FileNotFoundError(f"no store of {buckets} buckets at {path}") from e
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")
        spark.sql(f"CREATE TABLE {name}_{kind} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS "
                  f"LOCATION '{folder}'")


def close_store(spark: SparkSession, name: str) -> None:
    """Forget the names; the folders stay."""
    for kind in ("bursts", "predictions"):
        spark.sql(f"DROP TABLE IF EXISTS {_named(name)}_{kind}")


def append_bursts(flowlets: DataFrame, name: str, path: str, *, buckets: int) -> None:
    """Add the bursts of new captures."""
    _append(flowlets, f"{_named(name)}_bursts", _folder(path, "bursts", buckets), buckets)


def append_predictions(predictions: DataFrame, name: str, path: str, *, version: int, buckets: int) -> None:
    """Add predictions (id, prediction, confidence); among several of a burst the highest ``version`` counts.

    The only rows moved are the new predictions. Two of one id in one version count as the greater (prediction, confidence).
    """
    rows = predictions.select(F.col("id").cast("long"), F.col(PREDICTED[0]).cast("string"), F.col(PREDICTED[1]).cast("double"),
                              F.lit(version).cast("long").alias("version"))
    _append(rows, f"{_named(name)}_predictions", _folder(path, "predictions", buckets), buckets)


def bursts(spark: SparkSession, name: str, *, capture_id: int | None = None, capture: str = "capture_id") -> DataFrame:
    """Stored bursts with their newest predictions; bursts without a later one keep what they were stored with.

    Predictions of an unknown id are not shown.
    """
    stored = spark.table(f"{_named(name)}_bursts")
    said = spark.table(f"{name}_predictions")
    if capture_id is not None:
        stored = stored.where(F.col(capture) == F.lit(capture_id))
    newest = said.groupBy("id").agg(F.max(F.struct("version", *PREDICTED)).alias("_new"))
    out = stored.join(newest, "id", "left")
    new = F.col("_new")
    return out.withColumns({c: F.when(new.isNotNull(), new[c]).otherwise(F.col(c)) for c in PREDICTED}).drop("_new").select(*stored.columns)


def compact(spark: SparkSession, name: str, path: str, new_path: str, *, buckets: int, new_buckets: int | None = None,
            deleted: DataFrame | None = None, capture: str = "capture_id") -> int:
    """Write the store anew at ``new_path`` with predictions merged in and ``deleted`` captures gone; returns its buckets.

    The old folder stays whole until its owner deletes it, so a failed run loses nothing. The count of buckets follows
    the rows unless given; equal counts keep every row in its bucket.
    """
    open_store(spark, name, path, buckets=buckets)
    rows = bursts(spark, name)
    if deleted is not None:
        rows = rows.join(deleted.select(capture).distinct(), capture, "left_anti").select(*rows.columns)
    into = new_buckets or max(buckets, bucket_count(rows.count()))
    fresh = f"{name}_new"
    create_store(rows, fresh, new_path, buckets=into)
    close_store(spark, fresh)
    open_store(spark, name, new_path, buckets=into)
    return into
