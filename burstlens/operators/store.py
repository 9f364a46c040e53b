"""Queries over the stored captures and bursts tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.functions import labels
from burstlens.sources.captures import file_ranks


def capture_counts(flowlets: DataFrame, *, capture: str = "capture_id") -> DataFrame:
    """All, llm and classified bursts per capture in one aggregation."""
    return flowlets.groupBy(capture).agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.sum(F.coalesce(F.col("traffic_class") == "llm", F.lit(False)).cast("long")).alias("llm_flow_count"),
        F.count("model_llm_prediction").alias("classified_count"),
    )


def _with_counts(captures: DataFrame, flowlets: DataFrame, key: str) -> DataFrame:
    counts = capture_counts(flowlets).withColumnRenamed("capture_id", key)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("flow_count", "llm_flow_count", "classified_count")}
    return captures.join(counts, key, "left").withColumns(zero)


def capture_listing(captures: DataFrame, flowlets: DataFrame, *, key: str = "id") -> DataFrame:
    """Captures, newest first; the llm count shows once any burst is classified."""
    out = _with_counts(captures, flowlets, key)
    shown = F.when(F.col("classified_count") > 0, F.col("llm_flow_count"))
    return out.withColumn("llm_flow_count", shown).drop("classified_count").orderBy(F.desc("created_at"), key)


def capture_detail(captures: DataFrame, flowlets: DataFrame, *, key: str = "id") -> DataFrame:
    """Captures with counts; the llm count is always shown."""
    return _with_counts(captures, flowlets, key).drop("classified_count")


def of_capture(df: DataFrame, capture_id: int, *, capture: str = "capture_id") -> DataFrame:
    return df.where(F.col(capture) == F.lit(capture_id))


def flowlet_page(
    flowlets: DataFrame, *, skip: int = 0, limit: int = 1000, order: Sequence[str] = ("start_ts", "id")
) -> DataFrame:
    """One page of bursts in time order; ``id`` breaks ties."""
    return flowlets.orderBy(*order).offset(skip).limit(limit)


def chart(flowlets: DataFrame, *, by: Sequence[str] = (), ts: str = "start_ts", width: float = 10) -> DataFrame:
    """Bytes, llm bytes and bursts per time bucket of ``width``."""
    llm = labels.is_llm_row(F.col("traffic_class"), F.col("model_llm_prediction"))
    bucket = (F.floor(F.col(ts) / F.lit(width)) * F.lit(width)).cast("long")
    return flowlets.groupBy(*by, bucket.alias("time")).agg(
        F.sum("total_bytes").alias("total_bytes"),
        F.sum(F.when(llm, F.col("total_bytes")).otherwise(0)).alias("llm_bytes"),
        F.count(F.lit(1)).alias("count"),
    )


def chart_points(buckets: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The buckets of a chart in order of time."""
    return buckets.orderBy(*by, "time")


def new_captures(files: DataFrame, captures: DataFrame) -> DataFrame:
    """Files that are not registered yet."""
    return files.join(captures.select("file_path"), "file_path", "left_anti")


def register_captures(
    files: DataFrame, captures: DataFrame, *, created_at: Column, status: str = "completed", maps: DataFrame | None = None
) -> DataFrame:
    """Registry rows of the files that are new, with ids after the highest one.

    ``maps`` (file_path, llm_ip_map) gives the stored address map.
    """
    fresh = new_captures(files.select("file_path").distinct(), captures)
    ranked = file_ranks(fresh, file="file_path")
    top = captures.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    empty = F.create_map().cast("map<string,string>")
    if maps is None:
        rows = ranked.withColumn("llm_ip_map", empty)
    else:
        rows = ranked.join(maps.select("file_path", "llm_ip_map"), "file_path", "left")
        rows = rows.withColumn("llm_ip_map", F.coalesce("llm_ip_map", empty))
    return rows.select(
        (F.col("file_rank") + top).alias("id"), "file_path", created_at.cast("timestamp").alias("created_at"),
        F.lit(status).alias("status"), "llm_ip_map", F.lit(None).cast("string").alias("notes"),
    )


def require_capture(captures: DataFrame, capture_id: int, *, key: str = "id") -> DataFrame:
    """The capture's row; an unknown capture is an error."""
    one = captures.where(F.col(key) == F.lit(capture_id))
    if one.isEmpty():
        raise LookupError(f"capture {capture_id} not found")
    return one


def unparsed_captures(captures: DataFrame, flowlets: DataFrame, *, key: str = "id") -> DataFrame:
    """Captures that have no bursts yet."""
    parsed = flowlets.select(F.col("capture_id").alias(key)).distinct()
    return captures.join(parsed, key, "left_anti")


def current_status(log: DataFrame, *, capture: str = "capture_id") -> DataFrame:
    """Latest entry of the append-only status log per capture."""
    return log.groupBy(capture).agg(
        F.max_by("status", "changed_at").alias("status"), F.max("changed_at").alias("changed_at")
    )


def with_predictions(flowlets: DataFrame, predictions: DataFrame, *, key: str = "id") -> DataFrame:
    """Stored bursts with new predictions; rows without one keep theirs."""
    names = ("model_llm_prediction", "model_llm_confidence")
    new = predictions.select(key, F.lit(True).alias("_new"), *[F.col(n).alias(f"_{n}") for n in names])
    out = flowlets.join(new, key, "left")
    out = out.withColumns({n: F.when(F.col("_new"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names})
    return out.drop("_new", *[f"_{n}" for n in names])


def without_captures(flowlets: DataFrame, deleted: DataFrame, *, capture: str = "capture_id") -> DataFrame:
    """Bursts left after their captures were deleted."""
    return flowlets.join(deleted.select(capture), capture, "left_anti")
