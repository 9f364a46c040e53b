"""Uploads paired with their responses, and the event list made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.functions import labels, render
from burstlens.operators.scan import TARGET_ROWS, sliced_scan


def timeline(
    flowlets: DataFrame, *, direction: str = "direction", upload: str = "client_to_server",
    response: str = "server_to_client",
) -> DataFrame:
    """Bursts with a known direction."""
    return flowlets.where(F.col(direction).isin(upload, response))


def pair_queries(
    events: DataFrame,
    *,
    scope: Sequence[str],
    start: str = "start_ts",
    end: str = "end_ts",
    upload: Column,
    response: Column,
    order: Sequence[str],
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``query_id``, ``query_role`` and ``next_upload_ts``.

    Uploads are numbered 1..n per scope in start order.  A response belongs to
    the last upload that starts at or before it, provided the upload has ended
    by then: a backward as-of join done as one ordered scan.  An empty scope is
    one timeline over everything, which the scan cuts into slices.
    """
    marked = events.withColumns({"_up": F.coalesce(upload, F.lit(False)), "_resp": F.coalesce(response, F.lit(False))})
    # At equal start an upload stands before the responses.
    marked = marked.withColumn("_rank", F.when(F.col("_up"), 0).otherwise(1))
    seen = sliced_scan(
        marked, scope, [start, "_rank", *order], target_rows=target_rows,
        running={"_q": F.col("_up").cast("long")},
        carry={"_end": F.when(F.col("_up"), F.col(end))},
    )
    matched = F.col("_resp") & (F.col("_q") > 0) & (F.col(start) >= F.col("_end"))
    role = F.when(F.col("_up"), "upload").when(matched, "response")
    out = seen.withColumn("query_role", role).withColumn(
        "query_id", F.when(F.col("query_role").isNotNull(), F.col("_q"))
    )
    return out.drop("_up", "_resp", "_rank", "_q", "_end")


def next_upload(
    uploads: DataFrame, *, scope: Sequence[str], start: str = "start_ts", order: Sequence[str],
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add the start of the following upload of the scope."""
    return sliced_scan(
        uploads, scope, [start, *order], target_rows=target_rows, lead={"next_upload_ts": F.col(start)}
    )


def query_summary(
    paired: DataFrame,
    *,
    scope: Sequence[str],
    start: str = "start_ts",
    end: str = "end_ts",
    size: str = "total_bytes",
    upload_fields: Sequence[str] = (),
) -> DataFrame:
    """One row per query; an upload without response stays with bytes 0.

    Everything is a combinable aggregate, so a query with very many responses
    is summed before the shuffle.
    """
    up, resp = F.col("query_role") == "upload", F.col("query_role") == "response"
    of = lambda cond, c: F.when(cond, F.col(c))
    out = paired.where(F.col("query_id").isNotNull()).groupBy(*scope, "query_id").agg(
        *[F.max(of(up, c)).alias(f"upload_{c}") for c in upload_fields],
        F.max(of(up, start)).alias("upload_start_ts"),
        F.max(of(up, end)).alias("upload_end_ts"),
        F.max(of(up, size)).alias("upload_bytes"),
        F.min(of(resp, start)).alias("response_start_ts"),
        F.max(of(resp, end)).alias("response_end_ts"),
        F.coalesce(F.sum(of(resp, size)), F.lit(0)).alias("response_bytes"),
        F.count(of(resp, "query_role")).alias("responses"),
    )
    return out.withColumn("confidence", F.when(F.col("responses") > 0, "high").otherwise("low"))


def nested_responses(
    paired: DataFrame, *, scope: Sequence[str], fields: Sequence[str], order: Sequence[str], part_size: int = 10_000,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Responses of each query as a list, in parts of ``part_size``."""
    ident = [*scope, "query_id"]
    rows = paired.where(F.col("query_role") == "response")
    numbered = sliced_scan(rows, ident, list(order), target_rows=target_rows, running={"_n": F.lit(1).cast("long")})
    part = F.floor((F.col("_n") - 1) / part_size).cast("int").alias("part")
    items = F.sort_array(F.collect_list(F.struct("_n", F.struct(*fields).alias("r"))))
    packed = numbered.groupBy(*ident, part).agg(items.alias("_i"))
    return packed.select(*ident, "part", F.col("_i.r").alias("response_flowlets"))


def first_queries(queries: DataFrame, n: int = 10, *, scope: Sequence[str] = ()) -> DataFrame:
    return queries.orderBy(*scope, "query_id").limit(n)


def traffic_events(
    paired: DataFrame,
    queries: DataFrame,
    *,
    scope: Sequence[str],
    order: Sequence[str],
    base_timestamp: str = "2025-12-01T21:00:00.000Z",
    start_seconds: Column | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Event list: number over flows and bursts, ISO time, defaults, confidence.

    ``paired`` needs src_ip, dst_ip, protocol and total_bytes.  ``order`` is
    the global order (a number first); the numbering is a running count over
    slices of it.  Rows are numbered before they are joined, as the scan reads
    its input several times.
    """
    words = queries.select(*scope, F.col("query_id").alias("_q"), "confidence")
    # Rows without a query are spread over many keys that match nothing.
    spread = F.coalesce("query_id", -1 - F.pmod(F.xxhash64(*order), F.lit(4096)))
    seconds = F.col("start_ts") if start_seconds is None else start_seconds
    told = paired.select(
        *scope, *[c for c in order if c not in scope], "src_ip", "dst_ip", "protocol", "total_bytes", "query_id", seconds.alias("_seconds"))
    counted = sliced_scan(told, [], list(order), target_rows=target_rows, running={"_n": F.lit(1).cast("long")})
    numbered = counted.withColumn("_q", spread).join(words, [*scope, "_q"], "left")
    used = F.col("query_id").isNotNull()
    base = F.to_timestamp(F.lit(base_timestamp))
    return numbered.select(
        F.concat(F.lit("evt_"), F.col("_n").cast("string")).alias("id"),
        render.iso_time(base, F.col("_seconds")).alias("timestamp"),
        F.lit("unknown").alias("userId"),
        render.or_unknown(F.col("src_ip")).alias("srcIp"),
        render.or_unknown(F.col("dst_ip")).alias("dstIp"),
        F.col("total_bytes").alias("bytes"),
        render.or_unknown(F.col("protocol"), "UNKNOWN").alias("protocol"),
        used.alias("llmUsage"),
        F.when(used, "unknown").alias("llmProvider"),
        F.when(used, "unknown").alias("llmModel"),
        F.when(used, labels.confidence_number(F.col("confidence"))).alias("llmConfidence"),
    )
