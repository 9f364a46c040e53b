"""Flow summaries built from bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flow_summary(
    flowlets: DataFrame, *, key: Sequence[str], first: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Packets, bytes, start, end and number of bursts per flow.

    Summed from the burst table, which is far smaller than the packets.
    ``first`` names the order number of a burst; its minimum is ``flow_ord``,
    the place where the flow appears first.
    """
    order = [F.min(first).alias("flow_ord")] if first else []
    return flowlets.groupBy(*key, *keep).agg(
        F.sum("packet_count").alias("packets"),
        F.sum("total_bytes").alias("bytes"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.count(F.lit(1)).alias("flowlets"),
        *order,
    )


def nested_flows(
    flowlets: DataFrame, *, key: Sequence[str], fields: Sequence[str], part_size: int = 10_000
) -> DataFrame:
    """Nested form: one row per flow with its list of bursts.

    A flow with more than ``part_size`` bursts continues in further rows
    (``part`` 1, 2, ...), so the lists stay bounded.  The totals are those of the
    whole flow and stand in part 0 alone.
    """
    part = F.floor((F.col("flowlet_id") - 1) / part_size).cast("int").alias("part")
    body = F.struct(F.col("flowlet_id").alias("id"), *[c for c in fields if c != "flowlet_id"])
    lists = flowlets.groupBy(*key, part).agg(F.sort_array(F.collect_list(body)).alias("flowlets"))
    totals = flow_summary(flowlets, key=key).drop("flowlets").withColumn("_part", F.lit(0))
    same = [lists[k].eqNullSafe(totals[k]) for k in key] + [lists["part"] == totals["_part"]]
    return lists.join(totals, same, "left").select(
        *[lists[k] for k in key], "part", "packets", "bytes", "start_ts", "end_ts", lists["flowlets"])


def top_flows(flows: DataFrame, n: int = 10, *, ties: Sequence[str] = ("flow_ord",)) -> DataFrame:
    """The ``n`` flows with most bytes; ties in flow order."""
    return flows.orderBy(F.desc("bytes"), *ties).limit(n)


def capture_totals(flows: DataFrame, *, file: str = "source_file", keep: Sequence[str] = ()) -> DataFrame:
    """Flows, bursts and packets per capture file."""
    return flows.groupBy(file, *keep).agg(
        F.count(F.lit(1)).alias("flows_count"),
        F.sum("flowlets").alias("flowlets_count"),
        F.sum("packets").alias("packets"),
    )


def dataset_totals(captures: DataFrame) -> DataFrame:
    """One row over all captures."""
    return captures.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.sum("flows_count").alias("total_flows"),
        F.sum("flowlets_count").alias("total_flowlets"),
    )


def class_totals(flows: DataFrame, *, cls: str = "traffic_class", positive: str = "llm") -> DataFrame:
    """Flows of the positive class and all others, in one pass."""
    hit = F.coalesce(F.col(cls) == positive, F.lit(False))
    return flows.agg(
        F.sum(hit.cast("long")).alias("llm_flows"), F.sum((~hit).cast("long")).alias("non_llm_flows")
    )
