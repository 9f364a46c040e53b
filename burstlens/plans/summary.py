"""Captures to flows, paired queries and the event list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.functions.addresses import KEY
from burstlens.operators import flows, queries, scan
from burstlens.operators.parts import continued
from burstlens.plans.ingest import flowlets_of, with_direction
from burstlens.session import stage
from burstlens.sources import captures, sinks

UPLOAD, RESPONSE = "client_to_server", "server_to_client"


def write_summary(tables: dict[str, DataFrame], path: str, *, scope: tuple[str, ...] = ("source_file",), part_size: int = 10_000) -> None:
    """Flows with their bursts, queries with their responses, and the events, as JSON lines.

    A list longer than ``part_size`` goes on in rows that carry the key, the part
    and the list alone.
    """
    key = [*scope, *KEY]
    body = ["start_ts", "end_ts", "packet_count", "total_bytes", "query_id", "query_role"]
    sinks.write_json(flows.nested_flows(tables["flowlets"], key=key, fields=body, part_size=part_size), f"{path}/flows")
    answers = queries.nested_responses(
        tables["flowlets"], scope=list(scope), fields=[*KEY, "flowlet_id", "start_ts", "end_ts", "total_bytes"],
        order=["start_ts", "flow_at", "flowlet_id"], part_size=part_size)
    told = tables["queries"].join(answers, [*scope, "query_id"], "left")
    sinks.write_json(continued(told, keep=[*scope, "query_id", "response_flowlets"]), f"{path}/queries")
    sinks.write_json(tables["events"], f"{path}/events")


def capture_flowlets(
    spark: SparkSession,
    path: str,
    *,
    glob: str = "capture*.txt",
    gap: float = 0.1,
    bidirectional: bool = False,
    per_file: bool = True,
    parts: bool = True,
    **hints,
) -> DataFrame:
    """Bursts of the captures with their direction, written once: all that follows reads them several times."""
    lines = captures.read_lines(spark, path, glob=glob, parts=parts)
    found = flowlets_of(stage(captures.parse_packets(lines).drop("raw"), "packets"), gap=gap, bidirectional=bidirectional, per_file=per_file)
    return stage(with_direction(found, **hints), "flowlets")


def flow_table(directed: DataFrame, *, per_file: bool = True) -> DataFrame:
    """The flows of a summary."""
    key = [*(["source_file"] if per_file else []), *KEY]
    return flows.flow_summary(directed, key=[*key, "direction"], first="first_at")


def capture_summary(
    spark: SparkSession,
    path: str,
    *,
    per_file: bool = True,
    base_timestamp: str = "2025-12-01T21:00:00.000Z",
    **options,
) -> dict[str, DataFrame]:
    """flows, flowlets (with query number and role), queries, events.

    ``per_file=False`` puts all files on one flow space and one timeline; the
    ordered scans then cut that timeline into slices.  With ``parts`` the part
    files of a folder are one capture; ``options`` are those of ``capture_flowlets``.
    """
    directed = capture_flowlets(spark, path, per_file=per_file, **options)
    scope = ["source_file"] if per_file else []
    key = [*scope, *KEY]
    first_seen = directed.groupBy(*key).agg(F.min("first_at").alias("flow_at"))
    # The scan reads its rows several times to plan slices, so the join is done once.
    dated = stage(directed.join(first_seen, key), "dated")
    paired = queries.pair_queries(
        dated, scope=scope, upload=F.col("direction") == UPLOAD, response=F.col("direction") == RESPONSE,
        order=["flow_at", "flowlet_id"],
    )
    paired = stage(paired, "paired")
    found_queries = queries.query_summary(paired, scope=scope, upload_fields=[*KEY, "flowlet_id"])
    if per_file:
        ordered, order = paired.join(captures.file_ranks(paired), "source_file"), ["_at", "flow_at", "flowlet_id"]
        # One number over the blocks of all files, so that a large file is cut like any other stretch.
        ordered = ordered.withColumn("_block", F.col("flow_at.block"))
        blocks = ordered.select("file_rank", "_block").distinct()
        numbered = scan.sliced_scan(blocks, [], ["file_rank", "_block"], running={"_at": F.lit(1).cast("long")})
        ordered = ordered.join(numbered, ["file_rank", "_block"])
    else:
        ordered, order = paired, ["flow_at", "flowlet_id"]
    return {
        "flowlets": paired,
        "flows": flow_table(directed, per_file=per_file),
        "queries": found_queries,
        "events": queries.traffic_events(
            ordered, found_queries, scope=scope, order=order, base_timestamp=base_timestamp),
    }
