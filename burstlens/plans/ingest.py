"""Capture text to labelled bursts, in the three ways captures are labelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.functions.addresses import KEY, direction_code, flow_direction, flow_key_columns
from burstlens.operators import addresses, bursts, flows
from burstlens.session import stage
from burstlens.sources import capture_reader, captures

AT = ("block", "row")


def flowlets_of(
    packets: DataFrame,
    *,
    gap: float = 0.1,
    bidirectional: bool = False,
    per_file: bool = True,
    keep: tuple[str, ...] = (),
    **options,
) -> DataFrame:
    """Bursts of parsed packets; flows are per file or span all files."""
    keyed = packets.withColumns(flow_key_columns(bidirectional=bidirectional))
    key = (["source_file"] if per_file else []) + list(KEY)
    order = list(AT) if per_file else ["source_file", *AT]
    with_ids = bursts.with_bursts(keyed, key=key, order=order, gap=gap, **options)
    return bursts.burst_features(with_ids, key=key, keep=keep, first=F.struct(*order))


def flowlets_by_address(
    spark: SparkSession, path: str, *, glob: str = "capture*.txt", gap: float = 0.1, bidirectional: bool = False,
    carry: bool = True, ranges: bool = False, range_bytes: int = capture_reader.RANGE_BYTES, parts: bool = True,
) -> DataFrame:
    """Bursts labelled by the address headers of the captures.

    With ``carry`` a file also sees the headers of all earlier files (directory
    run); without it only its own (single-capture run).  Ground truth always
    comes from the file's own header.  With ``ranges`` the captures, in ``path`` and
    below, are read by byte ranges (``capture_reader``): lines are not exchanged and headers cost
    the leading lines.  With ``parts``, here and below, the part files of a folder
    are one capture.
    """
    if ranges:
        joined = captures.join_parts if parts else lambda rows: rows
        packets = captures.parse_pairs(joined(capture_reader.read_pairs(spark, path, glob=glob, recursive=True, range_bytes=range_bytes)))
        headers = captures.header_map(joined(capture_reader.read_header_lines(spark, path, glob=glob, recursive=True)))
    else:
        lines = captures.read_lines(spark, path, glob=glob, parts=parts)
        packets, headers = captures.parse_packets(lines), captures.read_headers(lines)
    found = flowlets_of(stage(packets.drop("raw"), "packets"), gap=gap, bidirectional=bidirectional)
    seen = addresses.carry_ip_map(headers, addresses.end_addresses(found)) if carry else headers
    return addresses.label_by_ip(found, seen, truth_map=headers)


def with_direction(flowlets: DataFrame, **hints) -> DataFrame:
    """Direction by rule, with its flag and two-state code."""
    out = flowlets.withColumn(
        "direction", flow_direction(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), **hints)
    )
    return out.withColumns({
        "outgoing": F.col("direction") == "client_to_server", "direction_encoded": direction_code(F.col("direction")),
    })


def flowlets_by_folder(
    spark: SparkSession, root: str, *, glob: str = "capture*.txt", gap: float = 0.1, bidirectional: bool = False,
    parts: bool = True, **hints,
) -> DataFrame:
    """Bursts of the class folders below ``root``, with direction."""
    lines = captures.read_lines(spark, root, glob=glob, recursive=True, parts=parts)
    direct = F.regexp_extract("source_file", r"^(.*)/[^/]+/[^/]+$", 1) == root.rstrip("/")
    chosen = captures.with_folder_class(lines.where(direct)).drop("traffic_class")
    found = flowlets_of(stage(captures.parse_packets(chosen).drop("raw"), "packets"), gap=gap, bidirectional=bidirectional)
    return with_direction(captures.with_folder_class(found), **hints)


def labelled_dataset(
    spark: SparkSession, root: str, *, glob: str = "*.txt", gap: float = 0.1, bidirectional: bool = False, parts: bool = True
) -> dict[str, DataFrame]:
    """captures, flows, flowlets and totals of every file below ``root``."""
    lines = captures.read_lines(spark, root, glob=glob, recursive=True, parts=parts)
    found = flowlets_of(stage(captures.parse_packets(lines).drop("raw"), "packets"), gap=gap, bidirectional=bidirectional)
    flowlets = captures.with_path_class(found, root)
    per_flow = flows.flow_summary(flowlets, key=["source_file", *KEY], first="first_at", keep=["traffic_class"])
    files = captures.with_path_class(lines.select("source_file").distinct(), root)
    counted = flows.capture_totals(per_flow)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("flows_count", "flowlets_count", "packets")}
    per_file = files.join(counted, "source_file", "left").withColumns(zero)
    return {"captures": per_file, "flows": per_flow, "flowlets": flowlets, "totals": flows.dataset_totals(per_file)}
