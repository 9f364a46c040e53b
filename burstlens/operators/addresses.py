"""Address maps: labelling, ground truth, carry-over between files, detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlens.functions import addresses, payload
from burstlens.operators.scan import TARGET_ROWS, sliced_scan
from burstlens.session import BROADCAST_ROWS, broadcast_if_small
from burstlens.sources.captures import file_ranks


def _lookup(df: DataFrame, table: DataFrame, ip: str, on: Sequence[str], hit: str) -> DataFrame:
    side = table.select(*on, F.col("ip").alias(ip), F.col("name").alias(hit))
    return df.join(side, [*on, ip], "left")


def label_by_ip(
    flowlets: DataFrame,
    ip_map: DataFrame,
    *,
    truth_map: DataFrame | None = None,
    file: str = "source_file",
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Name, class and direction of each burst by its two addresses.

    The source address is tried before the destination.  ``ip_map`` has ip,
    name and optionally the file column (a map per file); ``truth_map`` has
    file, ip, name and only counts for bursts of the same file.  A map with
    more than ``max_broadcast_rows`` rows is joined by shuffle.
    """
    per_file = [file] if file in ip_map.columns else []
    known = broadcast_if_small(ip_map.where(F.col("ip") != ""), max_broadcast_rows)
    out = _lookup(flowlets, known, "src_ip", per_file, "_src")
    out = _lookup(out, known, "dst_ip", per_file, "_dst")
    name = F.coalesce(F.nullif(F.col("_src"), F.lit("")), F.nullif(F.col("_dst"), F.lit("")))
    to_llm = F.col("_dst").isNotNull()
    out = out.withColumns({
        "llm_name": name,
        "traffic_class": F.when(name.isNotNull(), "llm").otherwise("non_llm"),
        "outgoing": F.when(name.isNotNull(), to_llm),
        "direction_encoded": F.when(name.isNull(), 0).when(to_llm, 1).otherwise(-1),
    }).drop("_src", "_dst")
    if truth_map is None:
        return out.withColumn("ground_truth_llm", F.lit(None).cast("string"))
    truth = broadcast_if_small(truth_map.where(F.col("ip") != ""), max_broadcast_rows)
    out = _lookup(out, truth, "src_ip", [file], "_ts")
    out = _lookup(out, truth, "dst_ip", [file], "_td")
    return out.withColumn("ground_truth_llm", F.coalesce("_ts", "_td")).drop("_ts", "_td")


def carry_ip_map(
    headers: DataFrame, wanted: DataFrame, *, file: str = "source_file", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """The map each file sees: headers of it and all earlier files, later win.

    ``wanted`` holds the (file, ip) pairs that occur.  Per ip the last header
    name is carried along the files in sorted path order; an ip that occurs in
    very many files is cut into slices of the file rank.
    """
    asked = wanted.select(file, "ip").where(F.col("ip") != "").distinct()
    rows = headers.select(file, "ip", "name", F.lit(0).alias("_kind")).unionByName(
        asked.select(file, "ip", F.lit(None).cast("string").alias("name"), F.lit(1).alias("_kind"))
    )
    ranked = rows.join(file_ranks(rows, file=file), file)
    seen = sliced_scan(
        ranked, ["ip"], ["file_rank", "_kind"], target_rows=target_rows, carry={"_seen": F.col("name")}
    )
    found = seen.where((F.col("_kind") == 1) & F.col("_seen").isNotNull())
    return found.select(file, "ip", F.col("_seen").alias("name"))


def end_addresses(flowlets: DataFrame, *, file: str = "source_file") -> DataFrame:
    """Distinct (file, ip) pairs of both ends."""
    both = F.explode(F.array("src_ip", "dst_ip")).alias("ip")
    return flowlets.select(file, both).where(F.col("ip") != "").distinct()


def ip_map_intervals(
    headers: DataFrame, ranks: DataFrame, *, file: str = "source_file", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """ip, name, from_rank, to_rank: the files for which a header name of an address holds.

    One row per header entry, however many files follow; ``to_rank`` is null
    where no later header names the address.  ``map_of_capture`` gives the
    whole map of one file.
    """
    placed = headers.join(ranks, file).select("ip", "name", "file_rank")
    seen = sliced_scan(placed, ["ip"], ["file_rank"], target_rows=target_rows, lead={"_next": F.col("file_rank")})
    return seen.select("ip", "name", F.col("file_rank").alias("from_rank"), (F.col("_next") - 1).alias("to_rank"))


def map_of_capture(intervals: DataFrame, rank: int) -> DataFrame:
    """The accumulated map (ip, name) of the file with that rank."""
    return intervals.where((F.col("from_rank") <= rank) & (F.col("to_rank").isNull() | (F.col("to_rank") >= rank))).select("ip", "name")


def capture_ip_maps(headers: DataFrame, ranks: DataFrame, *, file: str = "source_file") -> DataFrame:
    """Whole accumulated map per capture file as a map column.

    A header name holds from its file up to the file before the next header of
    the same ip, so the rows are spelled out by ``sequence`` instead of a range
    join; the result is exactly the stored maps.  Its size is files times
    addresses: for many files keep ``ip_map_intervals`` instead.
    """
    total = ranks.agg(F.max("file_rank")).scalar()
    placed = headers.join(ranks, file).select("ip", "name", "file_rank")
    until = F.lead("file_rank").over(Window.partitionBy("ip").orderBy("file_rank"))
    spans = placed.withColumn("_next", until)
    last = F.coalesce(F.col("_next") - 1, total)
    each = spans.select("ip", "name", F.explode(F.sequence("file_rank", last)).alias("file_rank"))
    maps = each.groupBy("file_rank").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ip", "name")))).alias("llm_ip_map")
    )
    empty = F.create_map().cast("map<string,string>")
    return ranks.join(maps, "file_rank", "left").select(
        file, "file_rank", F.coalesce("llm_ip_map", empty).alias("llm_ip_map")
    )


def detect(records: DataFrame, *, fields: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Add ``detected``: the first keyword found in the name fields."""
    return records.withColumn("detected", payload.detected_name([F.col(f) for f in fields], keywords))


def first_writer_map(
    records: DataFrame, *, order: Sequence[str], src: str = "src", dst: str = "dst", name: str = "detected"
) -> DataFrame:
    """Public address -> name of the first record that named it (destination
    before source).  A combinable minimum per address."""
    hits = records.where(F.col(name).isNotNull())
    ends = F.array(
        F.struct(F.col(dst).alias("ip"), F.lit(0).alias("pos")), F.struct(F.col(src).alias("ip"), F.lit(1).alias("pos"))
    )
    rows = hits.select(*order, F.col(name).alias("name"), F.inline(ends))
    public = (F.col("ip") != "") & ~addresses.is_private_ip(F.col("ip"))
    return rows.where(public).groupBy("ip").agg(F.min_by("name", F.struct(*order, "pos")).alias("name"))


def target_streams(records: DataFrame, *, stream: str, order: str, hit: Column) -> DataFrame:
    """Records of a target stream from its first hit on, with ``is_first_hit``.

    The first hit of each stream is a combinable minimum; the join back is left
    to the adaptive planner, which splits a stream that holds most records.
    """
    flagged = records.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    named = flagged.where(F.col(stream).isNotNull() & (F.col(stream).cast("string") != ""))
    first = named.where("_hit").groupBy(stream).agg(F.min(order).alias("_first"))
    joined = named.join(first, stream).where(F.col(order) >= F.col("_first"))
    return joined.withColumn("is_first_hit", F.col(order) == F.col("_first")).drop("_hit", "_first")
