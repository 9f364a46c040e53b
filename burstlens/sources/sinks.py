"""Writers of the tables, reports and text captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.functions import render
from burstlens.operators.scan import TARGET_ROWS, sliced_scan
from burstlens.schemas import RECORD_20


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One JSON object per line, so that readers can split the files."""
    df.write.mode(mode).json(path)


def write_dataset(path: str, *, captures: DataFrame, flows: DataFrame, flowlets: DataFrame, totals: DataFrame) -> None:
    """The labelled dataset: three tables and one row of totals."""
    for name, table in (("captures", captures), ("flows", flows), ("flowlets", flowlets), ("totals", totals)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def with_row_ids(
    flowlets: DataFrame, *, capture: str = "capture_id", order: Sequence[str], target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add a stable ``id``: capture number times 2^32 plus a running count."""
    out = sliced_scan(flowlets, [capture], list(order), target_rows=target_rows,
                      running={"_n": F.lit(1).cast("long")})
    return out.withColumn("id", F.shiftleft(F.col(capture).cast("long"), 32) + F.col("_n")).drop("_n")


def write_flowlet_table(flowlets: DataFrame, path: str, *, capture: str = "capture_id", mode: str = "append") -> None:
    """Partitioned burst table.

    The rebalance hint gathers a capture's rows into few files and splits a
    capture that holds most rows over several tasks.
    """
    flowlets.hint("rebalance", F.col(capture)).write.mode(mode).partitionBy(capture).parquet(path)


def replace_captures(flowlets: DataFrame, path: str, *, capture: str = "capture_id") -> None:
    """Rewrite only the partitions of the captures present in ``flowlets``."""
    writer = flowlets.hint("rebalance", F.col(capture)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(capture).parquet(path)


def append_table(rows: DataFrame, path: str) -> None:
    """Append to the capture registry, the status log or the prompt bank table."""
    rows.write.mode("append").parquet(path)


def append_bank(chains: DataFrame, path: str) -> None:
    """Add chains to the stored bank."""
    chains.write.mode("append").json(path)


def record_lines(records: DataFrame, *, capture: str, order: Sequence[str]) -> DataFrame:
    """The text of each decoded record: capture, order columns, value (two lines)."""
    fields = {n: F.col(n) for n in RECORD_20}
    return records.select(capture, *order, render.packet_lines(fields).alias("value"))


def header_lines(ip_map: DataFrame, captures: DataFrame, *, capture: str) -> DataFrame:
    """Header lines of each capture: its address lines and a blank line, or a
    comment and a blank line.

    ``ip_map`` has capture, ip, name.  ``ord`` places the address lines at -2
    and the closing line at -1.
    """
    line = F.format_string("LLM_IP %s %s", F.col("name"), F.col("ip"))
    heads = ip_map.select(capture, F.lit(-2).cast("long").alias("ord"), line.alias("value"))
    named = ip_map.select(capture).distinct().withColumn("_some", F.lit(True))
    closing = F.when(F.col("_some"), "").otherwise("# No LLM traffic detected.\n")
    ends = captures.select(capture).distinct().join(named, capture, "left")
    return heads.unionByName(ends.select(capture, F.lit(-1).cast("long").alias("ord"), closing.alias("value")))


def capture_text(records: DataFrame, headers: DataFrame, *, capture: str, order: str) -> DataFrame:
    """Header and packet text with a common order number (header first)."""
    body = records.select(capture, F.col(order).cast("long").alias("ord"), "value")
    return headers.select(capture, "ord", "value").unionByName(body)


def write_captures(text: DataFrame, path: str, *, capture: str = "capture", mode: str = "overwrite") -> None:
    """One folder per capture with its lines in order.

    Rows are range-partitioned by (capture, order): a capture that holds most
    rows becomes several consecutive part files, each sorted, and the part
    names sort in capture order.  A row holds both lines of its packet, so no
    packet is cut.
    """
    ordered = text.repartitionByRange(capture, "ord").sortWithinPartitions(capture, "ord", "value")
    ordered.select(capture, "value").write.mode(mode).partitionBy(capture).text(path)


def report_json(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: every small result table as a JSON list under its name."""
    cells = [F.to_json(F.struct("*")).alias("j") for _ in tables]
    parts = []
    for (name, table), cell in zip(tables.items(), cells):
        parts.append(table.select(cell).agg(
            F.concat(F.lit(f'"{name}": ['), F.array_join(F.sort_array(F.collect_list("j")), ", "), F.lit("]")).alias("p")
        ))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("p")), ", "), F.lit("}")).alias("value"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """The result tables of a report as one JSON document; for tables of a few rows, one per feature or class."""
    report_json(tables).coalesce(1).write.mode("overwrite").text(path)


def as_text(column: Column) -> Column:
    """Array or map as JSON text; null as the empty list."""
    return F.coalesce(F.to_json(column), F.lit("[]"))


def from_text(column: Column, schema: str) -> Column:
    """JSON text back to an array; null as the empty array."""
    return F.coalesce(F.from_json(column, schema), F.array().cast(schema))
