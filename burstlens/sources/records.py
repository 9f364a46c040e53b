"""Decoded packet records: tab-separated fields, one line per packet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.functions import payload
from burstlens.schemas import RECORD_8, RECORD_13, RECORD_20


def split_fields(lines: DataFrame, names: Sequence[str], *, value: str = "value", least: int = 0) -> DataFrame:
    """Name the tab-separated fields; short rows are padded with ''.

    Rows with fewer than ``least`` fields are dropped.  Other columns stay.
    """
    parts = F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), "\t")
    rest = [c for c in lines.columns if c != value]
    cut = lines.select(*rest, parts.alias("_p"))
    cut = cut.where(F.size("_p") >= least) if least else cut
    return cut.select(*rest, *[F.coalesce(F.get("_p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def records_20(lines: DataFrame, **kw) -> DataFrame:
    return split_fields(lines, RECORD_20, **kw)


def records_13(lines: DataFrame, **kw) -> DataFrame:
    """Adds ``payload``: the first non-empty of the two payload fields."""
    out = split_fields(lines, RECORD_13, **kw)
    return out.withColumn("payload", payload.first_payload(F.col("http2_data"), F.col("file_data")))


def records_8(lines: DataFrame, **kw) -> DataFrame:
    """Rows with six fields or more; of two payload fields the second wins."""
    out = split_fields(lines, RECORD_8, least=6, **kw)
    return out.withColumn("payload", payload.first_payload(F.col("file_data"), F.col("http2_data")))


def of_protocols(protocol: Column, names: Sequence[str] = ("tcp", "http", "http2")) -> Column:
    return F.lower(protocol).isin(*names)


def decoded_payloads(records: DataFrame, *, payload_column: str = "payload", threshold: float = 0.90) -> DataFrame:
    """Rows whose payload is strict UTF-8 and readable, with ``text``."""
    # A filter inside the generator: the payload is decoded once per row, where
    # a filter on the column would be pushed down and decode it again.
    text = F.array(payload.hex_text(F.col(payload_column)))
    out = records.select("*", F.explode(F.filter(text, lambda t: payload.is_readable(t, threshold))).alias("text"))
    return out.withColumn("structured", payload.looks_structured(F.col("text")))
