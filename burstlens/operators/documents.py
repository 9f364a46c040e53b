"""Capture documents: numbered burst fields per capture, overwrite and append."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.functions import render
from burstlens.operators.scan import TARGET_ROWS, sliced_scan
from burstlens.session import broadcast_if_small


def default_transform(flowlets: DataFrame, *, root: str | None = None) -> DataFrame:
    """Drop class and sequences, add the three prediction fields, shorten the path."""
    cls = F.coalesce(F.col("traffic_class") == "llm", F.lit(False)) if "traffic_class" in flowlets.columns else F.lit(False)
    named = lambda c: F.col(c) if c in flowlets.columns else F.lit(None).cast("string")
    out = flowlets.withColumns({
        "is_llm_prediction": cls,
        "predicted_llm_name": named("llm_name"),
        "ground_truth_llm_name": named("ground_truth_llm"),
    })
    if root is not None and "source_file" in flowlets.columns:
        out = out.withColumn("source_file", render.relative_path(F.col("source_file"), root))
    return out.drop("traffic_class", "inter_packet_times", "packet_sizes")


def document_rows(
    flowlets: DataFrame,
    *,
    capture: str,
    order: Sequence[str],
    transform: Callable[[DataFrame], DataFrame] = default_transform,
    existing: DataFrame | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Fields of the documents: capture, ``field`` (flowlet_000001...), ``value``.

    ``existing`` (capture, field) makes this an append: numbering goes on after
    the highest number of the capture.  Numbers are running counts that stay
    balanced when one capture holds most bursts.
    """
    numbered = sliced_scan(
        flowlets, [capture], list(order), target_rows=target_rows, running={"_n": F.lit(1).cast("long")}
    )
    if existing is not None:
        top = next_index(existing, capture=capture).select(capture, (F.col("next_index") - 1).alias("_top"))
        numbered = numbered.join(broadcast_if_small(top), capture, "left")
        numbered = numbered.withColumn("_n", F.col("_n") + F.coalesce("_top", F.lit(0))).drop("_top")
    shaped = numbered.transform(transform)
    body = [c for c in shaped.columns if c not in (capture, "_n")]
    return shaped.select(capture, render.document_key(F.col("_n")).alias("field"), F.struct(*body).alias("value"))


def next_index(existing: DataFrame, *, capture: str, field: str = "field") -> DataFrame:
    """Highest document number + 1 per capture; other field names are ignored."""
    top = F.max(render.document_index(F.col(field)))
    return existing.groupBy(capture).agg((F.coalesce(top, F.lit(0)) + 1).alias("next_index"))


def merge_metadata(old: DataFrame, new: DataFrame, *, capture: str) -> DataFrame:
    """Metadata of an append: existing values stay, missing ones are added."""
    names = [c for c in new.columns if c != capture]
    both = new.join(old.select(capture, *[F.col(c).alias(f"_{c}") for c in names if c in old.columns]), capture, "full")
    pick = [F.coalesce(f"_{c}", c).alias(c) if c in old.columns else F.col(c) for c in names]
    return both.select(capture, *pick)


def pack_documents(rows: DataFrame, *, capture: str, max_fields: int = 1_000) -> DataFrame:
    """Map form of the documents, in pieces of ``max_fields`` fields.

    ``piece`` 0 is the whole document of a capture with few bursts; a large
    capture continues in further pieces instead of one unbounded map.
    """
    piece = F.floor((render.document_index(F.col("field")) - 1) / max_fields).cast("int").alias("piece")
    entries = F.sort_array(F.collect_list(F.struct("field", "value")))
    return rows.groupBy(capture, piece).agg(F.map_from_entries(entries).alias("document"))


def unpack_documents(documents: DataFrame, *, capture: str) -> DataFrame:
    """Flowlet fields of the documents (key prefix ``flowlet_``, value present)."""
    rows = documents.select(capture, F.explode("document").alias("field", "value"))
    return rows.where(F.col("field").startswith("flowlet_") & F.col("value").isNotNull())


def capture_document(documents: DataFrame, capture_id, *, capture: str) -> DataFrame:
    return documents.where(F.col(capture) == F.lit(capture_id))


def list_flowlets(documents: DataFrame, capture_id, *, capture: str) -> DataFrame:
    """Fields of one capture in key order."""
    return unpack_documents(capture_document(documents, capture_id, capture=capture), capture=capture).orderBy("field")
