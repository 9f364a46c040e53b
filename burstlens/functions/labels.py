"""Column expressions for classes, buckets and predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class of a capture by the name of its folder.
FOLDER_CLASS = {
    "chatgpt_ipv4": "llm",
    "chatgpt_ipv6": "llm",
    "claude_ipv4": "llm",
    "claude_ipv6": "llm",
    "gemini_ipv4": "llm",
    "gemini_ipv6": "llm",
    "all_v6": "non_llm",
    "all_v4": "non_llm",
}
# Upper bounds in milliseconds and names of the gap states.
GAP_STATES = ((10, "GAP_0_10ms"), (100, "GAP_10_100ms"), (1000, "GAP_100ms_1s"))
GAP_LONGEST = "GAP_GT_1s"
CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}


def folder_class(folder: Column, table: Mapping[str, str] = FOLDER_CLASS) -> Column:
    """Class of a folder name; null for a folder that is not in the table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), folder)


def path_class(relative_path: Column) -> Column:
    """non_llm when any part of the path begins with 'all', else llm."""
    hit = F.exists(F.split(relative_path, "/"), lambda p: F.lower(p).startswith("all"))
    return F.when(hit, "non_llm").otherwise("llm")


def gap_state(gap_seconds: Column) -> Column:
    ms = gap_seconds * 1000
    out = F.when(ms < GAP_STATES[0][0], GAP_STATES[0][1])
    for bound, name in GAP_STATES[1:]:
        out = out.when(ms < bound, name)
    return F.when(gap_seconds.isNotNull(), out.otherwise(GAP_LONGEST))


def block_label(value: Column) -> Column:
    return F.format_string("BLOCK_%.2f", value.cast("double"))


def confidence_number(word: Column) -> Column:
    known = [F.when(word == w, F.lit(n)) for w, n in CONFIDENCE.items()]
    return F.coalesce(*known, F.lit(CONFIDENCE["low"]))


def predicted_name(label: Column, provider: str = "ChatGPT") -> Column:
    """1 is the provider's name, 0 is non_llm, anything else unknown."""
    return F.when(label == 1, provider).when(label == 0, "non_llm").otherwise("unknown")


def is_llm_row(traffic_class: Column, prediction: Column) -> Column:
    """Class llm, or a prediction that is set, not empty and not non_llm."""
    by_class = F.coalesce(traffic_class == "llm", F.lit(False))
    return by_class | F.coalesce((prediction != "") & (prediction != "non_llm"), F.lit(False))


def prediction_matches(truth: Column, prediction: Column) -> Column:
    """Equal without regard to case; null when either side is missing."""
    t, p = F.nullif(truth, F.lit("")), F.nullif(prediction, F.lit(""))
    return F.lower(t) == F.lower(p)


def clip_likelihood(value: Column, low: float = -100.0, high: float = 0.0) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def group_id(*fields: Column) -> Column:
    """Key fields joined by '_'; a missing field is empty."""
    return F.concat_ws("_", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
