"""Feature vectors and the split by flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.functions import labels
from burstlens.operators.bursts import STATISTICS
from burstlens.operators.scan import TARGET_ROWS, sliced_scan

LIKELIHOODS = ("ll_time_llm", "ll_size_llm", "ll_time_non_llm", "ll_size_non_llm")


def feature_names(*, with_direction: bool = True, likelihoods: bool = True) -> list[str]:
    """12 names with direction, 11 without it, 7 statistics alone."""
    extra = (["direction_encoded"] if with_direction else []) + (list(LIKELIHOODS) if likelihoods else [])
    return list(STATISTICS) + extra


def feature_columns(names: Sequence[str]) -> list[Column]:
    """Features as doubles: a missing likelihood is the lower bound, else 0."""
    out = []
    for n in names:
        c = F.col(n).cast("double")
        if n.startswith("ll_"):
            out.append(labels.clip_likelihood(F.coalesce(c, F.lit(-100.0))).alias(n))
        else:
            out.append(F.coalesce(c, F.lit(0.0)).alias(n))
    return out


def assemble(df: DataFrame, names: Sequence[str], *, keep: Sequence[str], output: str = "features") -> DataFrame:
    ready = df.select(*keep, *feature_columns(names))
    return VectorAssembler(inputCols=list(names), outputCol=output).transform(ready)


def group_split(
    df: DataFrame, *, group: str, test: float = 0.2, seed: int = 42, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add ``is_test``: whole groups, ``ceil(test * groups)`` of them.

    Groups are ordered by a hash of seed and name; the numbering runs over
    slices of the hash, so the list of groups never sits in one task.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(group)))
    groups = df.select(group).distinct().withColumn(
        "_h", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    )
    ranked = sliced_scan(groups, [], ["_h", group], target_rows=target_rows, running={"_n": F.lit(1).cast("long")})
    total = groups.agg(F.count(F.lit(1))).scalar()
    marked = ranked.select(group, (F.col("_n") <= F.ceil(total * F.lit(test))).alias("is_test"))
    return df.join(marked, group)




def provider_rows(source_file: Column, traffic_class: Column, provider: str) -> Column:
    """Rows of the provider's captures, and all non_llm rows."""
    from_provider = F.lower(source_file).contains(provider.lower())
    return F.coalesce(from_provider, F.lit(False)) | F.coalesce(traffic_class == "non_llm", F.lit(False))
