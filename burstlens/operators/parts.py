"""Long lists kept in parts: rows that continue a list carry nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where a part goes on: the packet before its first one, and whether packets follow its last.
CONTINUES = ("prev_size", "prev_gap", "more")


def continued(df: DataFrame, *, keep: Sequence[str], part: str = "part") -> DataFrame:
    """``df`` with every column but ``keep`` null in rows of a part above 0.

    So a total stands once per list, however many parts the list has.
    """
    first = F.coalesce(F.col(part), F.lit(0)) == 0
    return df.select(*[F.col(c) if c in (*keep, part) else F.when(first, F.col(c)).alias(c) for c in df.columns])
