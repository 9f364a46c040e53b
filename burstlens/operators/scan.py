"""Ordered per-key scans that stay balanced when one key holds most rows.

``scan`` adds previous/next values, running sums and last-seen values.  While
every key is small it is one window per key: one exchange, one sort.  A key
with more than ``target_rows`` rows is cut along its order column into slices
of bounded size.  Windows then run per (key, slice), one edge row per slice is
carried over to the following slices, and the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens.session import hint_if_small, settle

TARGET_ROWS = 2_000_000
# Beyond target_rows times this many hot rows a slice grows with them: 10 ** 12 rows give slices of about 15 million.
MAX_SLICES = 65_536
SLICE = "_slice"
# Argument of operators that plan their own slices from the data.
AUTO = "auto"


@dataclass(frozen=True)
class Slicing:
    """Which keys are cut (``hot``; None = every row), along which column, and at which values of its image."""

    hot: DataFrame | None
    splits: list[float]
    by: str | None = None


def scalars(kind: T.DataType, path: str) -> list[tuple[str, T.DataType]]:
    """The plain values of an order column: itself, or the fields of a struct in their order."""
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in scalars(f.dataType, f"{path}.{f.name}")]
    return [(path, kind)]


def order_image(path: str, kind: T.DataType) -> Column:
    """A double that never falls as the column rises; nulls are lowest.

    Text counts by its first six bytes.  Other than plain values cannot be cut,
    which is an error whatever the size of the data.
    """
    c = F.col(path)
    if isinstance(kind, T.StringType):
        image = F.conv(F.rpad(F.substring(F.hex(c), 1, 12), 12, "0"), 16, 10).cast("double")
    elif isinstance(kind, T.DateType):
        image = F.unix_date(c).cast("double")
    elif isinstance(kind, T.TimestampNTZType):
        image = c.cast("timestamp").cast("double")
    elif isinstance(kind, (T.NumericType, T.TimestampType, T.BooleanType)):
        image = c.cast("double")
    else:
        raise TypeError(f"rows cannot be cut along {path}: {kind.simpleString()}")
    return F.coalesce(image, F.lit(-math.inf))


def _same(key: Sequence[str], prefix: str) -> Column:
    """Equality with the columns of that prefix; a null key equals a null key."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in key])


def plan_slices(
    df: DataFrame,
    key: Sequence[str],
    by: str | Sequence[str],
    *,
    target_rows: int = TARGET_ROWS,
    max_slices: int = MAX_SLICES,
) -> Slicing | None:
    """Find keys above ``target_rows`` and quantile cuts of the order over their rows.

    The counts are combined before the shuffle, and the busy keys stay a table,
    however many they are.  The cuts are quantiles of all hot rows together, so
    any (key, slice) pair holds at most about hot_rows / slices rows whatever
    the distribution of one key.  ``by`` is the order: its first column that is
    not constant over the hot rows is cut.
    """
    order = [x for c in ([by] if isinstance(by, str) else by) for x in scalars(df.schema[c].dataType, c)]
    images = [order_image(*x) for x in order]
    if key:
        counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
        total = counts.agg(F.sum("_n")).first()[0]
        if not total:
            return None
        hot = settle(counts).select(*key)
        named = hot.select(*[F.col(k).alias(f"_h_{k}") for k in key])
        rows = df.join(hint_if_small(named), _same(key, "_h_"), "left_semi")
    else:
        hot, rows, total = None, df, df.count()
        if total <= target_rows:
            return None
    n = min(max_slices, 2 * math.ceil(total / target_rows))
    at = 0
    if len(order) > 1:
        ends = rows.agg(*[f(c).alias(f"_{i}{k}") for i, c in enumerate(images) for k, f in (("a", F.min), ("z", F.max))]).first()
        at = next((i for i in range(len(order)) if ends[f"_{i}a"] != ends[f"_{i}z"]), 0)
    cuts = rows.agg(
        F.percentile_approx(images[at], [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("c")
    ).first()["c"]
    return Slicing(hot, sorted({c for c in cuts or [] if c > -math.inf}), order[at][0])


def assign_slices(df: DataFrame, key: Sequence[str], by: str | Sequence[str], slicing: Slicing | None) -> DataFrame:
    """Add the slice number: 0 for all rows of a key that is not cut."""
    if slicing is None or not slicing.splits:
        return df
    parts = [x for c in ([by] if isinstance(by, str) else by) for x in scalars(df.schema[c].dataType, c)]
    image = next(order_image(*x) for x in parts if slicing.by in (None, x[0]))
    inf = math.inf
    cutter = Bucketizer(
        splits=[-inf, *slicing.splits, inf], inputCol="_by", outputCol=SLICE, handleInvalid="keep"
    )
    out = cutter.transform(df.withColumn("_by", image))
    out = out.withColumn(SLICE, F.col(SLICE).cast("int")).drop("_by")
    if slicing.hot is None:
        return out
    named = slicing.hot.select(*[F.col(k).alias(f"_h_{k}") for k in key], F.lit(True).alias("_hot"))
    marked = out.join(hint_if_small(named), _same(key, "_h_"), "left").drop(*[f"_h_{k}" for k in key])
    return marked.withColumn(SLICE, F.when(F.col("_hot"), F.col(SLICE)).otherwise(F.lit(0)))


def sliced(
    df: DataFrame, key: Sequence[str], by: str | Sequence[str], slicing: Slicing | None | str = AUTO, *,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """``df`` with slice numbers: those it has, those of ``slicing``, or planned
    from the data with AUTO.  None says that no key is busy."""
    if SLICE in df.columns:
        return df
    if slicing == AUTO:
        slicing = plan_slices(df, key, by, target_rows=target_rows)
    return assign_slices(df, key, by, slicing)


def drop_slices(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, "_hot")


def scan(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add one column per entry; ``order`` must be a total order inside a key.

    ``lag``/``lead`` take the neighbour row's value, ``running`` the sum up to
    and including the row, ``carry`` the last non-null value up to the row.
    """
    key, order = list(key), list(order)
    lag, lead, running, carry = (dict(m or {}) for m in (lag, lead, running, carry))
    cut = SLICE in df.columns
    part = [*key, SLICE] if cut else key
    w = (Window.partitionBy(*part) if part else Window.partitionBy()).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    valued = df.select(
        "*", *[e.alias(f"_v_{n}") for m in (lag, lead, running, carry) for n, e in m.items()]
    )
    v = lambda n: F.col(f"_v_{n}")
    local = {n: F.lag(v(n)).over(w) for n in lag}
    local |= {n: F.lead(v(n)).over(w) for n in lead}
    local |= {n: F.sum(v(n)).over(upto) for n in running}
    local |= {n: F.last(v(n), ignorenulls=True).over(upto) for n in carry}
    if cut:
        local["_first"] = F.row_number().over(w) == 1
        local["_last"] = F.lead(F.lit(True)).over(w).isNull()
    keep = [c for c in valued.columns if not c.startswith("_v_") and c not in local]
    ends = [v(n).alias(f"_v_{n}") for n in (*lag, *lead)] if cut else []
    out = valued.select(*keep, *ends, *[c.alias(n) for n, c in local.items()])
    if not cut:
        return out

    # The first and last row of each slice tell all that goes over its edges; they come from the windowed rows.
    edges = out.where(F.col("_first") | F.col("_last"))
    edges = edges.where(F.col("_hot")) if "_hot" in df.columns else edges
    at_end = lambda c: F.first(F.when(F.col("_last"), c), ignorenulls=True)
    edges = edges.groupBy(*part).agg(
        *[at_end(v(n)).alias(n) for n in lag],
        *[F.first(F.when(F.col("_first"), v(n)), ignorenulls=True).alias(n) for n in lead],
        *[at_end(F.col(n)).alias(n) for n in (*running, *carry)],
    )
    over = (Window.partitionBy(*key) if key else Window.partitionBy()).orderBy(SLICE)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in part],
        *[F.lag(n).over(over).alias(f"_e_{n}") for n in lag],
        *[F.lead(n).over(over).alias(f"_e_{n}") for n in lead],
        *[F.sum(n).over(before).alias(f"_e_{n}") for n in running],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_e_{n}") for n in carry],
    )
    e = lambda n: F.col(f"_e_{n}")
    fixed = {n: F.when(F.col("_first"), e(n)).otherwise(F.col(n)) for n in lag}
    fixed |= {n: F.when(F.col("_last"), e(n)).otherwise(F.col(n)) for n in lead}
    fixed |= {n: F.when(e(n).isNull(), F.col(n)).otherwise(F.coalesce(n, F.lit(0)) + e(n)) for n in running}
    fixed |= {n: F.coalesce(F.col(n), e(n)) for n in carry}
    joined = out.join(edges, _same(part, "_k_"), "left")
    return joined.select(*keep, *[c.alias(n) for n, c in fixed.items()])


def sliced_scan(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    target_rows: int = TARGET_ROWS,
    **what: Mapping[str, Column],
) -> DataFrame:
    """``scan`` with the slicing planned from the data and dropped afterwards."""
    return drop_slices(scan(sliced(df, key, order, target_rows=target_rows), key, order, **what))
