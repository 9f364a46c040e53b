"""Correlation, class statistics and the rank test, without sorting a column whole."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate, combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.operators.scan import TARGET_ROWS, assign_slices, drop_slices, plan_slices, scan
from burstlens.session import stage


def correlate(df: DataFrame, features: Sequence[str], *, target: str) -> DataFrame:
    """Pearson matrix of the features and the target in long form.

    All pairs are moments of one aggregation; the result has a row per ordered
    pair (feature_a, feature_b, correlation).
    """
    names = [*features, target]
    one = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    pairs = list(combinations_with_replacement(names, 2))
    row = one.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            entries.append(F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"),
                                    F.col(f"c{i}").alias("correlation")))
    return row.select(F.inline(F.array(*entries)))


def unpivot(df: DataFrame, features: Sequence[str], *, keep: Sequence[str]) -> DataFrame:
    wide = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(list(keep), list(features), "feature", "value")


def value_counts(df: DataFrame, features: Sequence[str], *, label: str) -> DataFrame:
    """Distinct values of each feature with their count per class (1 and 0)."""
    long = unpivot(df, features, keep=[label])
    one = F.sum((F.col(label) == 1).cast("long"))
    zero = F.sum((F.col(label) == 0).cast("long"))
    return long.groupBy("feature", "value").agg(one.alias("n1"), zero.alias("n0"))


def ranked_counts(counts: DataFrame, *, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Running counts of both classes over the values of each feature."""
    slicing = plan_slices(counts, ["feature"], "value", target_rows=target_rows)
    cut = assign_slices(counts, ["feature"], "value", slicing)
    return drop_slices(scan(cut, ["feature"], ["value"], running={"c1": F.col("n1"), "c0": F.col("n0")}))


# The exact distribution is used without ties when the smaller class has at most SMALL rows, the other at most OTHER.
SMALL, OTHER = 8, 20_000


def u_distribution(n1: int, n0: int) -> list[int]:
    """In how many orders of the two classes each U comes up: the coefficients of a Gaussian binomial, one factor at a time."""
    small, large = sorted((n1, n0))
    ways = [1] + [0] * (small * large)
    for i in range(1, small + 1):
        for k in range(len(ways) - 1, large + i - 1, -1):  # times 1 - q^(large + i)
            ways[k] -= ways[k - large - i]
        for k in range(i, len(ways)):  # over 1 - q^i
            ways[k] += ways[k - i]
    return ways


def exact_two_sided(u: Column, n1: Column, n0: Column) -> Column:
    """Two-sided p of U from the distribution over all orders; each pair of sizes is worked out once a task."""

    @F.pandas_udf("double")
    def tail(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        seen: dict[tuple[int, int], list[float]] = {}
        out = []
        for x, a, b in zip(u, n1, n0):
            if not (min(a, b) > 0):
                out.append(math.nan)
                continue
            a, b = int(a), int(b)
            if (a, b) not in seen:
                ways = u_distribution(a, b)
                upper, total = list(accumulate(reversed(ways))), math.comb(a + b, a)
                seen[a, b] = [w / total for w in upper]  # chance of U >= ab - k
            out.append(min(1.0, 2 * seen[a, b][a * b - round(max(x, a * b - x))]))
        return pd.Series(out, dtype="float64")

    return tail(u, n1, n0)


def p_value(u: Column, n1: Column, n0: Column, ties: Column, exact: bool) -> Column:
    """Two-sided p of the rank test: the normal approximation with continuity and tie correction, or exact where samples are small."""
    n = n1 + n0
    sigma = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.try_divide(ties, n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5, sigma)
    if not exact:
        return two_sided(z)
    few = (ties == 0) & (F.least(n1, n0) <= SMALL) & (F.greatest(n1, n0) <= OTHER)
    at = [F.when(few, c) for c in (u, n1, n0)]
    return F.when(few, exact_two_sided(*at)).otherwise(two_sided(z))


def rank_tests(
    df: DataFrame, by: Sequence[str], *, value: str, label: str, order: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Per group: n1, n0, U of class 1 and two-sided p of ``value``, for groups with both classes.

    Ranks come from the counts per distinct value of each group, running in the order of values. ``order`` ranks equal
    values by further columns; without it they share their middle rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value"), *order).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("n1"), F.sum((F.col(label) == 0).cast("long")).alias("n0"))
    slicing = plan_slices(counts, by, "value")
    cut = assign_slices(counts, by, "value", slicing)
    ranked = drop_slices(scan(cut, by, ["value", *order], running={"c": F.col("n1") + F.col("n0")}))
    ties = (F.col("n1") + F.col("n0")).cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(F.col("n1") * (F.col("c") - ties + (ties + 1) / 2)).alias("_ranks"), F.sum(ties * ties * ties - ties).alias("_ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    tested = sums.where("n1 > 0 and n0 > 0").withColumn("u", F.col("_ranks") - n1 * (n1 + 1) / 2)
    return tested.select(*by, "n1", "n0", "u", p_value(F.col("u"), n1, n0, F.col("_ties"), exact).alias("p_value"))


def class_stats(
    df: DataFrame, features: Sequence[str], *, label: str, target_rows: int = TARGET_ROWS, exact: bool = True
) -> DataFrame:
    """Per feature: mean, population deviation and exact median of both
    classes, Cohen's d, Mann-Whitney U of class 1, two-sided p (``p_value``).

    Medians and ranks come from the counts per distinct value, so the input is
    combined before any shuffle and never sorted.
    """
    long = unpivot(df, features, keep=[label])
    of = lambda c: F.when(F.col(label) == c, F.col("value"))
    moments = long.groupBy("feature").agg(
        *[a(of(c)).alias(f"{n}{c}") for c in (1, 0) for n, a in
          (("mean", F.avg), ("std", F.stddev_pop), ("size", F.count))]
    )
    # A handful of rows by construction: one per feature.
    # The counts are read several times: to plan slices, to rank, and for edges.
    ranked = ranked_counts(stage(value_counts(df, features, label=label), "counts"), target_rows=target_rows)
    ranked = ranked.join(F.broadcast(moments.select("feature", "size1", "size0")), "feature")

    def at(c: int, position: Column) -> Column:
        return F.min(F.when(F.col(f"c{c}") >= position, F.col("value")))

    def median(c: int) -> Column:
        n = F.col(f"size{c}")
        return (at(c, F.floor((n + 1) / 2)) + at(c, F.floor((n + 2) / 2))) / 2

    ties = (F.col("n1") + F.col("n0")).cast("double")
    below = (F.col("c1") + F.col("c0")).cast("double") - ties
    tests = ranked.groupBy("feature").agg(
        median(1).alias("median1"), median(0).alias("median0"),
        F.sum(F.col("n1") * (below + (ties + 1) / 2)).alias("_ranks"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
    )
    n1, n0 = F.col("size1").cast("double"), F.col("size0").cast("double")
    u = F.col("_ranks") - n1 * (n1 + 1) / 2
    pooled = F.sqrt((F.col("std1") * F.col("std1") + F.col("std0") * F.col("std0")) / 2)
    d = F.when(pooled > 0, (F.col("mean1") - F.col("mean0")) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)
    return moments.join(tests, "feature").select(
        "feature",
        F.col("mean1").alias("llm_mean"), F.col("std1").alias("llm_std"), F.col("median1").alias("llm_median"),
        F.col("mean0").alias("non_llm_mean"), F.col("std0").alias("non_llm_std"),
        F.col("median0").alias("non_llm_median"),
        u.alias("mann_whitney_u"), p_value(u, n1, n0, F.col("_ties"), exact).alias("p_value"), d.alias("cohens_d"),
    )


# Coefficients of a rational approximation of the complementary error function (relative error below 1.2e-7): fixed values.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided(z: Column) -> Column:
    """Two-sided normal p value of ``z``; 1 at and below 0, as z is the larger of both sides."""
    x = z / math.sqrt(2)
    t = 1 / (1 + x / 2)
    tail = F.lit(_ERFC[-1])
    for c in _ERFC[-2::-1]:
        tail = F.lit(c) + t * tail
    return F.when(z.isNull() | F.isnan(z), F.lit(math.nan)).when(z <= 0, 1.0).otherwise(F.least(t * F.exp(tail - x * x), F.lit(1.0)))


def significant(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    return stats.where(F.col("p_value") < alpha)


def rank_features(df: DataFrame, *, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Features by descending score (a handful of rows)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc(score), "feature")
    return df.withColumn("rank", F.row_number().over(w))
