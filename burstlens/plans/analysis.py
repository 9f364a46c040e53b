"""Feature analysis of one provider against other traffic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.operators import evaluate, features, models, stats
from burstlens.session import settle


def correlation_ranking(matrix: DataFrame, *, target: str) -> DataFrame:
    """Features by absolute correlation with the target."""
    rows = matrix.where((F.col("feature_b") == target) & (F.col("feature_a") != target))
    return stats.rank_features(
        rows.select(F.col("feature_a").alias("feature"), F.abs("correlation").alias("score")), score="score"
    )


def analyse(
    flowlets: DataFrame, *, names: Sequence[str], label: str, group: str, estimators: Mapping[str, Estimator],
    alpha: float = 0.05,
) -> dict[str, DataFrame]:
    """All result tables of the report: counts, correlation, tests, rankings."""
    spark = flowlets.sparkSession
    # Tables of a few rows that stand in the report twice.
    matrix = settle(stats.correlate(flowlets, names, target=label))
    tests = settle(stats.class_stats(flowlets, names, label=label))
    split = features.group_split(flowlets, group=group)
    vectors = features.assemble(split.where(~F.col("is_test")), list(names), keep=[label])
    fitted = models.train(vectors, estimators)
    ranks = models.importance(fitted, names, spark)
    return {
        "dataset_info": evaluate.class_distribution(flowlets, label=label),
        "correlation": matrix,
        "statistical_tests": tests.withColumn("significant", F.col("p_value") < alpha),
        "significant_features": stats.significant(tests, alpha).select("feature"),
        "most_correlated": correlation_ranking(matrix, target=label),
        "most_important": stats.rank_features(ranks, score="importance", by=["model"]),
    }
