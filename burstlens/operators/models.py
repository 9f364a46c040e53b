"""Classifiers over burst features: training, scoring, importance, storage."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ("models", "lookup", "blocks")


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose inner product approximates the RBF kernel."""

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "input dimension", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    def __init__(self, **kw):
        super().__init__()
        self._setDefault(size=128, seed=42, inputCol="scaled", outputCol="fourier")
        self._set(**kw)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma = self.getOrDefault(self.size), self.getOrDefault(self.gamma)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        w = rng.normal(0.0, np.sqrt(2 * gamma), (self.getOrDefault(self.width), size))
        b = rng.uniform(0.0, 2 * np.pi, size)
        width = self.getOrDefault(self.width)

        # One flat buffer in, one out: no object per row.
        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def cosines(x: pa.Array) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            values = np.sqrt(2.0 / size) * np.cos(rows @ w + b)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(values.ravel()))

        values = cosines(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(values))


def estimators(
    width: int, *, label: str = "label", features: str = "features", trees: int = 100, rounds: int = 100, seed: int = 42,
    max_depth: int = 12, kernel_size: int = 128,
) -> dict[str, Estimator]:
    """Forest, kernel classifier with probability, boosted trees.

    ``max_depth`` bounds the trees of the forest (at most 30), ``kernel_size`` is
    the number of Fourier features of the kernel classifier.

    The kernel classifier is logistic regression over Fourier features of the
    standardised vector, which trains in linear passes over the data.
    """
    common = {"labelCol": label, "featuresCol": features, "seed": seed}
    kernel = Pipeline(stages=[
        StandardScaler(withMean=True, withStd=True, inputCol=features, outputCol="scaled"),
        FourierFeatures(width=width, gamma=1.0 / width, seed=seed, size=kernel_size),
        LogisticRegression(labelCol=label, featuresCol="fourier", regParam=1e-4, maxIter=50),
    ])
    return {
        "random_forest": Pipeline(stages=[RandomForestClassifier(numTrees=trees, maxDepth=max_depth, **common)]),
        "svm": kernel,
        "boosted_trees": Pipeline(stages=[GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.3, **common)]),
    }


# Cached partitions per core while models are fitted.
PARTITIONS_PER_CORE = 2


def train(df: DataFrame, models: Mapping[str, Estimator]) -> dict[str, PipelineModel]:
    """Fit each estimator on the same cached rows.

    Fitting takes hundreds of short passes, and each task of a pass sends its
    state to the driver; so partitions are joined, without an exchange, to a few
    per core, whatever the size of the input.
    """
    rows = df.coalesce(PARTITIONS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        return {name: est.fit(rows) for name, est in models.items()}
    finally:
        rows.unpersist()


def probabilities(df: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """Add p_<name> = P(llm) of every model; other columns stay."""
    keep = list(df.columns)
    for name, model in models.items():
        scored = model.transform(df.select(*keep))
        df = scored.select(*keep, vector_to_array("probability")[1].alias(f"p_{name}"))
        keep.append(f"p_{name}")
    return df


def importance(models: Mapping[str, PipelineModel], names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Feature importances of the tree models (model, feature, importance)."""
    rows = []
    for name, model in models.items():
        last = model.stages[-1]
        if hasattr(last, "featureImportances"):
            rows += [(name, f, float(v)) for f, v in zip(names, last.featureImportances.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def save_artifacts(path: str, models: Mapping[str, PipelineModel], lookup: DataFrame, blocks: DataFrame, **about) -> None:
    """Write models, Markov lookup and block tables, and last the manifest."""
    spark = lookup.sparkSession
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    lookup.write.mode("overwrite").parquet(f"{path}/lookup")
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    manifest = json.dumps({"parts": list(PARTS), "models": list(models), **about})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_artifacts(spark: SparkSession, path: str) -> dict:
    """Read the artefacts back; a missing part, in the manifest or as a folder, is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    folder = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{p}")
    there = lambda p: folder(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder(p))
    missing = [p for p in PARTS if p not in manifest.get("parts", []) or not there(p)]
    missing += [f"models/{n}" for n in manifest["models"] if not there(f"models/{n}")]
    if missing:
        raise KeyError(f"missing required artifact parts: {missing}")
    return {
        **manifest,
        "models": {n: PipelineModel.load(f"{path}/models/{n}") for n in manifest["models"]},
        "lookup": spark.read.parquet(f"{path}/lookup"),
        "blocks": spark.read.parquet(f"{path}/blocks"),
    }
