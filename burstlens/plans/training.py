"""Burst sequences to fingerprints, feature vectors, models and predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.functions import labels
from burstlens.operators import evaluate, features, markov, models
from burstlens.session import broadcast_if_small, hint_if_small, settle


def array_steps(flowlets: DataFrame, *, ident: Sequence[str]) -> DataFrame:
    """Both state sequences of burst records that carry their arrays.

    Where a record is a part of a longer burst, its columns ``prev_size``,
    ``prev_gap`` and ``more`` join it to the parts beside it.
    """
    sizes = F.transform(F.coalesce("packet_sizes", F.array().cast("array<int>")), lambda s: s.cast("string"))
    gaps = F.transform(F.coalesce("inter_packet_times", F.array().cast("array<double>")), labels.gap_state)
    parts = "more" in flowlets.columns
    before = {"size_block": F.col("prev_size").cast("string"), "time_gap": F.when(F.col("prev_gap").isNotNull(), labels.gap_state(F.col("prev_gap")))} if parts else {}
    steps = [
        markov.explode_sequence(flowlets, array, ident=ident, attr=attr, before=before.get(attr), more=F.col("more") if parts else None)
        for attr, array in (("size_block", sizes), ("time_gap", gaps))
    ]
    return steps[0].unionByName(steps[1])


def fit_fingerprints(steps: DataFrame, *, cls: str) -> dict[str, DataFrame]:
    """Size blocks per class and Markov tables per class and attribute.

    The steps are read once, into counts of equal steps; blocks, transitions
    and ends all come from that table, never from a row per packet.
    """
    return fit_counts(settle(markov.step_counts(steps, by=[cls])), cls=cls)


def fit_counts(raw: DataFrame, *, cls: str) -> dict[str, DataFrame]:
    """The fingerprints of a table of step counts."""
    sizes = raw.where(F.col("attr") == "size_block").groupBy(cls, F.col("state").cast("long").alias("value"))
    blocks = settle(markov.blocks_of(sizes.agg(F.sum("n").alias("n")), by=[cls]))
    mapped = markov.map_sizes(raw, hint_if_small(blocks), on=[cls])
    trans = settle(markov.transitions(mapped, by=[cls]))
    ends = settle(markov.sequence_ends(mapped, by=[cls]))
    return {"blocks": blocks, "transitions": trans, "ends": ends, "lookup": markov.lookup_table(trans, ends, cls=cls)}


class StoredCounts:
    """Step counts kept per capture, and their total, so that fingerprints follow added and deleted captures.

    ``path`` holds counts/change=k (the counts of the captures added by change k), deleted/change=k and total/change=k. A change reads
    the counts that it touches and the last total, never the steps of other captures. A change that is run again writes the same folders.
    """

    def __init__(self, spark: SparkSession, path: str, *, cls: str, capture: str) -> None:
        self.spark, self.path, self.cls, self.capture = spark, path.rstrip("/"), cls, capture

    def _total(self, change: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/total/change={change - 1}") if change else None

    def counts(self, before: int) -> DataFrame | None:
        """Counts of the captures that are there before change ``before``."""
        if not before:
            return None
        held = self.spark.read.parquet(f"{self.path}/counts").where(F.col("change") < before)
        gone = self.spark.read.schema(f"{self.capture} long, change int").parquet(f"{self.path}/deleted").where(F.col("change") < before)
        gone = gone.groupBy(self.capture).agg(F.max("change").alias("_gone"))
        return held.join(gone, self.capture, "left").where(F.col("_gone").isNull() | (F.col("change") >= F.col("_gone"))).drop("change", "_gone")

    def apply(self, change: int, *, added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """Change number ``change``: captures deleted, then steps of new captures added; gives the new total."""
        by = [self.cls]
        before = self.counts(change)
        named = F.col(self.capture).cast("long").alias(self.capture)
        gone = self.spark.range(0).select(F.col("id").alias(self.capture)) if deleted is None else deleted.select(named).distinct()
        gone.write.mode("overwrite").parquet(f"{self.path}/deleted/change={change}")
        minus = before.join(gone, self.capture, "left_semi") if deleted is not None and before is not None else None
        if added is not None:
            fresh = markov.step_counts(added.withColumn(self.capture, F.col(self.capture).cast("long")), by=[self.capture, self.cls])
            fresh.write.mode("overwrite").parquet(f"{self.path}/counts/change={change}")
            added = self.spark.read.parquet(f"{self.path}/counts/change={change}")
        parts = [x for x in (self._total(change), added) if x is not None]
        if not parts:
            raise ValueError("the first change must add captures")
        total = markov.merge_counts(parts[0], by=by, plus=parts[1] if len(parts) > 1 else None, minus=minus)
        total.write.mode("overwrite").parquet(f"{self.path}/total/change={change}")
        return self.spark.read.parquet(f"{self.path}/total/change={change}")

    def fit(self, change: int) -> dict[str, DataFrame]:
        """The fingerprints after change ``change``."""
        return fit_counts(self.spark.read.parquet(f"{self.path}/total/change={change}"), cls=self.cls)


def score_fingerprints(steps: DataFrame, blocks: DataFrame, lookup: DataFrame, *, ident: Sequence[str], cls: str) -> DataFrame:
    """Four log-likelihoods per burst; sizes are read through the llm blocks."""
    llm = broadcast_if_small(blocks.where(F.col(cls) == "llm").select("value", "block"))
    mapped = markov.map_sizes(steps, llm)
    return markov.score_markov(mapped, broadcast_if_small(lookup), ident=ident)


def feature_table(
    flowlets: DataFrame, likelihoods: DataFrame, *, ident: Sequence[str], with_direction: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Vector of 12 (or 11) features per burst; ``ident`` and ``keep`` stay."""
    joined = flowlets.join(likelihoods, list(ident), "left")
    return features.assemble(joined, features.feature_names(with_direction=with_direction), keep=[*ident, *keep])


def train_and_evaluate(
    vectors: DataFrame, *, label: str, group: str, estimators: Mapping[str, Estimator], test: float = 0.2, seed: int = 42
) -> dict[str, Any]:
    """Split by flow, fit every model on the train part, measure on the rest."""
    split = features.group_split(vectors, group=group, test=test, seed=seed).persist()
    fitted = models.train(split.where(~F.col("is_test")), estimators)
    scored = models.probabilities(split.where("is_test"), fitted)
    pairs = F.array(*[
        F.struct(F.lit(n).alias("model"), (F.col(f"p_{n}") >= 0.5).cast("int").alias("pred")) for n in fitted
    ])
    long = scored.select(label, F.inline(pairs))
    counts = settle(evaluate.confusion(long, truth=label, pred="pred", by=["model"]))
    return {
        "models": fitted,
        "split": split,
        "sizes": evaluate.class_distribution(split, label=label, by=["is_test"]),
        "metrics": evaluate.metrics(counts),
        "report": evaluate.class_report(counts, by=["model"]),
    }


def train_provider(
    flowlets: DataFrame,
    steps: DataFrame,
    *,
    provider: str,
    ident: Sequence[str],
    group: str,
    estimators: Mapping[str, Estimator],
    with_direction: bool = True,
    fit_on: str = "all",
    test: float = 0.2,
    seed: int = 42,
) -> dict[str, Any]:
    """Provider against other traffic, from bursts and their steps to models.

    ``flowlets`` needs source_file, traffic_class and the feature columns;
    ``ident`` names the burst in both tables.  Blocks and chains are fitted on
    all rows, or with ``fit_on="train"`` on the training flows alone.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    rows = flowlets.where(features.provider_rows(F.col("source_file"), F.col("traffic_class"), provider))
    rows = rows.withColumn("label", (F.col("traffic_class") == "llm").cast("int"))
    split = features.group_split(rows, group=group, test=test, seed=seed)
    chosen = split if fit_on == "all" else split.where(~F.col("is_test"))
    known = steps.join(chosen.select(*ident, "traffic_class"), list(ident))
    fit = fit_fingerprints(known, cls="traffic_class")
    scores = score_fingerprints(
        steps.join(rows.select(*ident), list(ident), "left_semi"), fit["blocks"], fit["lookup"], ident=ident, cls="traffic_class")
    vectors = feature_table(rows, scores, ident=ident, with_direction=with_direction, keep=["label", group])
    return {**fit, **train_and_evaluate(vectors, label="label", group=group, estimators=estimators, test=test, seed=seed)}


def annotate(
    vectors: DataFrame, fitted: Mapping[str, Any], *, provider: str = "ChatGPT", threshold: float = 0.5
) -> DataFrame:
    """Predicted name and confidence of each burst by the ensemble."""
    scored = evaluate.ensemble(
        models.probabilities(vectors, fitted), probs=[f"p_{n}" for n in fitted], threshold=threshold
    )
    name: Column = labels.predicted_name(F.col("predicted_label"), provider)
    return scored.withColumns({"model_llm_prediction": name, "model_llm_confidence": F.col("confidence")})
