"""Confusion counts, metrics, class report, ensemble decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, *, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp of a 0/1 truth and prediction, in one pass."""
    n = lambda t, p: F.sum(((F.col(truth) == t) & (F.col(pred) == p)).cast("long"))
    counts = {"tn": n(0, 0), "fp": n(0, 1), "fn": n(1, 0), "tp": n(1, 1)}
    aggs = [F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where it is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def metrics(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p, r, f1 = _prf(tp, fp, fn)
    return counts.withColumns({"accuracy": ratio(tn + tp, tn + fp + fn + tp), "precision": p, "recall": r, "f1": f1})


def class_report(counts: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Rows non_llm, llm, macro avg, weighted avg with precision, recall, f1."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero, one = _prf(tn, fn, fp), _prf(tp, fp, fn)
    s0, s1 = (tn + fp).cast("double"), (tp + fn).cast("double")
    macro = tuple((a + b) / 2 for a, b in zip(zero, one))
    weighted = tuple(ratio(a * s0 + b * s1, s0 + s1) for a, b in zip(zero, one))

    def line(name: str, prf: Sequence[Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), prf[0].alias("precision"), prf[1].alias("recall"),
            prf[2].alias("f1_score"), support.alias("support"),
        )

    rows = F.array(line("non_llm", zero, s0), line("llm", one, s1),
                   line("macro avg", macro, s0 + s1), line("weighted avg", weighted, s0 + s1))
    return counts.select(*by, F.inline(rows))


def ensemble(df: DataFrame, *, probs: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Label by the mean of the present probabilities, and its confidence.

    Confidence is the largest probability of the chosen label among the
    models.  No model gives label 0 with confidence 0.
    """
    given = F.filter(F.array(*[F.col(p).cast("double") for p in probs]), lambda x: x.isNotNull())
    total = F.aggregate(given, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, F.size(given))
    label = F.when(mean >= threshold, 1).otherwise(0)
    conf = F.when(label == 1, F.array_max(given)).otherwise(1.0 - F.array_min(given))
    return df.withColumns({"predicted_label": label, "confidence": F.coalesce(conf, F.lit(0.0))})


def class_distribution(df: DataFrame, *, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def compare_rows(df: DataFrame, *, truth: str, prediction: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows with a truth or a prediction, with the match flag."""
    from burstlens.functions.labels import prediction_matches

    t, p = F.nullif(F.col(truth), F.lit("")), F.nullif(F.col(prediction), F.lit(""))
    rows = df.where(t.isNotNull() | p.isNotNull())
    return rows.withColumns({"match": prediction_matches(F.col(truth), F.col(prediction)), **(extra or {})})
