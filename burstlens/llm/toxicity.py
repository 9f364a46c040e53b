"""Toxicity by a factorization machine over hashed terms.

A text's features are the hashed cells of its distinct words (lower-cased), whatever its length. The machine scores
``b + sum w_i + sum_(i<j) <v_i, v_j>`` over the cells present, so that a pair of words (an insult and the mention of a group) can
weigh otherwise than its two words alone; the pair sum is taken as half of (sum of factors)^2 less the sum of squares, in time linear in the words.

The machine is fitted on a bounded sample: at most ``SAMPLE_PER_CLASS`` labelled documents of each class, those with the smallest
hash of their id, and of these, in that order, as many as hold ``SAMPLE_CELLS`` cells; both bounds are parameters of the module. Tasks make the cells; texts never
leave them. Examples weigh so that both classes have the same total. A cell is learned if the classes differ in it by ``MARGIN`` standard errors, or if it
is among the ``PAIR_CELLS`` most frequent ones and some pair with it departs by ``PAIR_MARGIN`` from what its two words alone
foretell; others are chance and count as 0. Scoring covers all rows.

Defined results: null and empty texts have no cells and get the score of the bias; labels other than 0 and 1, null ids, and ids whose labels disagree are not
learned from; several documents of one id are all learned; a null id is not held out; without examples of both classes
every score is 0; repeated rows get equal scores; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import plain_words

CELLS = 1 << 24
SAMPLE_PER_CLASS = 4_000
SAMPLE_CELLS = 4_000_000
FACTORS = 8
EPOCHS = 40
BATCH = 256
RATE = 0.2
# Pull of weights and of factors towards 0, per example of a step.
DECAY, FACTOR_DECAY = 1e-4, 1e-2
MARGIN, PAIR_MARGIN = 4.0, 6.5
PAIR_CELLS = 1_500
CHUNK = 256


@dataclass
class Machine:
    """Sorted cells, their weights and factors, and the bias."""

    cells: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float


def cells_of(text: str | None) -> np.ndarray:
    """Sorted distinct cells of a text's words."""
    words = set(plain_words(text.lower())) if text else ()
    return np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % CELLS)


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``x`` that ``ends`` bounds (0 for empty ones); each depends on its run alone."""
    total = np.add.reduceat(np.concatenate([x, np.zeros((1, *x.shape[1:]))]), ends[:-1], axis=0)
    total[ends[1:] == ends[:-1]] = 0
    return total


def raw(weight: np.ndarray, factor: np.ndarray, bias: float, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score before the logistic function, and the sum of factors, of each run of cell numbers."""
    v = factor[at]
    both = _sums(v, ends)
    return bias + _sums(weight[at], ends) + 0.5 * ((both**2).sum(1) - _sums((v**2).sum(1), ends)), both


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def paired(row: np.ndarray, at: np.ndarray, labels: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Cell numbers, among the most frequent, of the pairs whose documents' labels are not what the two cells alone foretell."""
    frequent = np.argsort(-seen, kind="stable")[:PAIR_CELLS]
    frequent = frequent[seen[frequent] > 4]
    place = np.full(len(seen), -1)
    place[frequent] = np.arange(len(frequent))
    x = np.zeros((len(labels), len(frequent)), np.float32)
    held = place[at] >= 0
    x[row[held], place[at[held]]] = 1
    n, ones = x.T @ x, x.T @ (x * labels[:, None].astype(np.float32))

    def log_odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        share = np.clip((part + 0.5) / (whole + 1), 0.02, 0.98)
        return np.log(share / (1 - share))

    alone = log_odds(np.diag(ones), np.diag(n))
    foretold = np.clip(logistic(alone[:, None] + alone[None, :] - log_odds(labels.sum(), len(labels))), 0.02, 0.98)
    far = np.abs(ones - n * foretold) / np.sqrt(np.maximum(n, 1) * foretold * (1 - foretold))
    np.fill_diagonal(far, 0)
    return frequent[far.max(1, initial=0) >= PAIR_MARGIN]


def chosen(row: np.ndarray, at: np.ndarray, labels: np.ndarray, cells: int) -> np.ndarray:
    """Which cells are learned."""
    seen, ones = np.bincount(at, minlength=cells), np.bincount(at, labels[row], cells)
    n1, n0 = labels.sum(), (1 - labels).sum()
    share = seen / len(labels)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    take = (seen > 1) & (np.abs(ones / n1 - (seen - ones) / n0) >= MARGIN * error)
    take[paired(row, at, labels, seen)] = True
    return take


def fit(examples: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = 12) -> Machine | None:
    """The machine of (label, cells) examples; None without both classes."""
    labels = np.array([y for y, _ in examples], float)
    if not 0 < labels.sum() < len(labels):
        return None
    found, at = np.unique(np.concatenate([c for _, c in examples]), return_inverse=True)
    row = np.repeat(np.arange(len(examples)), [len(c) for _, c in examples])
    take = chosen(row, at, labels, len(found))
    kept, cells = take[at], found[take]
    at, row = (np.cumsum(take) - 1)[at[kept]], row[kept]
    ends = np.searchsorted(row, np.arange(len(examples) + 1))
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum()) * len(labels)
    random = np.random.default_rng(seed)
    w, v, b = np.zeros(len(cells)), random.normal(0, 0.05, (len(cells), FACTORS)), 0.0
    gw, gv, gb = np.ones(len(cells)), np.ones(v.shape), 1.0  # sums of squared gradients: rare cells move slowly at first
    for _ in range(epochs):
        order = random.permutation(len(examples))
        for k in range(0, len(order), BATCH):
            part = np.sort(order[k : k + BATCH])
            sizes = ends[part + 1] - ends[part]
            stops = np.concatenate([[0], np.cumsum(sizes)])
            pick = at[np.arange(stops[-1]) + np.repeat(ends[part] - stops[:-1], sizes)]
            score, both = raw(w, v, b, pick, stops)
            error = (logistic(score) - labels[part]) * share[part]
            each, own = np.unique(pick, return_inverse=True)
            e = np.repeat(error, sizes)
            dw = np.bincount(own, e, len(each)) + DECAY * len(part) * w[each]
            pull = e[:, None] * (np.repeat(both, sizes, 0) - v[pick])
            dv = np.stack([np.bincount(own, pull[:, f], len(each)) for f in range(FACTORS)], 1) + FACTOR_DECAY * len(part) * v[each]
            gw[each] += dw**2
            gv[each] += dv**2
            w[each] -= RATE * dw / np.sqrt(gw[each])
            v[each] -= RATE * dv / np.sqrt(gv[each])
            gb += error.sum() ** 2
            b -= RATE * error.sum() / gb**0.5
    return Machine(cells, w, v, b)


def scores(machine: Machine | None, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 of each text."""
    if machine is None:
        return np.zeros(len(texts))
    found = [cells_of(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in found])
    every = np.concatenate(found) if found else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(machine.cells, every), max(0, len(machine.cells) - 1))
    known = machine.cells[at] == every if len(machine.cells) else np.zeros(len(every), bool)
    ends = np.searchsorted(row[known], np.arange(len(texts) + 1))
    return logistic(raw(machine.weight, machine.factor, machine.bias, at[known], ends)[0])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame) -> DataFrame:
    """h, id and y of at most ``SAMPLE_PER_CLASS`` ids of each class; a share by hash first, so that few rows are sorted."""
    agreed = labels.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other and y in (0, 1)").select("id", "y")
    sizes = {r["y"]: r["n"] for r in agreed.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, min(1.0, (1.2 * SAMPLE_PER_CLASS + 100) / n)).otherwise(share)
    h = F.xxhash64(F.col("id").cast("string"), F.lit(12))
    near = agreed.withColumn("h", h).where(F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0) < share)
    of = [near.where(F.col("y") == y).orderBy("h", "id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    return of[0].unionByName(of[1])


def learn(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine of the labelled ``docs`` (id, text); ``labels`` has id and y."""
    chosen = F.broadcast(sample(labels))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cells_of(t).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["h", "y", "cells"])

    out = T.StructType([T.StructField("h", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    made = docs.join(chosen, "id").select("h", F.col("y").cast("int").alias("y"), "text").mapInArrow(cells, out)
    examples, held = [], 0
    for r in made.orderBy("h", "cells").toLocalIterator():
        held += len(r["cells"]) // 4
        if held > SAMPLE_CELLS:
            break
        examples.append((r["y"], np.frombuffer(r["cells"], "<u4").astype(np.int64)))
    return fit(examples) if examples else None


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Per row: id, held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    i, y = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    source = docs.select(i.alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col(f"`{label_id}`").alias("id"), y.alias("y")).where(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("y").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(learn(source, known))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            each = [scores(shared.value, texts[k : k + CHUNK]) for k in range(0, len(texts), CHUNK)]
            found = np.concatenate(each) if each else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    out = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.select("id", held_out(F.col("id")).alias("held_out"), "text").mapInArrow(predict, out)
