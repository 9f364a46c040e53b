"""Ranked lexical search the other way round: documents stream through an inverted index of the items.

The terms of the items (the queries) make a small inverted index, term -> (item, count), that is broadcast; every document's term counts pass
through it and update a bounded heap per item in each task; the heaps are merged in two steps. Documents are never shuffled, and a
term that every document holds costs no more than its items.

The index goes out in blocks of at most ``BLOCK_POSTINGS`` (item, term) pairs (a single larger item is a block of its own): items are dealt
by hash, and into more blocks until that bound holds. Each block takes one pass over the texts, which leaves the counts of its terms per
document in the shared folder; statistics (documents, terms, document frequencies) come from there and cover all documents.

Scores: a term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))`` over N documents with a term; a document of n terms has length factor
``25 + (75 n N) div L`` over L terms in all, and gains weight times ``(10^9 tf) div (1000 tf + 8 m)`` for each term of the item, repeats included.

Defined results: null and empty texts have no terms and match nothing; rows of one item id are one item with all their terms (a null id is an item, too);
an item without terms, or whose terms no document holds, has no rows; repeated document rows are ranked row by row; equal scores
ascend by id, a null id last; empty tables give no rows; only the named columns are read. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, stage
from .words import plain_words

KEEP = 10
BLOCK_POSTINGS = 500_000
# Cells of one dense piece of document by item scores, and postings expanded at once.
PIECE = 1_000_000
SALTS = 64
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass
class Index:
    """Terms by number, and per term a run of (item, count) in ``item`` and ``count``, from ``first[t]`` to ``first[t + 1]``."""

    items: list
    terms: dict[bytes, int]
    first: np.ndarray
    item: np.ndarray
    count: np.ndarray


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term, n: how often each item holds each of its terms."""
    lowered = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col(f"`{id_col}`").alias("item"), F.explode(F.split(lowered, BETWEEN)).alias("term")).where("term <> ''")
    return each.groupBy("item", "term").agg(F.count(F.lit(1)).alias("n"))


def blocks(postings: DataFrame) -> tuple[DataFrame, int]:
    """``postings`` with a block number, and the number of blocks; each holds at most ``BLOCK_POSTINGS`` rows or a single item."""
    sizes = settle(postings.groupBy("item").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.select(F.sum("size")).first()[0] or 0
    n, number = max(1, -(-total // BLOCK_POSTINGS)), F.xxhash64(F.col("item").cast("string"))
    while n > 1 or total > BLOCK_POSTINGS:
        dealt = sizes.groupBy(F.pmod(number, F.lit(n))).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items"))
        if dealt.where((F.col("size") > BLOCK_POSTINGS) & (F.col("items") > 1)).isEmpty():
            break
        n *= 2
    return postings.withColumn("block", F.pmod(number, F.lit(n))), n if total else 0


def index_of(rows: list) -> Index:
    """The inverted index of (item, term, n) rows."""
    items, terms = {}, {}
    for r in rows:
        items.setdefault(r["item"], len(items))
        terms.setdefault(r["term"].encode("utf-8"), len(terms))
    term = np.array([terms[r["term"].encode("utf-8")] for r in rows], np.int64)
    order = np.argsort(term, kind="stable")
    item, count = np.array([items[r["item"]] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    return Index(list(items), terms, np.searchsorted(term[order], np.arange(len(terms) + 1)), item[order], count[order])


def term_counts(docs: DataFrame, shared) -> DataFrame:
    """Per row of ``docs`` (id, text): id, n (all its terms), and the numbers and counts of its terms that the index holds."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        for batch in batches:
            n, ends, numbers, times = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = plain_words(text) if text else []
                held = Counter(filter(terms.__contains__, words))
                n.append(len(words))
                numbers += map(terms.__getitem__, held)
                times += held.values()
                ends.append(len(numbers))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))], names=["id", "n", "terms", "times"])

    out = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(count, out)


def weights(counts: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of every term of the index, N and L, from the counts of all documents."""
    documents, total = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(terms, np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        held[r["t"]] = r["df"]
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in held], np.int64), documents, total


class Heaps:
    """The ``keep`` best (score, id) of every item, updated piece by piece."""

    def __init__(self, items: int, keep: int):
        self.keep, self.least = keep, np.ones(items, np.int64)  # the least score that still counts
        self.item, self.score, self.null, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), None

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` by document and item."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        self.item, self.score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        self.null = np.concatenate([self.null, null[row]])
        self.id = ids[row] if self.id is None else np.concatenate([self.id, ids[row]])
        order = np.lexsort((np.unique(self.id, return_inverse=True)[1], self.null, -self.score, self.item))
        sorted_items = self.item[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        last = order[place == self.keep - 1]
        self.least[self.item[last]] = self.score[last]
        kept = order[place < self.keep]
        self.item, self.score, self.null, self.id = self.item[kept], self.score[kept], self.null[kept], self.id[kept]


def _scored(index: Index, gain: np.ndarray, term: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Documents from, to, and their scores by item, in pieces of bounded size; ``gain`` is what each (document, term) adds for one occurrence in an item."""
    width = len(index.items)
    spread = np.concatenate([[0], np.cumsum(index.first[term + 1] - index.first[term])])[ends]
    low, n = 0, len(ends) - 1
    while low < n:
        high = max(low + 1, min(low + max(1, PIECE // width), int(np.searchsorted(spread, spread[low] + PIECE, "right")) - 1))
        a, b = ends[low], ends[high]
        runs = index.first[term[a:b] + 1] - index.first[term[a:b]]
        begins = np.cumsum(runs) - runs
        at = np.arange(runs.sum()) + np.repeat(index.first[term[a:b]] - begins, runs)
        row = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
        scores = np.zeros((high - low) * width, np.int64)
        np.add.at(scores, np.repeat(row * width, runs) + index.item[at], np.repeat(gain[a:b], runs) * index.count[at])
        yield low, high, scores.reshape(high - low, width)
        low = high


def best(counts: DataFrame, shared, weight: np.ndarray, documents: int, total: int, item_field: T.StructField, keep: int) -> DataFrame:
    """item, id and score of each task's heaps."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, item_type = to_arrow_type(counts.schema["id"].dataType), to_arrow_type(item_field.dataType)
    fixed = counts.sparkSession.sparkContext.broadcast(weight)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w = shared.value, fixed.value
        heaps = Heaps(len(index.items), keep)
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            if pa.types.is_integer(id_type):
                plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
            else:
                plain = np.array([x if x is not None else "" for x in ids.cast(pa.string()).to_pylist()], object)
            m = 25 + 75 * batch.column(1).to_numpy() * documents // total
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            term = batch.column(2).values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
            times = batch.column(3).values.to_numpy()
            first = batch.column(3).offsets.to_numpy()[0]
            tf = times[first : first + len(term)].astype(np.int64)
            ends = ends - ends[0]
            gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends))))
            for low, high, scores in _scored(index, gain, term, ends):
                heaps.add(scores, null[low:high], plain[low:high])
        if heaps.id is not None:
            named = pa.array([None if z else x for x, z in zip(heaps.id.tolist(), heaps.null)], id_type if pa.types.is_integer(id_type) else pa.string()).cast(id_type)
            yield pa.RecordBatch.from_arrays([pa.array([index.items[i] for i in heaps.item], item_type), named, pa.array(heaps.score)], names=["item", "id", "score"])

    out = T.StructType([T.StructField("item", item_field.dataType), counts.schema["id"], T.StructField("score", T.LongType())])
    return counts.where(F.size("terms") > 0).mapInArrow(stream, out)


def merged(heaps: DataFrame, keep: int) -> DataFrame:
    """The best of all tasks' heaps, first among every ``SALTS``-th task, so that no group holds more than a share of them."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    part = heaps.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= keep)
    return part.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= keep)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: int = KEEP) -> DataFrame:
    """Per item its best documents: item id, rank (from 1), document id, score."""
    spark = docs.sparkSession
    postings, n = blocks(settle(item_terms(items, item_col, item_text)))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    item_field = postings.schema["item"]
    out = spark.createDataFrame([], T.StructType([item_field, source.schema["id"], T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())]))
    for block in range(n):
        rows = postings.where(F.col("block") == block).select("item", "term", "n").collect()
        if not rows:
            continue
        index = index_of(rows)
        shared = spark.sparkContext.broadcast(index)
        counts = stage(term_counts(source, shared), "term-counts")
        weight, documents, total = weights(counts, len(index.terms))
        if documents:
            out = out.unionByName(settle(merged(best(counts, shared, weight, documents, total, item_field, keep), keep)))
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
