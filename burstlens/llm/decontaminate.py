"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window). A window lies in a document only if
all its words do, so one necessary prefix token is enough: its rarest word, by the number of times that the corpus holds each benchmark
word, counted over all documents. Documents probe the index of prefix words with each of their words; the place
of the prefix word in the window fixes where the window would begin (positional bound), it must end inside the document
(length bound), and then all its words are compared. There is no hashing in the last step: matches are exact.

The index is broadcast in blocks of at most ``BLOCK_WORDS`` words of benchmark text, whatever the size of the benchmark: every
block meets all documents where they lie, up to ``BLOCKS_A_PASS`` of them at a time, for which the words are counted in one scan. Documents
are never shuffled. What a document keeps is its covered words as merged runs and the set of the items found, however often a passage
stands in it and however many items share it.

Defined results: a null or empty text has no words, no hits and is not contaminated; an item without words is never found; equal
windows of several items, and several items of one id, count for each item id once; a null item id is left out of the list of
ids but its words are hit; repeated document rows are judged row by row; an empty benchmark finds nothing, empty
documents give no rows; only the named columns are read, so clashing names do not matter. Any length of text is read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .words import plain_words

WINDOW = 10
# Words of benchmark text in one broadcast index: about 100 MB of Python objects.
BLOCK_WORDS = 200_000
BLOCKS_A_PASS = 4
RUN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("items", T.ArrayType(T.StringType()))])
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])


@dataclass
class Index:
    """prefix word -> (its place, window length) -> window -> number, and the item ids of each number."""

    prefixes: dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], int]]] = field(default_factory=dict)
    items: list[set[str | None]] = field(default_factory=list)


def windows_of(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = plain_words(text or "")
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def word_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often the corpus holds each word of a bounded vocabulary; counted in the tasks, one row per word and task."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        wanted = shared.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(filter(wanted.__contains__, plain_words(text)))
        yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()}


def build_index(items: list[tuple[str | None, str | None]], counts: dict[bytes, int], window: int) -> Index:
    index, numbers = Index(), {}
    for item_id, text in items:
        for w in windows_of(text, window):
            if w not in numbers:
                numbers[w] = len(index.items)
                index.items.append(set())
                place = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
                index.prefixes.setdefault(w[place], {}).setdefault((place, len(w)), {})[w] = numbers[w]
            index.items[numbers[w]].add(item_id)
    return index


def find(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[int]]:
    """(first word, end) of every occurrence of an indexed window, and the numbers of the windows found."""
    runs, numbers = [], set()
    total, prefixes = len(words), index.prefixes
    for at in [i for i, w in enumerate(words) if w in prefixes]:
        for (place, length), windows in prefixes[words[at]].items():
            first = at - place
            if first >= 0 and first + length <= total:
                number = windows.get(tuple(words[first : first + length]))
                if number is not None:
                    runs.append((first, first + length))
                    numbers.add(number)
    return runs, numbers


def merge_runs(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs in order that cover the same words."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            if last > out[-1][1]:
                out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark, item by item, in lists of at most ``BLOCK_WORDS`` words (one item may exceed it)."""
    block, size = [], 0
    for r in items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null").toLocalIterator():
        n = len(r["t"]) // 2 + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[list[tuple[str | None, str | None]]]]:
    """Up to ``BLOCKS_A_PASS`` blocks at a time; one empty list for an empty benchmark."""
    held, some = [], False
    for block in _blocks(items, id_col, text_col):
        held.append(block)
        some = True
        if len(held) == BLOCKS_A_PASS:
            yield held
            held = []
    if held or not some:
        yield held


def _with_hits(docs: DataFrame, text: str, hits: str, shared: list, fresh: bool) -> DataFrame:
    """``docs`` with what the windows of these indexes cover, added to what ``hits`` holds already."""
    kinds = docs.schema if fresh else T.StructType(docs.schema.fields[:-1])
    at = kinds.names.index(text)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [None] * batch.num_rows if fresh else batch.column(len(kinds)).to_pylist()
            found = []
            for text_now, old in zip(batch.column(at).to_pylist(), before):
                words = plain_words(text_now) if text_now else []
                runs = [(r["first"], r["last"]) for r in old["runs"]] if old else []
                ids = set(old["items"]) if old else set()
                for x in shared:
                    more, numbers = find(words, x.value)
                    runs += more
                    ids.update(i for n in numbers for i in x.value.items[n])
                found.append({"n_words": len(words), "runs": [{"first": a, "last": b} for a, b in merge_runs(runs)], "items": sorted(ids - {None})})
            columns = [batch.column(i) for i in range(len(kinds.fields))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, FOUND_ARROW)], names=[*kinds.names, hits])

    return docs.mapInArrow(probe, T.StructType([*kinds.fields, T.StructField(hits, FOUND)]))


def occurrences(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, hits: str = "hits") -> DataFrame:
    """``docs`` with a struct column: n_words, the runs of words inside found windows, and the sorted ids of the items they belong to.

    A pass holds at most ``BLOCKS_A_PASS`` indexes; a larger benchmark takes several passes, with the rows and what was found so far
    written to the shared folder between them.
    """
    spark, out, shared = docs.sparkSession, docs, []
    for k, blocks in enumerate(_passes(items, item_col, item_text)):
        if k:
            out = stage(out, "hits")
            for x in shared:
                x.unpersist()
        counts = word_counts(docs, {w for block in blocks for _, text in block for w in plain_words(text)}, text_col) if blocks else {}
        shared = [spark.sparkContext.broadcast(build_index(block, counts, window)) for block in blocks]
        out = _with_hits(out, text_col, hits, shared, not k)
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: id, n_words, n_hit (words inside a found window), items (sorted ids of items with found windows)."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = occurrences(source, items, "text", item_col, item_text, window, "found")
    covered = F.aggregate("found.runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select(F.col("id").alias(id_col), "found.n_words", covered.alias("n_hit"), "found.items")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows without a hit, with all their columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = occurrences(plain, items, f"c{docs.columns.index(text_col)}", hits="found", **names).where(F.size("found.runs") == 0)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
