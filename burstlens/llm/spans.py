"""Spans of text found per row: Arrow batches in, counts and span lists out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[str, int, int]
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))


def find_spans(docs: DataFrame, finder: Callable[[], Callable[[list[str]], list[tuple[list[Span], list[Span]]]]], id_col: str, text_col: str) -> DataFrame:
    """Per row: id, text, ``base`` and ``added`` spans (code points, end exclusive). ``finder`` is made once per task.

    A null text is read as empty. Rows stay where they are; nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            found = find([t or "" for t in batch.column(1).to_pylist()])
            lists = [pa.array([[dict(zip(("kind", "first", "last"), s)) for s in row[k]] for row in found], SPANS) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=[id_col, "text", "base", "added"])

    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([*source.schema.fields, T.StructField("base", T.ArrayType(SPAN)), T.StructField("added", T.ArrayType(SPAN))])
    return source.mapInArrow(run, out)


def sampled_texts(docs: DataFrame, matched: Column, id_col: str, text_col: str, limit: int) -> Iterator[str]:
    """The texts of at most ``limit`` matched rows, those with the smallest hash of text and id; rows of one hash count once.

    Only hashes are ranked; texts are read in a second pass, for the hashes that were chosen.
    """
    text = F.col(f"`{text_col}`")
    hashed = docs.select(F.xxhash64(text, F.col(f"`{id_col}`").cast("string")).alias("h"), text.alias("text"), matched.alias("matched"))
    last = hashed.where("matched").select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if last is None:
        return iter(())
    chosen = hashed.where(F.col("h") <= last).where("matched").groupBy("h").agg(F.first("text").alias("text"))
    return (r["text"] for r in chosen.orderBy("h").limit(limit).toLocalIterator())


def in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """By start, then kind as listed, then end."""
    place = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["first"].alias("first"), F.array_position(place, s["kind"]).alias("k"), s["last"].alias("last"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(in_order(spans, kinds), lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(found: DataFrame, sign: str = "█") -> DataFrame:
    """The text with every character of a base or added span replaced by ``sign``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, *lists in zip(*[batch.column(c).to_pylist() for c in ("text", "base", "added")]):
                letters = list(text or "")
                for s in lists[0] + lists[1]:
                    letters[s["first"] : s["last"]] = sign * (s["last"] - s["first"])
                texts.append("".join(letters))
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)
