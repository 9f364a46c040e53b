"""Packing of tokenized documents into sequences by vector best fit.

A document's ids, ended by one end id, are cut into pieces of at most ``capacity`` tokens (only longer documents; the first piece
takes the odd rest). Each sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Pieces
come by falling length; each goes to the open sequence that has room under every capacity and whose weighted residual is
smallest after taking it (``rule="norm"``), or whose weighted dot product with the piece is largest (``rule="dot"``); else a
new sequence opens. Ties go to the sequence opened first.

Texts are tokenized once; what is kept of a piece (place, length, checksum) is written to the shared folder, and ids can be
had from ``pieces(with_ids=True)``. Pieces are dealt round robin into groups of about ``GROUP_PIECES`` whatever their lengths or copies,
each group is packed in one task; then the sequences of all groups that are not nearly full are packed once more as wholes,
by the same rule, in groups of the same size.

Defined results: null and empty texts are one piece of one token (the end id); equal documents are packed one by one; repeated
ids are separate documents; an empty table gives no rows; only the id and text columns are read. A text of any length is
tokenized whole, runs of white space of any length too.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

CAPACITY = 2048
GROUP_PIECES = 8192
# Sequences with fewer free tokens than this share of the capacity are not packed again.
NEARLY_FULL = 1 / 256
# Fixed values of the vocabulary: its split pattern and its special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
# The pattern's white space; runs of it that are so long that the pattern engine gives up are cut out before.
LONG_RUN = 50_000
WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
END = b"\0\0\0\0"


def encoder(ranks_path: str):
    """Text -> little-endian 32-bit ids, by the byte pairs of a rank file; the special token's string is its id."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

    def plain(text: str) -> bytes:
        return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""

    def encode(text: str | None) -> bytes:
        parts, at = [], 0
        for m in WHITE.finditer(text or ""):
            # the pattern takes a whole run before the end or the special token, else all but its last character
            whole = m.end() == len(text) or text.startswith(SPECIAL, m.end())
            end = m.end() if whole else m.end() - 1
            parts += [plain(text[at : m.start()]), np.array(encoding._encode_single_piece(text[m.start() : end]), "<u4").tobytes()]
            at = end
        return b"".join(parts) + plain(text[at:]) if text else b""

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and with ``with_ids`` the ids."""
    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    out = T.StructType([source.schema[0], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c, _ in kinds[1:]]])
    if with_ids:
        out.add("ids", T.ArrayType(T.LongType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path)
        for batch in batches:
            take, rows, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                coded = encode(text) + END
                for k, (start, length) in enumerate(cuts(len(coded) // 4, capacity)):
                    part = coded[4 * start : 4 * (start + length)]
                    take.append(i)
                    rows.append((k, start, length, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for _, kind in kinds]
            columns = [batch.column(0).take(pa.array(take, pa.int32())), *columns]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names=out.names)

    return source.mapInArrow(cut, out)


def best_fit(sizes: np.ndarray, limits: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each row of ``sizes`` (tokens first), under all ``limits``."""
    n = len(sizes)
    which, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((n, sizes.shape[1]))
    names = np.empty(n, np.int64)
    room = opened = 0  # bins kept as open, bins opened so far
    scale = weights / limits**2
    for i in np.argsort(-sizes[:, 0], kind="stable"):
        x = sizes[i]
        free = left[:room]
        fits = np.flatnonzero((free >= x).all(1))
        if len(fits):
            near = free[fits]
            score = ((near - x) ** 2 * scale).sum(1) if rule == "norm" else -(near * x * scale).sum(1)
            j = fits[score.argmin()]
        else:
            j = room
            left[j], names[j] = limits, opened
            room += 1
            opened += 1
        which[i], place[i] = names[j], limits[0] - left[j, 0]
        left[j] -= x
        if left[j].min() <= 0:  # no capacity of one kind left: closed, later ones move up in order
            left[j : room - 1], names[j : room - 1] = left[j + 1 : room].copy(), names[j + 1 : room].copy()
            room -= 1
    return which, place


def _in_groups(rows: DataFrame, limits: tuple[float, ...], weights: tuple[float, ...], rule: str) -> DataFrame:
    """``rows`` (tokens, docs, cost) with ``bin`` and ``place``, packed in groups of bounded size dealt round robin."""
    groups = max(1, -(-rows.count() // GROUP_PIECES))
    dealt = rows.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        which, place = best_fit(group[["tokens", "docs", "cost"]].to_numpy(float), np.array(limits, float), np.array(weights, float), rule)
        return group.assign(bin=group["g"].to_numpy() * (1 << 32) + which, place=place)

    kinds = T.StructType([*dealt.schema.fields, T.StructField("bin", T.LongType()), T.StructField("place", T.LongType())])
    return dealt.groupBy("g").applyInPandas(pack, kinds).drop("g")


def pack(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_docs: int | None = None,
         max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), rule: str = "norm") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    By default at most ``capacity`` documents and an attention cost of ``capacity`` squared, which tokens alone imply.
    """
    limits = (capacity, max_docs or capacity, max_cost or float(capacity) ** 2)
    cut = stage(pieces(docs, ranks_path, id_col, text_col, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.select("row", F.col("length").alias("tokens"), F.lit(1).cast("long").alias("docs"), (F.col("length") * F.col("length")).alias("cost"))
    full = F.col("tokens") == capacity
    once = stage(_in_groups(whole.where(~full), limits, weights, rule), "packed")
    bins = once.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("tokens", "docs", "cost")])
    loose = bins.where(F.col("tokens") < capacity * (1 - NEARLY_FULL)).select(F.col("bin").alias("inner"), "tokens", "docs", "cost")
    loose = stage(loose, "loose")  # rows are dealt by their place in files, the same for every attempt
    again = _in_groups(loose, limits, weights, rule).select("inner", F.col("bin").alias("outer"), F.col("place").alias("shift"))
    # Sequence numbers: 4 k for full pieces, 4 k + 1 for sequences of the first packing, 4 k + 2 for those packed again.
    packed = once.join(again, once["bin"] == again["inner"], "left").select(
        "row", F.coalesce(F.col("outer") * 4 + 2, F.col("bin") * 4 + 1).alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))
    alone = whole.where(full).select("row", (F.col("row") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.join(packed.unionByName(alone), "row").drop("row")
