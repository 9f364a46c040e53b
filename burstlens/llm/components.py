"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, label): each node of ``links`` (columns a, b of one type) with the smallest node that it reaches.

    Each round hangs the larger neighbours of every node, then all its smaller ones, on the smallest; the number of rounds grows with
    the logarithm of the longest chain. Minima are combined before the shuffle, the links are never in one task, and every round
    is written to the shared folder. Loops and repeated links do not matter; no links give no rows.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        sides = _both(edges)
        kept = sides if larger else sides.where("b < a")
        least = kept.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = kept.join(least, "a").where("b > a" if larger else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            hung = hung.union(least.select("a", F.col("m").alias("b")))
        return hung.where("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = state(edges)
    while before[0]:
        edges = stage(star(star(edges, True), False), "links")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
