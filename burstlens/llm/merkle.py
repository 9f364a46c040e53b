"""Merkle manifest of a table: one tree per group of rows, one tree over the groups' roots, and a proof for every row.

A row's leaf is the SHA-256 of its fields, each as ``-`` (null) or UTF-8 byte count, ``:`` and value. In each group the leaves ascend by
id; every ``FAN`` consecutive nodes (the last run may be shorter, even one) become the digest of their concatenated hex digests, until
one node remains. The groups' roots, ordered by group (null first, bytewise), form the upper tree in the same way.

Checkpoint and recompute: only every ``STEP``-th level is kept, as blocks of at most ``FAN ** STEP`` consecutive nodes, one row each, in the
shared folder. A proof is extracted from the top down: each block gets the path above it, makes the interior nodes of its own subtree
anew from the nodes it holds, gives every node its siblings, and forgets them. Paths exist in full only above the lowest
blocks (one per 256 rows); a row's own path is folded and digested where it is made. ``paths`` returns whole paths.

Rows are numbered by a range sort on (group, id, leaf) whose part sizes, not rows, give the offsets, so a group of any size is spread over
tasks. Everything is built-in functions.

Defined results: nulls are fields like others, a null group is a group, null ids come first and their rows are never altered; rows
with one id are ordered by their leaf, equal rows are neighbouring leaves; one leaf alone is its group's root; an empty table has no
leaves and no root; only the named columns are read, so others may have any name. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, stage

FAN = 16
STEP = 2
BLOCK = FAN**STEP
DIGEST = 64
ROWS_A_RANGE = 200_000
# Offsets are broadcast up to this many bytes of group names and numbers, else joined by shuffle.
BROADCAST_BYTES = 64_000_000
PATH = "array<struct<at:int,others:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row's fields."""
    return digest(F.concat(*[field(c) for c in columns]))


def group_name(group: Column) -> Column:
    """A text that is never null and sorts like the group, null first."""
    text = group.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), text))


@dataclass
class Forest:
    """Blocks of every kept level from the lowest up, and the root of each tree (tree, node)."""

    levels: list[DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    groups: Forest
    top: Forest


def _numbered(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` (tree, ...) with ``pos`` in their tree and ``m``, its size; and the largest size."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_RANGE))
    ordered = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    at = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("at", 33))
    counted = at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("n").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = settle(counted.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(by_tree).alias("m")))
    most, size = offsets.agg(F.max("m"), F.sum(F.octet_length("tree") + 64)).first()
    offsets = F.broadcast(offsets) if (size or 0) <= BROADCAST_BYTES else offsets
    return at.join(offsets, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"), most or 0


def _runs(nodes: Column) -> Column:
    """Concatenated digests of every ``FAN`` consecutive nodes."""
    last = F.floor((F.size(nodes) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""))


def _blocks(nodes: DataFrame, name: str, payload: Sequence[str] = ()) -> DataFrame:
    """One row per block: tree, pos, m (nodes of the tree at this level) and the block's nodes in order; at most ``BLOCK`` entries."""
    entry = F.struct("pos", "node", *payload)
    grouped = nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("m").alias("m"), F.array_sort(F.collect_list(entry)).alias("a"))
    return stage(grouped.withColumnRenamed("block", "pos"), name)


def _subtree(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``low``, the runs of their nodes, and ``high``, the run of the level above."""
    low = blocks.withColumn("low", _runs(F.col("a.node")))
    return low.withColumn("high", F.array_join(F.transform("low", lambda r: digest(r)), ""))


def _parents(blocks: DataFrame) -> DataFrame:
    """The node ``STEP`` levels up of each block; a tree that ends earlier has its root there."""
    node = F.when(F.col("m") > FAN, digest(F.col("high"))).when(F.col("m") > 1, F.col("high")).otherwise(F.col("a")[0]["node"])
    return _subtree(blocks).select("tree", "pos", F.ceil(F.col("m") / BLOCK).alias("m"), node.alias("node"))


def _forest(rows: DataFrame, order: Sequence[str], payload: Sequence[str] = ()) -> Forest:
    nodes, most = _numbered(rows, order)
    levels = [_blocks(nodes, "level-0", payload)]
    while most > BLOCK:
        levels.append(_blocks(_parents(levels[-1]), f"level-{STEP * len(levels)}"))
        most = -(-most // BLOCK)
    return Forest(levels, _parents(levels[-1]).select("tree", "node"))


def build(leaves: DataFrame, payload: Sequence[str] = ()) -> Manifest:
    """Both trees over ``leaves`` (tree, id, node and the columns of ``payload``, which stay with their leaf)."""
    groups = _forest(leaves, ["id", "node"], ["id", *payload])
    tops = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "node")
    return Manifest(groups, _forest(tops, ["id"], ["id"]))


def _own(run: Column, at: Column) -> Column:
    """One step of a path: place in the run, and the run without the node there."""
    begin = at * DIGEST
    return F.struct(at.cast("int").alias("at"), F.concat(run.substr(F.lit(1), begin), run.substr(begin + DIGEST + 1, F.length(run))).alias("others"))


def _path(p: Column, above: Column) -> Column:
    """The path of the ``p``-th node of a block: its steps inside the block, then those above."""
    low = F.expr("low")[(p / FAN).cast("int")]
    inside = F.array(_own(low, p % FAN), _own(F.col("high"), (p / FAN).cast("int")))
    levels = F.when(F.col("m") > FAN, 2).when(F.col("m") > 1, 1).otherwise(0)
    return F.concat(F.slice(inside, F.lit(1), levels), above)


def fold(node: Column, path: Column) -> Column:
    """The root that a node and a path give."""
    def up(h: Column, s: Column) -> Column:
        begin = s["at"] * DIGEST
        return digest(F.concat(s["others"].substr(F.lit(1), begin), h, s["others"].substr(begin + 1, F.length(s["others"]))))

    return F.aggregate(path, node, up)


def siblings(path: Column) -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: s["others"]), "")


def _lowest(forest: Forest, above: DataFrame) -> DataFrame:
    """The lowest blocks with ``low``, ``high`` and ``above``, the path from the block's subtree up; ``above`` has (tree, path, ...) per tree."""
    held = [c for c in above.columns if c not in ("tree", "path")]
    paths = above.withColumn("pos", F.lit(0).cast("long"))
    for blocks in forest.levels[:0:-1]:
        each = _subtree(blocks).join(paths, ["tree", "pos"])
        made = F.transform("a", lambda x, p: F.struct(x["pos"].alias("pos"), _path(p, F.col("path")).alias("path")))
        paths = each.select("tree", *held, F.inline(made))
    return _subtree(forest.levels[0]).join(paths.withColumnRenamed("path", "above"), ["tree", "pos"])


def _group_paths(manifest: Manifest) -> DataFrame:
    """Per group: tree, subroot, root and the path from the subroot to the root."""
    top = manifest.top.roots.select("tree", F.col("node").alias("root"), F.lit(None).cast(PATH).alias("path")).withColumn("path", F.array().cast(PATH))
    each = _lowest(manifest.top, top)
    made = F.transform("a", lambda x, p: F.struct(x["id"].alias("group"), x["node"].alias("subroot"), _path(p, F.col("above")).alias("path")))
    return each.select("root", F.inline(made)).withColumnRenamed("group", "tree")


def paths(manifest: Manifest) -> DataFrame:
    """Per leaf: tree, id, node, subroot, root and ``path``, its steps to the root (place in the run, siblings)."""
    each = _lowest(manifest.groups, _group_paths(manifest))
    made = F.transform("a", lambda x, p: F.struct(x["id"].alias("id"), x["node"].alias("node"), _path(p, F.col("above")).alias("path")))
    return each.select("tree", "subroot", "root", F.inline(made))


def audit(manifest: Manifest, claim: str = "claim") -> DataFrame:
    """Per leaf: id, leaf, subroot, root, digest of its proof, the root folded from its claimed leaf (its own where null), and whether that is the root."""
    each = _lowest(manifest.groups, _group_paths(manifest))

    def judge(x: Column, p: Column) -> Column:
        path = _path(p, F.col("above"))
        return F.struct(x["id"].alias("id"), x["node"].alias("leaf"), digest(siblings(path)).alias("proof_sha256"),
                        fold(F.coalesce(x[claim], x["node"]), path).alias("folded_root"))

    rows = each.select("subroot", "root", F.inline(F.transform("a", judge)))
    return rows.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def leaves(docs: DataFrame, columns: Sequence[str], id_col: str, group_col: str, altered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """tree, id, node, and ``claim``: the leaf with the columns of ``altered`` replaced, where ``when`` holds (null elsewhere)."""
    named = {c: F.col(f"`{c}`") for c in columns}
    other = {c: (altered or {}).get(c, x) for c, x in named.items()}
    claim = F.when(when, leaf(list(other.values()))) if when is not None else F.lit(None).cast("string")
    rows = docs.select(group_name(F.col(f"`{group_col}`")).alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf(list(named.values())).alias("node"), claim.alias("claim"))
    return stage(rows, "leaves")


def tamper_check(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """``audit`` with the text of every fifth row (by checksum of its id) lower-cased after the manifest was made."""
    text, number = F.col(f"`{text_col}`"), F.crc32(F.col(f"`{id_col}`").cast("string"))
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = leaves(docs, columns, id_col, group_col, {text_col: lowered}, F.coalesce(number % 5 == 0, F.lit(False)))
    return audit(build(rows, ["claim"])).withColumnRenamed("id", id_col)
