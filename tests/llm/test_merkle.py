import hashlib
import zlib

import pytest
from helpers import EXTRA

from burstlens.llm import merkle
from burstlens.llm.registry import table


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root, and per node the sibling lists of each level with the node's place."""
    paths = [[] for _ in nodes]
    owner = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in owner[a + k]:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            up.append(h("".join(run)))
            owners.append([i for k in range(len(run)) for i in owner[a + k]])
        nodes, owner = up, owners
    return nodes[0], paths


def restated(rows):
    """The contract's columns by walking both trees in memory; rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order, trees = {}, {}
    for s in names:
        order[s] = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in order[s]])
    root, top = climb([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for r, path in zip(order[s], trees[s][1]):
            whole = path + top[k]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], r[4].translate({i: i + 32 for i in range(65, 91)})))
            for at, others in whole:
                node = h("".join(others[:at]) + node + "".join(others[at:]))
            out.append((r[0], leaf(r), trees[s][0], root, h("".join(x for _, o in whole for x in o)), node, node == root))
    return out


def frame(spark, rows):
    wide = [(*r, *[f"{c}-{i}" for c in EXTRA], "x", "y", "z") for i, r in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
                                 + ", tree string, pos string, `a.b` string").repartition(5)


def sample(n, source):
    return [(i * 7 % 10_007, source(i), "en" if i % 3 else None, i if i % 4 else None, f"Text {i} É" if i % 9 else None) for i in range(n)]


@pytest.mark.parametrize("parts", [None, 30])
def test_audit(spark, monkeypatch, parts):
    if parts:  # many small ranges, offsets joined by shuffle
        monkeypatch.setattr(merkle, "ROWS_A_RANGE", parts)
        monkeypatch.setattr(merkle, "BROADCAST_BYTES", -1)
    rows = sample(700, lambda i: "big" if i % 3 else f"s{i % 5}") + sample(3, lambda i: None) + sample(1, lambda i: "alone") + sample(17, lambda i: "é")
    rows += [(None, "big", None, None, "Null ID"), (None, "big", None, None, "Null ID"), (5, "s1", "en", 1, ""), (5, "s1", "en", 1, ""), (5, "s1", "en", 1, "Other"), (-3, "", "", 0, "x" * 300_000)]
    got = [tuple(r) for r in merkle.tamper_check(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(restated(rows), key=repr)
    assert {r[6] for r in got} == {True, False}


def test_three_kept_levels(spark, monkeypatch):
    """More than 256 blocks of leaves: a tree of five levels, and more than 256 groups above."""
    rows = [(i, "one" if i < 66_000 else f"g{i % 300}", None, None, f"T{i}" if i % 50 == 0 else None) for i in range(66_700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(r) for r in merkle.tamper_check(docs).collect()]
    assert sorted(got) == sorted(restated(rows))


def test_paths_fold_to_the_root(spark):
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    made = merkle.build(merkle.leaves(docs, ["doc_id", "text"], "doc_id", "lang"), ["claim"])
    rows = merkle.paths(made).select(merkle.fold(F.col("node"), F.col("path")).alias("f"), "root", "subroot", "tree")
    assert rows.where("f = root").count() == docs.count() and rows.select("subroot").distinct().count() == docs.select("lang").distinct().count()


def test_edges(spark):
    one = frame(spark, [(1, None, None, None, None)])
    assert [tuple(r) for r in merkle.tamper_check(one).collect()] == restated([(1, None, None, None, None)])
    assert merkle.tamper_check(one.limit(0)).count() == 0
