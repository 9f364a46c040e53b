import math
import re
from collections import Counter

import pytest
from helpers import LOWER, edge_rows, frame, prose

from burstlens.llm import lexical
from burstlens.llm.words import plain_words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def restated(rows, items, keep=10):
    """(item, rank, id, score) by scoring every document for every item."""
    counts = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    joined = {}
    for i, t in items:
        joined[i] = joined.get(i, []) + terms(t)
    out = []
    for i, wanted in joined.items():
        scored = []
        for d, c in counts:
            if c:
                m = 25 + (75 * sum(c.values()) * n_docs) // total
                scored.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t]), d))
        order = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:keep]
        out += [(i, k, d, s) for k, (s, d) in enumerate(order, 1)]
    return out


ITEMS = [(0, "Alpha, beta gamma alpha"), (1, prose(1, 40)), (2, prose(1, 40)), (3, ""), (4, None), (5, "one"), (5, "TWO one"), (None, "three THREE x"), (7, "nowhere"), (8, "É éo b.c")]


@pytest.mark.parametrize("block,piece", [(500_000, 1_000_000), (25, 7)])
def test_search(spark, monkeypatch, block, piece):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(lexical, "PIECE", piece)
    rows = edge_rows() + [(70 + i, f"alpha {'beta ' * (i % 3)} É éo, b {prose(i, 5)}") for i in range(25)] + [(None, "alpha beta gamma")]
    docs = frame(spark, rows)
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in ITEMS], "item_id long, text string, item string, id string")
    got = [tuple(r) for r in lexical.search(docs, items).collect()]
    assert sorted(got, key=repr) == sorted(restated(rows, ITEMS), key=repr)


def test_ids_of_text_and_few_kept(spark):
    rows = [(f"d{i}", f"a b {'c ' * (i % 4)}") for i in range(40)] + [("é", "c")]
    docs = spark.createDataFrame(rows, "`my id` string, `t.t` string").repartition(4)
    items = spark.createDataFrame([("q", "c c a"), ("r", "zzz")], "q string, t string")
    got = [tuple(r) for r in lexical.search(docs, items, "my id", "t.t", "q", "t", keep=3).collect()]
    numbers = {d: i for i, d in enumerate(sorted(d for d, _ in rows))}
    want = restated([(numbers[d], t) for d, t in rows], [("q", "c c a"), ("r", "zzz")], 3)
    assert sorted((q, k, numbers[d], s) for q, k, d, s in got) == sorted(want)


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == restated([(1, "a b")], [(1, "a")])


def test_words():
    text = "Ab-c É1 \x00x\ty_z ÀB 漢字,k\x7fq"
    assert [w.decode() for w in plain_words(text)] == terms(text)
