import random
import re

import pytest
from helpers import LOWER, edge_rows, frame, prose

from burstlens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def restated(text, items):
    w = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        v = WORD.findall((t or "").translate(LOWER))
        size = min(10, len(v))
        for a in range(len(v) - size + 1) if v else ():
            for b in range(len(w) - size + 1):
                if w[b : b + size] == v[a : a + size]:
                    hit |= set(range(b, b + size))
                    found |= {str(i)} - {"None"}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 30])
def test_hits(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", 2)
    items = [(0, "Alpha, beta gamma"), (1, prose(1, 40)), (2, prose(1, 40)), (3, ""), (4, None), (5, "one"), (None, "two THREE"), (6, prose(77, 12))]
    r = random.Random(3)
    rows = edge_rows()[:14] + [(50 + i, prose(i, 20) + " alpha BETA-gamma " + " ".join(prose(1, 40).split(" ")[r.randrange(9) : 25]) + " " + prose(77, 12)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(((d, *restated(t, items)) for d, t in rows), key=repr)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(restated(t, items)[1] == 0 for _, t in rows)


def test_empty_tables(spark):
    docs, bench = frame(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, bench.limit(0)).collect()] == [(1, 2, 0, [])]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_passage_repeated_and_shared(spark):
    """One passage 100,000 times in one text, and 1,000 items that share it."""
    passage = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(i, passage) for i in range(1000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{passage}. " * 100_000), (2, "nothing")], "doc_id long, `text` string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (1_000_000, 1_000_000, sorted(map(str, range(1000))))
    assert (got[2].n_hit, got[2]["items"]) == (0, [])


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x")], "`doc.id` long, `the text` string")
    bench = spark.createDataFrame([("q", "b C")], "`item id` string, `t.t` string")
    names = {"text_col": "the text", "item_col": "item id", "item_text": "t.t"}
    assert sorted(tuple(r) for r in decontaminate.contamination(docs, bench, "doc.id", **names).collect()) == [(1, 3, 2, ["q"]), (2, 1, 0, [])]
    assert [r["doc.id"] for r in decontaminate.clean(docs, bench, **names).collect()] == [2]
