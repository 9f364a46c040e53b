import random
import zlib

import numpy as np
import pytest
from helpers import EXTRA, edge_rows

from burstlens.llm import toxicity as t
from burstlens.llm.queries import op12_toxicity

FILL = [f"w{i}" for i in range(300)]


def paired_texts(n, seed=1):
    """Label 1 when an insult meets the group, or praise meets nobody: no word alone tells anything."""
    r, out = random.Random(seed), []
    for i in range(n):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = r.choices(FILL, k=25) + ["Insult" if insult else "praise", "group" if group else "nobody"]
        out.append((i, int(insult == group), " ".join(words)))
    return out


def slow_score(machine, text):
    """The sum over all pairs, one by one."""
    at = [list(machine.cells).index(c) for c in t.cells_of(text) if c in machine.cells]
    total = machine.bias + sum(machine.weight[i] for i in at)
    total += sum(float(machine.factor[i] @ machine.factor[j]) for k, i in enumerate(at) for j in at[:k])
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_pairs_that_no_word_tells():
    rows = paired_texts(900)
    machine = t.fit([(y, t.cells_of(x)) for _, y, x in rows[:600]])
    got = t.scores(machine, [x for *_, x in rows[600:]])
    assert np.mean((got >= 0.5) == [y for _, y, _ in rows[600:]]) > 0.98
    machine.factor[:] = 0
    assert np.mean((t.scores(machine, [x for *_, x in rows[600:]]) >= 0.5) == [y for _, y, _ in rows[600:]]) < 0.65


def test_scores_are_the_sum_over_pairs():
    machine = t.fit([(y, t.cells_of(x)) for _, y, x in paired_texts(300)])
    texts = ["insult group", "praise group insult nobody", "", None, "unknown words", "INSULT", "w1 " * 5000 + "praise nobody"]
    assert t.scores(machine, texts) == pytest.approx([slow_score(machine, x) for x in texts])


def test_rows_and_edges(spark):
    rows = paired_texts(500, 3)
    docs = [(i, x) for i, _, x in rows] + [(1000 + (i or 0), x) for i, x in edge_rows()] + [(None, "insult group"), (7, rows[7][2]), (2000, None), (2001, "insult group " * 30_000)]
    labels = [(i, y) for i, y, _ in rows] + [(3, 1 - rows[3][1]), (None, 1), (2000, None), (2001, 5), (9999, 1)]
    table = spark.createDataFrame([(*d, *EXTRA) for d in docs], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(4)
    marks = spark.createDataFrame([(i, y, "x", "y") for i, y in labels], "doc_id long, toxic int, text string, id string")
    got = t.toxicity(table, marks).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    learned = [(y, i, x) for i, y, x in rows if not held(i) and i != 3]
    assert len(got) == len(docs) and all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    judged = [by[i].predicted == y for i, y, _ in rows if held(i)]
    assert len(judged) > 60 and np.mean(judged) > 0.95 and len(learned) > 300
    assert by[None].predicted == 1 and by[2001].predicted == 1 and by[2000].score == by[1006].score and len({r.score for r in got if r.doc_id == 7}) == 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        assert sorted((r.doc_id, r.score, r.predicted) for r in t.toxicity(docs, marks).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert t.toxicity(docs.limit(0), labels).count() == 0


def test_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(t, "SAMPLE_PER_CLASS", 20)
    labels = spark.range(20_000).selectExpr("id", "int(id % 10 = 0) as y")
    rows = t.sample(labels).collect()
    assert sorted(r.y for r in rows) == [0] * 20 + [1] * 20


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.predicted, truth[r.doc_id]) for r in op12_toxicity(spark, folder).collect() if r.held_out and r.doc_id in truth]
    caught = [p for p, y in rows if y]
    assert len(caught) > 80 and np.mean(caught) > 0.85 and np.mean([p for p, y in rows if not y]) < 0.01
