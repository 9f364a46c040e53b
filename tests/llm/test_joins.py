import pytest
from helpers import components, edge_rows, edited, frame, key, prose, sets, similar
from pyspark.sql import functions as F

from burstlens.llm import jaccard, line_dedup
from burstlens.llm.components import components as of_links

SMALL = {"BLOCK": 3, "SALT_POSTINGS": 2, "BUCKET_POSTINGS": 50, "BUCKET_GRAMS": 500, "BUCKETS": 2, "BATCH_GRAMS": 300, "COUNTED": 300, "EXPANDED": 50}


def corpus():
    """Groups of near copies of several closeness, chains, passages shared by unlike documents."""
    passage = prose(99, 30)
    rows = edge_rows() + [(100 + i, edited(prose(200 + i % 3, 45), i, 0.01 * (i % 4))) for i in range(24)]
    rows += [(200 + i, prose(300 + i, 8, 300) + " " + passage) for i in range(12)]
    words = [f"w{i}" for i in range(80)]
    return rows + [(300 + i, " ".join(words[2 * i : 2 * i + 50])) for i in range(12)]


@pytest.mark.parametrize("limits", [{}, SMALL, {**SMALL, "FREQUENT": 4, "BROADCAST_IDS": 2}])
def test_components_equal_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    got = [tuple(r) for r in jaccard.jaccard_components(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(components(rows), key=key)


def test_first_of_each_keeps_one(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = jaccard.first_of_each(docs)
    want = [(d, t) for (d, t), (_, n, first) in zip(rows, components(rows)) if not n or d == first]
    assert kept.columns == docs.columns and sorted(map(repr, kept.select("doc_id", "text").toLocalIterator())) == sorted(f"Row(doc_id={d!r}, text={t!r})" for d, t in want)


def test_empty(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert jaccard.jaccard_components(empty).count() == 0 and line_dedup.line_counts(empty).count() == 0 and line_dedup.dedup(empty).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in of_links(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert of_links(links.limit(0)).count() == 0


def restated(rows):
    """Numbers of removed lines per (id, text)."""
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], {}
    for d, t in docs:
        gone = []
        for i, line in enumerate(t.split("\n")):
            s = sets(line.lower()) if len(line.split()) >= 5 else frozenset()
            if any(similar(s, x) for x in seen):
                gone.append(i)
            if s:
                seen.append(s)
        out[d, t] = gone
    return out


def line_rows():
    rows = [(d, t) for d, t in corpus() if d is not None and d < 120]
    shared = "all rights reserved by the owner of this page"
    return rows + [(400 + i, f"{prose(i, 30)}\n{shared}\n{edited(shared + ' and of all its other pages in every land', i, 0.05)}\nshort line") for i in range(12)]


@pytest.mark.parametrize("limits", [{}, {"SALT": 2, "COMMON": 20}])
def test_removed_lines_equal_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows = line_rows()
    want = restated(rows)
    docs = frame(spark, rows)
    got = [(r.doc_id, r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.line_counts(docs).collect()]
    assert sorted(got) == sorted((d, len((t or "").split("\n")), len(want[d, t or ""]), want[d, t or ""]) for d, t in rows)


def test_texts_without_removed_lines(spark):
    rows = line_rows()
    want = restated(rows)
    docs = frame(spark, rows)
    left = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d, t])) for d, t in rows]
    got = line_dedup.dedup(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.select("doc_id", "text").collect()), key=repr) == sorted(left, key=repr)
    full = line_dedup.dedup(docs, emptied=False)
    assert full.count() == sum(not want[d, t or ""] or bool(x.strip()) for (d, t), (_, x) in zip(rows, left))


def restated_short(rows):
    """As ``restated``, with a line of 1 to 4 words as one whole sequence; lines without words stay."""
    seen, out = [], {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        out[d, t] = []
        for i, line in enumerate(t.split("\n")):
            s = sets(line.lower())
            if any(similar(s, x) for x in seen):
                out[d, t].append(i)
            seen.append(s)
    return out


def short_rows():
    again = ["All rights reserved.", "  all rights\treserved. ", "reserved. rights all", "one", "One", "two two", "two", "a b c d", "a b c d e", "", " "]
    return line_rows() + [(500 + i, "\n".join(again[i % 3 :])) for i in range(6)] + [(600, "all rights reserved."), (601, "a b c d")]


@pytest.mark.parametrize("limits", [{}, {"SALT": 2, "COMMON": 20}])
def test_copies_of_short_lines_go(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows = short_rows()
    want = restated_short(rows)
    docs = frame(spark, rows)
    assert want[600, "all rights reserved."] == [0] and want[505, short_rows()[-3][1]]
    got = [(r.doc_id, r.n_removed, list(r.removed)) for r in line_dedup.line_counts(docs, short=True).collect()]
    assert sorted(got) == sorted((d, len(want[d, t or ""]), want[d, t or ""]) for d, t in rows)
    left = {r.doc_id for r in line_dedup.dedup(docs, emptied=False, short=True).collect()}
    assert not left & {600, 601} and 500 in left


def test_pairs_are_judged_once(spark, monkeypatch):
    judged, real = [], line_dedup.matches

    def record(pairs, *rest):
        judged.append(sorted(map(tuple, pairs.collect())))
        return real(pairs, *rest)

    monkeypatch.setattr(line_dedup, "matches", record)
    monkeypatch.setattr(line_dedup, "_may_match", lambda similarity: F.lit(True))
    shared = " ".join(f"w{i}" for i in range(12))
    docs = frame(spark, [(1, shared + " one two"), (2, shared + " three four")])
    assert [list(r.removed) for r in line_dedup.line_counts(docs).collect()] == [[], []]
    assert len(judged[0]) == 1 and judged[1] == []


def test_queries_remove_copies_of_short_lines(spark, tmp_path):
    import corpus_pipeline
    from burstlens.llm.queries import op3_line_dedup

    docs = spark.createDataFrame([(1, "all rights reserved."), (2, "x\nAll rights reserved."), (3, "all rights reserved.")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.removed for r in op3_line_dedup(spark, str(tmp_path)).collect()} == {1: [], 2: [1], 3: [0]}
    assert {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()} == {1: "all rights reserved.", 2: "x"}
