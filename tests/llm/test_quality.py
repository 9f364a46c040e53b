import re

from helpers import SPACED, edge_rows, frame

from burstlens.llm import quality


def restated(text):
    t = text or ""
    w = SPACED.findall(t)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = {}
    for x in wins:
        times[x] = times.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(wins) if times[x] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures(spark):
    rows = edge_rows() + [(90, "a b c d e f g h " * 30), (91, "# | x\n# | x\n" * 9), (92, "a b c d e f g h i\n" * 2 + "p q")]
    got = quality.ledger(frame(spark, rows)).collect()
    want = sorted((d is not None, d or 0, restated(t)) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r[m] for m in quality.MEASURES)) for r in got) == want


def test_policies_and_ablations(spark):
    rows = quality.ledger(frame(spark, edge_rows())).cache()
    failed = [r.failed for r in rows.collect()]
    for policy in (quality.BASE, quality.CURRENT):
        assert rows.where(quality.rejected(policy)).count() == sum(bool(f & policy.mask) for f in failed)
        for r in quality.ablations(rows, policy).collect():
            bit = quality.BIT[r.rule]
            assert r.fails == sum(bool(f & bit) for f in failed)
            assert r.only == sum(f & policy.mask == bit for f in failed)
            assert r.kept_without == sum(not f & policy.mask & ~bit for f in failed)


def test_accepted_keeps_all_columns(spark):
    docs = frame(spark, edge_rows())
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns
    good = quality.ledger(docs).where(~quality.rejected(quality.CURRENT)).count()
    assert kept.count() == good and quality.accepted(docs.limit(0)).count() == 0
