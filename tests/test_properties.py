"""Operators against plain definitions on random input, cut and uncut."""

import random

import pytest
from pyspark.sql import functions as F

from burstlens.operators import addresses, bursts, queries, stats
from burstlens.operators.scan import assign_slices, plan_slices, scan, sliced_scan
from burstlens.sources import captures


def hot_packets(seed, n=600):
    """Packets of nine flows; flow 0 has a third of them, with many ties."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rng.random() < 0.34 else rng.randrange(1, 9)
        rows.append((k, rng.choice([rng.randrange(0, 400), rng.randrange(0, 40)]), i, rng.choice([None, rng.randrange(0, 1500)])))
    return rows


def plain_bursts(rows, gap):
    out = {}
    for k in {r[0] for r in rows}:
        flow = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        number, last = 0, None
        for _, ts, _, size in flow:
            if last is None or ts - last > gap:
                number += 1
                out[(k, number)] = [ts, ts, 0, 0, []]
            b = out[(k, number)]
            if b[2]:
                b[4].append(ts - last)
            b[1], b[2], b[3] = ts, b[2] + 1, b[3] + (size or 0)
            last = ts
    return {k: tuple(v[:4]) + (tuple(v[4]),) for k, v in out.items()}


@pytest.mark.parametrize("seed,target", [(1, 10**6), (1, 40), (2, 25), (3, 100)])
def test_bursts(spark, seed, target):
    rows = hot_packets(seed)
    df = spark.createDataFrame(rows, "k int, ts long, ord int, length int").repartition(7)
    b = bursts.with_bursts(df, key=["k"], order=["ord"], gap=2, target_rows=target)
    f = {(r.k, r.flowlet_id): (r.start_ts, r.end_ts, r.packet_count, r.total_bytes)
         for r in bursts.burst_features(b, key=["k"]).collect()}
    s = bursts.burst_sequences(b, key=["k"], order=["ord"], target_rows=target).collect()
    gaps = {(r.k, r.flowlet_id): tuple(int(g) for g in r.inter_packet_times) for r in s}
    assert {k: v + (gaps[k],) for k, v in f.items()} == plain_bursts(rows, 2)


@pytest.mark.parametrize("target,keep", [(10**6, False), (30, False), (30, True)])
def test_steps(spark, target, keep):
    rows = hot_packets(5)
    df = spark.createDataFrame(rows, "k int, ts long, ord int, length int")
    b = bursts.with_bursts(df, key=["k"], order=["ord"], gap=2, target_rows=target, keep_slices=keep)
    state = F.when(F.col("gap").isNotNull(), F.concat(F.lit("g"), F.col("gap").cast("string")))
    st = bursts.packet_steps(b, key=["k"], order=["ord"], gap_state=state, target_rows=target)
    got = sorted((r.k, r.flowlet_id, r.attr, r.prev_state or "", r.state, r.is_first, r.is_last) for r in st.collect())
    want = []
    plain = {}
    for k in {r[0] for r in rows}:
        last = None
        for _, ts, _, size in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if last is None or ts - last > 2:
                plain.setdefault(k, []).append(([], []))
            else:
                plain[k][-1][1].append(f"g{ts - last}")
            plain[k][-1][0].append(str(size or 0))
            last = ts
    for k, bs in plain.items():
        for n, pair in enumerate(bs, 1):
            for attr, seq in zip(("size_block", "time_gap"), pair):
                for i, x in enumerate(seq):
                    want.append((k, n, attr, seq[i - 1] if i else "", x, i == 0, i == len(seq) - 1))
    assert got == sorted(want)


@pytest.mark.parametrize("order,target", [(["row"], 10**6), (["row"], 60), (["block", "row"], 0)])
def test_line_pairing(spark, order, target):
    """Per file, in slices of a file, and block by block."""
    rng = random.Random(target)
    files = {f"f{i}": [rng.random() < rng.choice([0.2, 0.5, 0.9]) for _ in range(120)] for i in range(6)}
    rows = [(f, i // 9 * 100, i, ("00:00:01.5 IP " if clock else "   a ") + str(i)) for f, kinds in files.items() for i, clock in enumerate(kinds)]
    df = spark.createDataFrame(rows, "source_file string, block long, row long, value string").repartition(5)
    got = captures.pair_lines(df, order=order, target_rows=target)
    want = set()
    for f, kinds in files.items():
        i = 0
        while i < len(kinds):
            if kinds[i]:
                want.add((f, i, i + 1 if i + 1 < len(kinds) else None))
                i += 1
            i += 1
    number = F.regexp_extract("address", r"(\d+)$", 1).try_cast("int")
    assert {tuple(r) for r in got.select("source_file", "row", number).collect()} == want


@pytest.mark.parametrize("scoped,target", [(True, 10**6), (True, 15), (False, 10**6), (False, 40)])
def test_query_pairing(spark, scoped, target):
    rng = random.Random(11)
    rows = []
    for s in range(6):
        for i in range(rng.choice([3, 20, 70])):
            start = rng.randrange(0, 60)
            rows.append((s, i, rng.choice("ur"), start, start + rng.randrange(0, 6), rng.randrange(100)))
    df = spark.createDataFrame(rows, "s int, i int, kind string, start_ts int, end_ts int, total_bytes int").repartition(4)
    scope = ["s"] if scoped else []
    p = queries.pair_queries(df, scope=scope, upload=F.col("kind") == "u", response=F.col("kind") == "r",
                             order=["s", "i"], target_rows=target)
    got = {(r.s, r.i): (r.query_id, r.query_role) for r in p.collect()}
    want = {(r[0], r[1]): (None, None) for r in rows}
    for group in ({r[0] for r in rows} if scoped else {None}):
        mine = sorted((r for r in rows if group is None or r[0] == group), key=lambda r: (r[3], r[0], r[1]))
        ups, downs = [r for r in mine if r[2] == "u"], [r for r in mine if r[2] == "r"]
        for n, u in enumerate(ups, 1):
            after = ups[n][3] if n < len(ups) else None
            want[(u[0], u[1])] = (n, "upload")
            for d in downs:
                if d[3] >= u[4] and (after is None or d[3] < after):
                    want[(d[0], d[1])] = (n, "response")
    assert got == want


@pytest.mark.parametrize("target", [10**6, 20])
def test_rank_statistic(spark, target):
    rng = random.Random(target)
    rows = [(int(rng.random() < 0.4), float(rng.randrange(0, 50)), rng.expovariate(1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, a double, b double")
    got = {r.feature: r for r in stats.class_stats(df, ["a", "b"], label="label", target_rows=target).collect()}
    for col, name in ((1, "a"), (2, "b")):
        one = [r[col] for r in rows if r[0] == 1]
        zero = [r[col] for r in rows if r[0] == 0]
        u = sum((x > y) + 0.5 * (x == y) for x in one for y in zero)
        assert got[name].mann_whitney_u == pytest.approx(u)
        half = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
        assert (got[name].llm_median, got[name].non_llm_median) == (half(one), half(zero))


def test_scan_carries_nulls_over_slices(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, None, None, i])) for k in (0, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(6)
    what = {"lag": {"a": F.col("v")}, "lead": {"b": F.col("v")}, "running": {"c": F.col("v")}, "carry": {"d": F.col("v")}}
    whole = sliced_scan(df, ["k"], ["i"], **what)
    cut = sliced_scan(df, ["k"], ["i"], target_rows=20, **what)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, cut.collect()), key=repr)


def test_slices_are_bounded_for_a_key_with_a_third_of_the_rows(spark):
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        # Most of the hot key's rows fall into a narrow stretch of time.
        F.when(F.col("id") % 10 < 8, F.col("id") / n).otherwise(F.col("id") * 1.0).alias("t"), "id")
    plan = plan_slices(df, ["k"], "t", target_rows=1_000)
    assert [r["k"] for r in plan.hot.collect()] == [0]
    cut = assign_slices(df, ["k"], "t", plan)
    assert cut.groupBy("k", "_slice").count().agg(F.max("count")).first()[0] <= 1_100
    numbered = scan(cut, ["k"], ["t", "id"], running={"n": F.lit(1)})
    assert numbered.where("k = 0").agg(F.max("n"), F.countDistinct("n")).first() == (10_000, 10_000)


def _numbered(df, key, by, order, rows):
    """Largest slice, and wrong numbers, of a numbering with slices of about ``rows``."""
    cut = assign_slices(df, key, by, plan_slices(df, key, by, target_rows=rows))
    assert "_slice" in cut.columns
    largest = cut.groupBy(*key, "_slice").count().agg(F.max("count")).first()[0]
    whole = scan(df, key, order, running={"n": F.lit(1)}, lag={"p": F.col(order[-1])}, lead={"q": F.col(order[-1])})
    parts = sliced_scan(df, key, order, target_rows=rows, running={"n": F.lit(1)}, lag={"p": F.col(order[-1])}, lead={"q": F.col(order[-1])})
    return largest, whole.exceptAll(parts).count() + parts.exceptAll(whole).count()


def test_thousands_of_busy_keys_are_all_cut(spark):
    df = spark.range(40_000).select((F.col("id") % 2_000).alias("k"), "id")
    largest, wrong = _numbered(df, ["k"], ["id"], ["id"], 10)
    assert largest <= 10 and wrong == 0


def test_null_key_with_most_rows_is_cut(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), "id")
    largest, wrong = _numbered(df, ["k"], ["id"], ["id"], 500)
    assert largest <= 600 and wrong == 0


def test_constant_first_column_is_passed_over(spark):
    df = spark.range(10_000).select(F.lit(0).alias("zero"), "id")
    largest, wrong = _numbered(df, [], ["zero", "id"], ["zero", "id"], 500)
    assert largest <= 600 and wrong == 0


def test_text_order_is_cut_at_any_size(spark):
    df = spark.range(5_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 50 > 0, F.format_string("%05d-é", "id")).alias("t"), "id")
    largest, wrong = _numbered(df, ["k"], ["t", "id"], ["t", "id"], 200)
    assert largest <= 300 and wrong == 0
    bad = df.select("k", F.array("id").alias("t"))
    with pytest.raises(TypeError):
        plan_slices(bad, ["k"], "t")


def test_numbering_over_everything_is_sliced(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("x"))
    got = sliced_scan(df, [], ["x"], target_rows=500, running={"n": F.lit(1)})
    assert got.where("n <> x + 1").count() == 0


def test_target_streams(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(6), i, rng.random() < 0.05) for i in range(300)]
    df = spark.createDataFrame(rows, "stream int, ord int, hit boolean").repartition(5)
    got = addresses.target_streams(df, stream="stream", order="ord", hit=F.col("hit"))
    seen, want = set(), set()
    for s, o, h in rows:
        first = h and s not in seen
        seen |= {s} if h else set()
        if s in seen:
            want.add((s, o, first))
    assert {(r.stream, r.ord, r.is_first_hit) for r in got.collect()} == want
