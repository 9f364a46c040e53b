"""Networks by longest prefix, stored pages, the exact rank test, and step counts that captures join and leave."""

import ipaddress
import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from burstlens.operators import markov, networks, pages, stats
from burstlens.plans import training
from burstlens.session import scratch_path


def random_networks(r):
    out = []
    for i in range(60):
        if r.random() < 0.6:
            out.append((f"10.{r.randrange(3)}.{r.randrange(4)}.{r.randrange(256)}/{r.choice([0, 8, 15, 16, 22, 24, 25, 30, 31, 32])}", f"n{i}"))
        else:
            out.append((f"2001:db8:{r.randrange(3):x}::{r.randrange(65536):x}/{r.choice([16, 33, 46, 48, 111, 112, 125, 128])}", f"n{i}"))
    return out + [("10.0.0.1", "host"), ("::/0", "any"), ("10.0.0.0/33", "bad"), ("x/8", "bad"), (None, "bad"), ("255.255.255.255/32", "last"), ("255.255.255.254/31", "last two")]


def narrowest(ip, nets):
    try:
        at = ipaddress.ip_address(ip)
    except ValueError:
        return None, None
    held = {}
    for cidr, name in nets:
        try:
            n = ipaddress.ip_network(cidr, strict=False)
        except ValueError:
            continue
        if at.version == n.version and at in n:
            held.setdefault(n.prefixlen, []).append(name)
    return (min(held[max(held)]), max(held)) if held else (None, None)


@pytest.mark.parametrize("target", [2_000_000, 40])
def test_networks(spark, target):
    r = random.Random(3)
    nets = random_networks(r)
    ips = [f"10.{r.randrange(4)}.{r.randrange(5)}.{r.randrange(256)}" for _ in range(150)] + [f"2001:db8:{r.randrange(4):x}::{r.randrange(65536):x}" for _ in range(100)]
    ips += ["10.0.0.1", "255.255.255.255", "0.0.0.0", "::", "ffff::1", "nonsense", "", ips[0], ips[0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ips)] + [(999, None)], "id int, ip string")
    table = spark.createDataFrame(nets, "cidr string, name string")
    got = {x.id: (x.network, x.prefix_length) for x in networks.match_networks(df, table, ip="ip", target_rows=target).collect()}
    assert got == {i: narrowest(x, [n for n in nets if n[0]]) for i, x in enumerate(ips)} | {999: (None, None)}
    assert {x.network for x in networks.match_networks(df, table.limit(0), ip="ip").collect()} == {None}


def test_pages_read_two_parts(spark, monkeypatch):
    monkeypatch.setattr(pages, "ROWS_A_RANGE", 90)
    rows = spark.range(1003).select("id", (F.col("id") * 7919 % 101).alias("at"), F.lit("x").alias("part_name"))
    path, order = scratch_path(spark, "pages"), ["at", "id"]
    pages.write_pages(rows.repartition(7), path, order=order, page_rows=50)
    want = [r.id for r in rows.orderBy(*order).collect()]
    for skip, limit in ((0, 50), (130, 50), (975, 50), (2000, 50), (40, 3), (0, 0)):
        one = pages.page(spark, path, skip=skip, limit=limit)
        assert [r.id for r in one.orderBy(*order).collect()] == want[skip : skip + limit]
        assert len({f.split("part=")[1].split("/")[0] for f in [x[0] for x in one.select(F.input_file_name()).distinct().collect()]}) <= 2
    seen, cursor = [], None
    while True:
        part = pages.after(spark, path, cursor, order=order, limit=301).collect()
        if not part:
            break
        seen += [r.id for r in part]
        cursor = part[-1]
    assert seen == want
    sizes = [r.n for r in pages.directory(spark, path).orderBy("part").collect()]
    assert sizes == [50] * 20 + [3]
    empty = scratch_path(spark, "pages")
    pages.write_pages(rows.limit(0), empty, order=order)
    assert pages.page(spark, empty).count() == 0 and pages.after(spark, empty, None, order=order).count() == 0


def test_folders_of_pages_grow_with_rows(spark, monkeypatch):
    """Pages of two rows share folders; a page reads one or two of them."""
    monkeypatch.setattr(pages, "ROWS_A_FOLDER", 40)
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    path, order = scratch_path(spark, "pages"), ["k", "id"]
    pages.write_pages(rows, path, order=order, page_rows=2)
    assert len({f.split("part=")[1].split("/")[0] for f in spark.read.parquet(f"{path}/rows").inputFiles()}) == 3
    want = [r.id for r in rows.orderBy(*order).collect()]
    assert [r.id for r in pages.page(spark, path, skip=38, limit=5).orderBy(*order).collect()] == want[38:43]
    assert [r.id for r in pages.after(spark, path, rows.where(f"id = {want[37]}").first(), order=order, limit=5).collect()] == want[38:43]
    assert pages.directory(spark, path).count() == 50


def enumerated(n1, n0):
    return Counter(sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n0), n1))


def test_u_distribution():
    for n1 in range(1, 7):
        for n0 in range(1, 7):
            assert dict(enumerate(stats.u_distribution(n1, n0))) == {u: enumerated(n1, n0)[u] for u in range(n1 * n0 + 1)}
    ways = stats.u_distribution(3, 500)
    assert sum(ways) == math.comb(503, 3) and ways == ways[::-1]


def test_rank_tests(spark):
    r, rows, want = random.Random(5), [], {}
    for g in range(25):
        n1, n0 = r.randint(0, 7), r.randint(0, 7)
        values = r.sample(range(1000), n1 + n0)
        rows += [(g, float(v), int(i < n1)) for i, v in enumerate(values)]
        if n1 and n0:
            u = sum(a > b for a in values[:n1] for b in values[n1:])
            ways = enumerated(n1, n0)
            want[g] = (n1, n0, u, min(1.0, 2 * sum(k for x, k in ways.items() if x >= max(u, n1 * n0 - u)) / sum(ways.values())))
    rows += [(77, 1.0, 1), (77, 1.0, 0), (77, 2.0, 1), (78, None, 1), (78, 1.0, 0)] + [(79, float(i), int(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, v double, y int")
    got = {x.g: x for x in stats.rank_tests(df, ["g"], value="v", label="y").collect()}
    normal = {x.g: x for x in stats.rank_tests(df, ["g"], value="v", label="y", exact=False).collect()}
    assert set(got) == {*want, 77, 79}
    for g, (n1, n0, u, p) in want.items():
        assert (got[g].n1, got[g].n0, got[g].u) == (n1, n0, u) and got[g].p_value == pytest.approx(p, abs=1e-12)
    assert got[77].p_value == normal[77].p_value and got[79].p_value == normal[79].p_value
    whole = stats.class_stats(df.where("g = 0").select("v", "y"), ["v"], label="y").collect()
    assert whole[0].p_value == pytest.approx(want[0][3]) if 0 in want else True


def test_stored_counts_follow_captures(spark):
    r = random.Random(9)
    steps = [(c, s, "ab"[c % 2], "size_block", str(r.randrange(3)), None if k == 0 else str(r.randrange(3)), k == 0, k == 5) for c in range(6) for s in range(8) for k in range(6)]
    table = spark.createDataFrame(steps, "capture_id int, seq int, cls string, attr string, state string, prev_state string, is_first boolean, is_last boolean")
    of = lambda *ids: table.where(F.col("capture_id").isin(*ids))
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "capture_id int")
    kept = training.StoredCounts(spark, scratch_path(spark, "counts"), cls="cls", capture="capture_id")
    with pytest.raises(ValueError):
        kept.apply(0, deleted=gone(1))
    present = lambda total, *ids: sorted(map(str, total.collect())) == sorted(map(str, markov.step_counts(of(*ids), by=["cls"]).select(total.columns).collect()))
    assert present(kept.apply(0, added=of(0, 1, 2)), 0, 1, 2)
    assert present(kept.apply(1, added=of(3, 4), deleted=gone(1, 9)), 0, 2, 3, 4)
    assert present(kept.apply(2, deleted=gone(0, 0, 3)), 2, 4)
    assert present(kept.apply(3, added=of(0, 5), deleted=gone(4)), 0, 2, 5)
    assert present(kept.apply(3, added=of(0, 5), deleted=gone(4)), 0, 2, 5)  # run again
    assert present(kept.apply(4, added=of(0), deleted=gone(0)), 0, 2, 5)  # read once more
    got, want = kept.fit(4), training.fit_fingerprints(of(0, 2, 5), cls="cls")
    for name in ("blocks", "transitions", "ends"):
        assert sorted(map(str, got[name].select(want[name].columns).collect())) == sorted(map(str, want[name].collect()))
