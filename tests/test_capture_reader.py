"""Captures read by byte ranges: any cut gives the packets of the whole file; no exchange; files chosen by name."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burstlens.sources import capture_reader as cr
from burstlens.sources import captures

CLOCK = b"00:00:0%d.5 IP (proto TCP (6), length 41)"
ADDRESS = b"    10.0.0.1.%d > 8.8.8.8.443: Flags [.], length 7"


def whole(data, strict):
    """The packets of a file, read whole."""
    at, lines = 0, []
    for m in re.finditer(rb"\r\n|\n|\r|\Z", data):
        if m.group() or m.start() > at or (not m.group() and at < m.start()):
            lines.append((at, data[at : m.start()]))
        at = m.end()
    if lines and lines[0][1].startswith(cr.BOM):
        lines[0] = (0, lines[0][1][3:])
    out, taken = [], False
    for i, (offset, line) in enumerate(lines):
        after = lines[i + 1][1] if i + 1 < len(lines) else None
        clock = cr.is_clock(line)
        if strict:
            if clock:
                out.append((offset, line, None if after is not None and cr.is_clock(after) else after))
        elif taken:
            taken = False
        elif clock:
            out.append((offset, line, after))
            taken = True
    return out


def made(r, n):
    out = b""
    for _ in range(n):
        kind = r.random()
        line = CLOCK % r.randrange(10) if kind < 0.55 else ADDRESS % r.randrange(90) if kind < 0.8 else r.choice([b"", b"x" * r.randrange(60), b"\xff\xfe", "é > ü".encode()])
        out += line + r.choice([b"\n", b"\n", b"\r\n", b"\r"])
    return (cr.BOM if r.random() < 0.2 else b"") + (out if r.random() < 0.5 else out.rstrip(b"\r\n"))


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_gives_the_packets_of_the_file(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(cr, "CHUNK", r.choice([1, 2, 7, 64, 1 << 20]))
    monkeypatch.setattr(cr, "BACK", r.choice([1, 5, 50, 4096]))
    data = made(r, r.randrange(0, 40))
    for strict in (False, True):
        want = whole(data, strict)
        for size in (1, 2, 3, r.randrange(4, 200), len(data) + 1):
            got = []
            for a in range(0, len(data), size):
                got += cr.pairs_in(pa.BufferReader(data), a, min(a + size, len(data)), strict)
            assert got == want, (seed, strict, size)


def test_a_long_run_of_clock_lines_and_a_long_line():
    line = CLOCK % 1 + b"\n"
    data = line * 20_001 + b"y" * 300_000 + b"\n" + line
    got = [p for a in range(0, len(data), 50_000) for p in cr.pairs_in(pa.BufferReader(data), a, min(a + 50_000, len(data)), False)]
    assert len(got) == 10_002 and got[-2][2] == b"y" * 300_000 and got[-1][2] is None


def test_clock_lines():
    assert cr.is_clock(b"00:00:01.5 ip6 (x") and cr.is_clock(b"00:00:01.5 \t IP") and cr.is_clock("00:00:01.5 IP—".encode())
    for no in (b" 00:00:01.5 IP", b"00:00:01 IP", b"00:00:01.5 IPX", b"00:00:01.5 IP66", "00:00:01.5 IPé".encode(), b""):
        assert not cr.is_clock(no)


def store(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_equals_the_line_reader_without_exchange(spark, tmp_path):
    r = random.Random(3)
    for i in range(4):
        store(str(tmp_path / f"d{i % 2}" / f"capture_{i}.txt"), made(r, 60))
    store(str(tmp_path / "d0" / "capture_9.txt"), b"")
    store(str(tmp_path / "d0" / "other.txt"), made(r, 9))
    store(str(tmp_path / "d0" / ".capture_h.txt"), made(r, 9))
    columns = ["source_file", "ts", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "length", "length_source", "raw"]
    for strict in (False, True):
        want = captures.parse_packets(captures.read_lines(spark, str(tmp_path), recursive=True), strict=strict)
        pairs = cr.read_pairs(spark, str(tmp_path), recursive=True, strict=strict, range_bytes=200)
        got = captures.parse_pairs(pairs)
        assert rows(got.select(columns)) == rows(want.select(columns)) and got.count() > 20
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        # Offsets order the packets as lines do.
        at = [x["line1"] for x in got.orderBy("source_file", "block", "row").select("raw.line1").collect()]
        assert at == [x["line1"] for x in want.orderBy("source_file", "block", "row").select("raw.line1").collect()]


def test_small_ranges_share_tasks(spark, tmp_path):
    data = (CLOCK % 1 + b"\n" + ADDRESS % 5 + b"\n") * 400
    store(str(tmp_path / "capture_1.txt"), data)
    pairs = cr.read_pairs(spark, str(tmp_path), range_bytes=100)
    assert pairs.rdd.getNumPartitions() == 1 and pairs.count() == 400 and pairs.select("block").distinct().count() > 100
    few = cr.read_pairs(spark, str(tmp_path), range_bytes=100, task_bytes=len(data) // 4)
    assert 4 <= few.rdd.getNumPartitions() <= 6 and rows(few) == rows(pairs)


def test_files_chosen_by_name(spark, tmp_path):
    for i in range(5):
        store(str(tmp_path / f"capture_{i}.txt"), CLOCK % i + b"\n" + ADDRESS % i)
    reader = cr.FilteringReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([cr.EqualTo(("source_file",), f"{tmp_path}/capture_3.txt"), cr.EqualTo(("row",), 0)]))
    assert [f.attribute for f in left] == [("row",)]
    assert [n for t in reader.partitions() for n, *_ in t.ranges] == [f"{tmp_path}/capture_3.txt"]
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = cr.read_pairs(spark, str(tmp_path)).where(F.col("source_file").isin(f"{tmp_path}/capture_1.txt", f"{tmp_path}/capture_2.txt"))
        assert df.count() == 2 and df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_headers_are_the_leading_lines(spark, tmp_path):
    store(str(tmp_path / "capture_a.txt"), b"LLM_IP A 1.1.1.1.\n\n  llm_ip B 2.2.2.2\r\nLLM_IP C 1.1.1.1\n00:00:01.5 IP (x\nLLM_IP D 3.3.3.3\n")
    store(str(tmp_path / "capture_b.txt"), b"# none\nLLM_IP E 4.4.4.4\n")
    store(str(tmp_path / "capture_c.txt"), cr.BOM + b"LLM_IP F 5.5.5.5")
    want = captures.read_headers(captures.read_lines(spark, str(tmp_path)))
    got = captures.header_map(cr.read_header_lines(spark, str(tmp_path)))
    assert rows(got) == rows(want) and {x[1:] for x in rows(got)} == {("1.1.1.1", "C"), ("2.2.2.2", "B"), ("5.5.5.5", "F")}
    with pytest.raises(Exception, match="no files matched"):
        cr.read_pairs(spark, str(tmp_path), glob="x*").count()
