"""Files: scans, the sample capture, sinks, artefacts."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from burstlens.functions import capture_text as ct
from burstlens.operators import documents, models, store
from burstlens.plans import ingest, summary, training
from burstlens.schemas import RECORD_20
from burstlens.session import scratch_path
from burstlens.sources import captures, sinks, tables

# Folder with the sample capture whose counts FIXTURES.md lists.
SAMPLE = os.environ.get("SAMPLE_CAPTURES")
PACKET = "00:00:0{0}.500000 IP (proto TCP (6), length 41)\n    10.0.0.1.{1} > 8.8.8.8.443: Flags [.], length {0}\n"


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


@pytest.fixture
def capture(tmp_path):
    """A capture of six flows with bursts, answers and a line that is no packet."""
    rng = random.Random(6)
    out, t = ["# No LLM traffic detected.", "", "noise > line"], 60.0
    for _ in range(150):
        t += rng.choice([0.01, 0.03, 0.3])
        port, server = 50000 + rng.randrange(3), rng.choice(["8.8.8.8.443", "1.1.1.1.53"])
        ends = [f"10.0.0.5.{port}", server]
        if rng.random() < 0.6:
            ends.reverse()
        out.append(f"00:{int(t // 60):02d}:{t % 60:09.6f} IP (flags [0x02], proto TCP (6), length 41)")
        out.append(f"    {ends[0]} > {ends[1]}: Flags [.], length {rng.randrange(1400)}")
    write(str(tmp_path / "capture_20250101_000000.txt"), "\n".join(out) + "\n")
    return str(tmp_path)


@pytest.mark.skipif(not SAMPLE, reason="SAMPLE_CAPTURES names no folder")
def test_sample_capture(spark):
    lines = captures.read_lines(spark, SAMPLE)
    p = captures.parse_packets(lines)
    assert p.agg(F.count("*"), F.sum("length"), F.min("ts"), F.max("ts")).first() == (84, 8267, 678.238775, 687.427513)
    kinds = {r.protocol: (r.n, r.b) for r in p.groupBy("protocol").agg(F.count("*").alias("n"), F.sum("length").alias("b")).collect()}
    assert kinds == {"TCP": (75, 6931), "PROTO": (9, 1336)}
    for both, flows, count in ((False, 47, 53), (True, 26, 31)):
        s = summary.capture_summary(spark, SAMPLE, bidirectional=both)
        assert (s["flows"].count(), s["flowlets"].count(), s["events"].count()) == (flows, count, count)
    top = summary.capture_summary(spark, SAMPLE)["flows"].orderBy(F.desc("bytes")).first()
    assert (top.src_ip, top.src_port, top.dst_ip, top.dst_port, top.packets, top.bytes) == (
        "172.253.115.94", 443, "192.168.4.68", 51309, 12, 3110)
    assert captures.read_headers(lines).count() == 0


def test_summary_of_a_capture(spark, capture):
    with open(f"{capture}/capture_20250101_000000.txt") as f:
        text = f.read().split("\n")[3:-1]
    flows = {}
    for clock, address in zip(text[::2], text[1::2]):
        src, dst = address.split(":")[0].split(" > ")
        ts = int(clock[:2]) * 3600 + int(clock[3:5]) * 60 + float(clock[6:15])
        flows.setdefault((src.strip(), dst.strip()), []).append((ts, int(address.rsplit(" ", 1)[1])))
    want = {}
    for ends, packets in flows.items():
        packets.sort(key=lambda p: p[0])
        count = 1 + sum(b[0] - a[0] > 0.1 for a, b in zip(packets, packets[1:]))
        want[ends] = (len(packets), sum(p[1] for p in packets), count)
    s = summary.capture_summary(spark, capture)
    got = {(f"{r.src_ip}.{r.src_port}", f"{r.dst_ip}.{r.dst_port}"): (r.packets, r.bytes, r.flowlets) for r in s["flows"].collect()}
    assert got == want
    assert s["events"].count() == s["flowlets"].count() == sum(v[2] for v in want.values())


def test_whole_timeline_equals_one_file(spark, capture):
    a = summary.capture_summary(spark, capture)["queries"].drop("source_file")
    b = summary.capture_summary(spark, capture, per_file=False)["queries"]
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_summary_as_json(spark, capture):
    path = scratch_path(spark, "summary")
    tables_ = summary.capture_summary(spark, capture)
    summary.write_summary(tables_, path)
    bursts_ = tables_["flowlets"].count()
    flows = spark.read.json(f"{path}/flows")
    assert flows.count() == tables_["flows"].count() and flows.select(F.explode("flowlets")).count() == bursts_
    found = spark.read.json(f"{path}/queries")
    answered = found.where("confidence = 'high'")
    assert found.count() == tables_["queries"].count() > 0 and answered.count() > 0
    assert answered.where(F.size("response_flowlets") != F.col("responses")).count() == 0
    assert spark.read.json(f"{path}/events").count() == bursts_


def test_capture_registry(spark):
    have = spark.createDataFrame([(4, "d/a")], "id long, file_path string")
    files = spark.createDataFrame([("d/c",), ("d/a",), ("d/b",)], "file_path string")
    maps = spark.createDataFrame([("d/c", {"1.1.1.1": "A"})], "file_path string, llm_ip_map map<string,string>")
    rows = store.register_captures(files, have, created_at=F.lit("2025-01-01"), maps=maps).orderBy("id").collect()
    assert [(r.id, r.file_path, r.llm_ip_map) for r in rows] == [(5, "d/b", {}), (6, "d/c", {"1.1.1.1": "A"})]
    assert store.require_capture(have, 4).count() == 1
    with pytest.raises(LookupError):
        store.require_capture(have, 5)


def test_training_run_of_a_provider(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        llm = i % 2 == 0
        sizes = [rng.choice([1200, 1300]) if llm else rng.choice([60, 70, 80]) for _ in range(rng.randrange(1, 6))]
        rows.append((f"u{i % 40}", i, "caps/ChatGPT/x" if llm else "caps/all/x", "llm" if llm else "non_llm", sizes, [0.05] * (len(sizes) - 1),
                     float(len(sizes)), len(sizes), sum(sizes)))
    rows.append(("u99", 999, "caps/claude/x", "llm", [5], [], 0.0, 1, 5))
    f = spark.createDataFrame(rows, "g string, i int, source_file string, traffic_class string, packet_sizes array<int>, "
                              "inter_packet_times array<double>, duration double, packet_count long, total_bytes long")
    zero = {c: F.lit(0.0) for c in ("inter_packet_time_mean", "inter_packet_time_std", "packet_size_mean", "packet_size_std")}
    f = f.withColumns(zero)
    for fit_on in ("all", "train"):
        run = training.train_provider(
            f, training.array_steps(f, ident=["i"]), provider="chatgpt", ident=["i"], group="g", with_direction=False, fit_on=fit_on,
            estimators={k: v for k, v in models.estimators(11, trees=5).items() if k != "boosted_trees"})
        assert run["split"].count() == 240
        assert {r.model: r.f1 for r in run["metrics"].collect()} == {"random_forest": 1.0, "svm": 1.0}
        test_groups = run["split"].where("is_test").select("g").distinct().count()
        assert test_groups == 8
    with pytest.raises(ValueError):
        training.train_provider(f, f, provider="x", ident=["i"], group="g", estimators={}, fit_on="none")


def test_written_captures_keep_order_and_header(spark):
    rec = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "busy").otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("capture"), "id",
        (F.col("id") / 10).cast("string").alias("epoch"), F.lit("10.0.0.1").alias("src"), F.lit("8.8.8.8").alias("dst"),
        (F.col("id") + 1).cast("string").alias("sport"), F.lit("443").alias("dport"), F.lit("6").alias("proto"),
        F.col("id").cast("string").alias("tcp_len"))
    rec = rec.withColumns({n: F.lit("") for n in RECORD_20 if n not in rec.columns})
    ip_map = spark.createDataFrame([("busy", "8.8.8.8", "A"), ("busy", "9.9.9.9", "B")], "capture string, ip string, name string")
    heads = sinks.header_lines(ip_map, rec.select("capture"), capture="capture")
    text = sinks.capture_text(sinks.record_lines(rec, capture="capture", order=["id"]), heads, capture="capture", order="id")
    path = scratch_path(spark, "captures")
    # Small partitions would be merged into one; a large capture's are not.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_captures(text, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = captures.read_lines(spark, path, glob="*.txt", recursive=True)
    folder = lines.withColumn("capture", F.regexp_extract("source_file", "capture=([^/]+)/", 1))
    whole = folder.where("capture = 'busy'").orderBy("source_file", "block", "row").collect()
    assert [r["value"] for r in whole[:3]] == ["LLM_IP A 8.8.8.8", "LLM_IP B 9.9.9.9", ""]
    # The busy capture is spread over several part files that continue each other.
    assert len({r["source_file"] for r in whole}) > 1
    assert [int(r["value"].split(".")[4].split(" ")[0]) for r in whole[3:] if ">" in r["value"]] == list(range(1, 3001, 3))
    found = captures.read_headers(folder, file="capture", order=["source_file", "block", "row"])
    assert sorted(tuple(r) for r in found.collect()) == [("busy", "8.8.8.8", "A"), ("busy", "9.9.9.9", "B")]
    assert captures.parse_packets(lines).count() == 3000
    assert folder.where("capture = 'c1'").orderBy("source_file", "block", "row").first()["value"] == "# No LLM traffic detected."


def test_missing_files(spark, tmp_path):
    write(str(tmp_path / "other.txt"), "x")
    with pytest.raises(FileNotFoundError):
        captures.read_lines(spark, str(tmp_path))


def test_bytes_that_are_not_text(spark, tmp_path):
    write(str(tmp_path / "capture_1.txt"), b"00:00:01.5 IP \xff\n  1.2.3.4.5 > 6.7.8.9.10: length 3\n", "wb")
    p = captures.parse_packets(captures.read_lines(spark, str(tmp_path))).first()
    assert "�" in p.raw.line1 and (p.src_port, p.dst_ip, p.length) == (5, "6.7.8.9", 3)


def test_large_file_read_in_many_splits(spark, tmp_path):
    text = "".join(PACKET.format(i % 10, 1000 + i % 50000) for i in range(3000))
    write(str(tmp_path / "capture_1.txt"), text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = captures.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        for target in (10**6, 500):
            p = captures.parse_packets(lines, target_rows=target)
            got = p.orderBy("block", "row").select("src_port", "length").collect()
            assert [(r.src_port, r.length) for r in got] == [(1000 + i % 50000, i % 10) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folder_and_path_classes(spark, tmp_path):
    for name in ("chatgpt_ipv4", "all_v6", "unknown"):
        write(str(tmp_path / name / "capture_1.txt"), PACKET.format(1, 5000))
    write(str(tmp_path / "x" / "all_v4" / "capture_1.txt"), PACKET.format(1, 5000))
    f = ingest.flowlets_by_folder(spark, str(tmp_path))
    assert sorted(r.traffic_class for r in f.collect()) == ["llm", "non_llm"]
    assert {r.direction for r in f.collect()} == {"client_to_server"}
    d = ingest.labelled_dataset(spark, str(tmp_path))
    assert sorted(r.traffic_class for r in d["captures"].collect()) == ["llm", "llm", "non_llm", "non_llm"]
    assert tuple(d["totals"].first()) == (4, 4, 4)
    path = scratch_path(spark, "dataset")
    sinks.write_dataset(path, **d)
    assert spark.read.parquet(f"{path}/flows").count() == 4


def test_labels_carry_over_files(spark, tmp_path):
    for i, head in enumerate(["LLM_IP A 8.8.8.8.\n\n", "", "LLM_IP B 8.8.8.8\n"], 1):
        write(str(tmp_path / f"capture_{i}.txt"), head + PACKET.format(i, 5000))
    f = ingest.flowlets_by_address(spark, str(tmp_path)).orderBy("source_file").collect()
    assert [(r.llm_name, r.ground_truth_llm, r.direction_encoded) for r in f] == [("A", "A", 1), ("A", None, 1), ("B", "B", 1)]
    own = ingest.flowlets_by_address(spark, str(tmp_path), carry=False).orderBy("source_file").collect()
    assert [r.llm_name for r in own] == ["A", None, "B"]


def test_newest_file(spark, tmp_path):
    for i, name in enumerate(["hybrid_capture_1.txt", "capture_2.txt", "other.txt"]):
        write(str(tmp_path / name), "x")
        os.utime(tmp_path / name, (time.time() - 100 + i, time.time() - 100 + i))
    got = captures.newest_file(spark, str(tmp_path), ["capture_*.txt", "hybrid_capture_*.txt"]).first()["file_path"]
    assert got.endswith("/capture_2.txt")


def test_flowlet_json_and_dispatch(spark, tmp_path):
    rows = [{"flow_key": {"src_ip": "a", "src_port": 1, "dst_ip": "b", "dst_port": 2, "protocol": "TCP"}, "flowlet_id": 1,
             "traffic_class": "llm", "packet_sizes": [5, 6], "inter_packet_times": [0.5]}]
    write(str(tmp_path / "f.json"), json.dumps(rows))
    f = tables.load_flowlets(spark, str(tmp_path / "f.json"), multi_line=True)
    assert f.first()["flow_key"]["dst_port"] == 2
    steps = training.array_steps(f, ident=["flowlet_id"]).orderBy("attr", "is_last").collect()
    assert [(r.attr, r.state, r.prev_state) for r in steps] == [
        ("size_block", "5", None), ("size_block", "6", "5"), ("time_gap", "GAP_100ms_1s", None)]
    with pytest.raises(ValueError):
        tables.load_flowlets(spark, "x", "csv")


def test_prompt_bank(spark, tmp_path):
    assert tables.read_prompt_bank(spark, str(tmp_path / "none.json"), missing_ok=True).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_prompt_bank(spark, str(tmp_path / "none.json"))
    write(str(tmp_path / "b.json"), json.dumps([{"category": "c", "model": "m", "prompts": ["p", "q"], "chain_length": 2}]))
    assert tables.read_prompt_bank(spark, str(tmp_path / "b.json")).first()["prompts"] == ["p", "q"]
    write(str(tmp_path / "bad.json"), "not json")
    with pytest.raises(Exception):
        tables.read_prompt_bank(spark, str(tmp_path / "bad.json")).collect()


def test_text_columns(spark):
    df = spark.createDataFrame([([1, 2],), (None,)], "a array<int>")
    out = df.select(sinks.as_text(F.col("a")).alias("t")).withColumn("b", sinks.from_text(F.col("t"), "array<int>"))
    assert [tuple(r) for r in out.collect()] == [("[1,2]", [1, 2]), ("[]", [])]
    assert json.loads(sinks.report_json({"x": spark.range(2), "y": spark.range(0)}).first()["value"]) == {"x": [{"id": 0}, {"id": 1}], "y": []}


def test_document_roundtrip(spark):
    f = spark.createDataFrame([("c", i, "llm") for i in range(25)], "cap string, n int, traffic_class string")
    packed = documents.pack_documents(documents.document_rows(f, capture="cap", order=["n"]), capture="cap", max_fields=10)
    assert packed.count() == 3
    listed = documents.list_flowlets(packed, "c", capture="cap").collect()
    assert [r["field"] for r in listed][:2] == ["flowlet_000001", "flowlet_000002"] and len(listed) == 25
    assert documents.list_flowlets(packed, "none", capture="cap").count() == 0


def test_artifacts(spark):
    rows = spark.range(200).select((F.col("id") % 2).cast("int").alias("label"), F.array(F.col("id") % 2 * 1.0, F.rand(1)).alias("a"))
    from pyspark.ml.functions import array_to_vector

    rows = rows.select("label", array_to_vector("a").alias("features"))
    fitted = models.train(rows, models.estimators(2, trees=3, rounds=2))
    path = scratch_path(spark, "artifacts")
    models.save_artifacts(path, fitted, spark.range(1), spark.range(1), feature_dim=2)
    back = models.load_artifacts(spark, path)
    assert back["feature_dim"] == 2
    a = models.probabilities(rows, fitted).agg(*[F.sum(f"p_{n}") for n in fitted]).first()
    b = models.probabilities(rows, back["models"]).agg(*[F.sum(f"p_{n}") for n in fitted]).first()
    assert list(a) == pytest.approx(list(b))
    out = training.annotate(rows, back["models"])
    assert {(r.label, r.model_llm_prediction) for r in out.collect()} == {(0, "non_llm"), (1, "ChatGPT")}
    spark.createDataFrame([('{"parts": ["models"], "models": []}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(KeyError):
        models.load_artifacts(spark, path)


def test_part_files_of_a_folder_are_one_capture(spark, tmp_path):
    """A flow that goes on in the next part file stays one flow; the header of the first part counts for all."""
    name = "part-0000{}-9e0f7d7c-1111-2222-3333-444455556666.c000.txt"
    texts = ["LLM_IP A 8.8.8.8\n\n" + PACKET.format(1, 5000), PACKET.format(1, 5000) + PACKET.format(1, 5001), PACKET.format(1, 5000)]
    for i, text in enumerate(texts):
        write(str(tmp_path / "all_v4" / name.format(i)), text)
    write(str(tmp_path / "all_v4" / "capture_1.txt"), PACKET.format(2, 5000))
    for ranges in (False, True):
        root = str(tmp_path) if ranges else str(tmp_path / "all_v4")
        f = ingest.flowlets_by_address(spark, root, glob="*.txt", carry=False, ranges=ranges).where("source_file like '%/part'").collect()
        assert sorted((r.packet_count, r.llm_name) for r in f) == [(1, "A"), (3, "A")]
    d = ingest.labelled_dataset(spark, str(tmp_path))
    assert sorted((r.flows_count, r.flowlets_count, r.packets) for r in d["captures"].collect()) == [(1, 1, 1), (2, 2, 4)]
    assert ingest.flowlets_by_folder(spark, str(tmp_path), glob="*.txt").count() == 3
    t = summary.capture_summary(spark, str(tmp_path / "all_v4"), glob="*.txt")
    assert t["flows"].count() == 3 and sorted(r.id for r in t["events"].collect()) == ["evt_1", "evt_2", "evt_3"]
    assert captures.read_lines(spark, str(tmp_path / "all_v4"), glob="part*").select("source_file").distinct().count() == 3


def test_clock_is_the_nearest_double(spark):
    rows = spark.range(20_000).select((F.col("id") * 4_319_983 + 40_000_100_000).alias("us"))
    clock = F.date_format(F.timestamp_micros("us"), "HH:mm:ss.SSSSSS")
    line = F.concat(clock, F.lit(" IP (x"))
    seconds = F.col("us") % 86_400_000_000 / 1e6
    assert rows.where(~F.col("us").isNull() & (ct.clock_seconds(line) != seconds)).count() == 0
    assert spark.range(1).select(ct.clock_seconds(F.lit("no clock")).alias("t")).first().t is None


def test_summary_flows_read_written_bursts(spark, capture):
    """Flows, pairs and events start from bursts that are written once, not from the packets again."""
    for per_file in (True, False):
        tables_ = summary.capture_summary(spark, capture, per_file=per_file)
        plan = lambda name: tables_[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan("flows") and "Join" not in plan("flows")
        # the words of a query are joined after the numbering
        text = plan("events")
        assert text.index("LeftOuter") < text.index("Window")
