"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from burstlens.functions import capture_text as ct
from burstlens.functions import labels, payload, render
from burstlens.functions.addresses import flow_direction
from burstlens.operators import addresses, bursts, documents, evaluate, markov, prompts, queries, stats, store
from burstlens.sources import captures


def one(df):
    return [tuple(r) for r in df.collect()]


def value(spark, column, **cells):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()])
    return row.select(column).first()[0]


def test_bursts_null_length_and_gap_rule(spark):
    p = spark.createDataFrame([("a", 0.0, 100), ("a", 0.05, None), ("a", 0.25, 50), ("a", 0.30, 60)], "k string, ts double, length int")
    f = bursts.burst_features(bursts.with_bursts(p, key=["k"], gap=0.1), key=["k"]).orderBy("flowlet_id")
    got = one(f.select("flowlet_id", "start_ts", "end_ts", "packet_count", "total_bytes", "packet_size_mean",
                       F.round("packet_size_std", 6), "inter_packet_time_std"))
    assert got == [(1, 0.0, 0.05, 2, 100, 50.0, 70.710678, 0.0), (2, 0.25, 0.3, 2, 110, 55.0, 7.071068, 0.0)]


def test_gap_equal_to_threshold_joins(spark):
    p = spark.createDataFrame([("a", 0, 1), ("a", 100_000, 1), ("a", 200_001, 1)], "k string, ts long, length int")
    assert [r["flowlet_id"] for r in bursts.with_bursts(p, key=["k"], gap=100_000).orderBy("ts").collect()] == [1, 1, 2]


def test_single_packet(spark):
    p = spark.createDataFrame([("a", 1.0, 7)], "k string, ts double, length int")
    b = bursts.with_bursts(p, key=["k"])
    f = bursts.burst_features(b, key=["k"]).first()
    assert (f.inter_packet_time_mean, f.inter_packet_time_std, f.packet_size_std) == (0.0, 0.0, 0.0)
    s = bursts.burst_sequences(b, key=["k"]).first()
    assert (s.inter_packet_times, s.packet_sizes) == ([], [7])


def lines(spark, texts):
    return spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(texts)], "source_file string, block long, row long, value string")


def test_line_pairing(spark):
    t = "00:00:0{}.5 IP x"
    got = captures.pair_lines(lines(spark, [t.format(1), t.format(2), "a3", t.format(4), "a5", "a6", t.format(7)]))
    assert one(got.orderBy("row").select("row", "address")) == [(0, t.format(2)), (3, "a5"), (6, None)]


def test_last_clock_line_has_no_address(spark):
    p = captures.parse_packets(lines(spark, ["00:00:01.5 IP6 (proto TCP (6), length 41)"])).first()
    assert (p.ts, p.src_ip, p.src_port, p.dst_port, p.length, p.protocol) == (1.5, None, None, None, 41, "TCP")


@pytest.mark.parametrize("rule,token,want", [
    ("v2", "192.168.4.68.59993", ("192.168.4.68", 59993)),
    ("v2", "192.168.4.45.", ("192.168.4.45", None)),
    ("v2", "224.0.0.251", ("224.0.0.251", None)),
    ("v1", "224.0.0.251", ("224.0.0", 251)),
    ("v2", "", (None, None)),
    ("v2", "10.0.0.1.0", ("10.0.0.1", None)),
])
def test_host_port(spark, rule, token, want):
    got = value(spark, ct.split_host_port(F.col("t"), rule), t=token)
    assert (got["host"], got["port"]) == want


def test_ipv6_destination(spark):
    line = "    2001:db8::1.50000 > 2001:db8::2.443: Flags [.], length 5"
    df = spark.createDataFrame([(line,)], "t string")
    ends = ct.address_ends(df, "t").first()
    assert (ends.src_ip, ends.src_port, ends.dst_ip, ends.dst_port) == ("2001:db8::1", 50000, "2001:db8::2", 443)
    assert ct.address_ends(df, "t", ipv6_compat=True).first().dst_ip == "2001"


def test_protocol_by_number(spark):
    line = "00:11:20.467021 IP (flags [0x00], proto Proto (17), length 73)"
    assert value(spark, ct.protocol(F.col("t")), t=line) == "PROTO"
    assert value(spark, ct.protocol(F.col("t"), by_number=True), t=line) == "UDP"
    assert value(spark, ct.protocol(F.col("t")), t="nothing") == "UNKNOWN"


def test_headers(spark):
    got = captures.read_headers(lines(spark, [
        "LLM_IP CHATGPT 1.2.3.4.", "", "LLM_IP CLAUDE 1.2.3.4", "00:00:01.5 IP x", "LLM_IP LATE 9.9.9.9"]))
    assert one(got.select("ip", "name")) == [("1.2.3.4", "CLAUDE")]
    assert captures.read_headers(lines(spark, ["# none", "LLM_IP A 1.1.1.1"])).count() == 0


def test_query_pairing(spark):
    rows = [("u", 0, 1), ("u", 5, 6), ("r", 1, 2), ("r", 3, 4), ("r", 5, 5), ("r", 7, 9)]
    t = spark.createDataFrame([(i, k, float(a), float(b), 10) for i, (k, a, b) in enumerate(rows)],
                              "i int, k string, start_ts double, end_ts double, total_bytes int")
    p = queries.pair_queries(t, scope=[], upload=F.col("k") == "u", response=F.col("k") == "r", order=["i"])
    assert one(p.orderBy("i").select("query_id", "query_role")) == [
        (1, "upload"), (2, "upload"), (1, "response"), (1, "response"), (None, None), (2, "response")]
    s = queries.query_summary(p, scope=[]).orderBy("query_id")
    assert one(s.select("response_start_ts", "response_end_ts", "response_bytes", "confidence")) == [
        (1.0, 4.0, 20, "high"), (7.0, 9.0, 10, "high")]


def test_upload_without_response(spark):
    t = spark.createDataFrame([(0, 0.0, 1.0, 5)], "i int, start_ts double, end_ts double, total_bytes int")
    p = queries.pair_queries(t, scope=[], upload=F.lit(True), response=F.lit(False), order=["i"])
    q = queries.query_summary(p, scope=[]).first()
    assert (q.response_start_ts, q.response_end_ts, q.response_bytes, q.confidence) == (None, None, 0, "low")


@pytest.mark.parametrize("flow,hints,want", [
    (("10.0.0.5", 50000, "8.8.8.8", 53), {}, "client_to_server"),
    (("8.8.8.8", 443, "1.1.1.1", 50000), {}, "server_to_client"),
    (("8.8.8.8", 1, "1.1.1.1", 2), {}, "unknown"),
    (("8.8.8.8", 443, "10.0.0.5", 2), {"client_ip": "8.8.8.8"}, "client_to_server"),
    (("8.8.8.8", 443, "10.0.0.5", 2), {"server_ip": "10.0.0.5"}, "client_to_server"),
])
def test_direction(spark, flow, hints, want):
    cells = dict(zip(("s", "sp", "d", "dp"), flow))
    assert value(spark, flow_direction(F.col("s"), F.col("sp"), F.col("d"), F.col("dp"), **hints), **cells) == want


def test_gap_states(spark):
    got = [value(spark, labels.gap_state(F.col("g")), g=g) for g in (0.0099, 0.01, 0.1, 1.0)]
    assert got == ["GAP_0_10ms", "GAP_10_100ms", "GAP_100ms_1s", "GAP_GT_1s"]


def test_size_blocks(spark):
    s = spark.createDataFrame([("c", v) for v in [60] * 6 + [40] * 3 + [10]], "c string, v int")
    got = one(markov.fit_blocks(s, by=["c"], value="v").orderBy("value").select("value", "is_block", "block"))
    assert got == [(10, False, "BLOCK_40.00"), (40, True, "BLOCK_40.00"), (60, True, "BLOCK_60.00")]


def chain(spark, sequences):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "i int, a array<string>")
    return markov.explode_sequence(rows, F.col("a"), ident=["i"], attr="time_gap").withColumn("cls", F.lit("llm"))


def test_markov_fit_and_score(spark):
    st = markov.step_counts(chain(spark, [["a", "b", "a"], ["b"]]), by=["cls"])
    trans, ends = markov.transitions(st, by=["cls"]), markov.sequence_ends(st, by=["cls"])
    assert one(trans.orderBy("state").select("state", "next_state", "p")) == [("a", "b", 1.0), ("b", "a", 1.0)]
    assert one(ends.orderBy("state").select("state", "p_start", "p_end")) == [("a", 0.5, 0.5), ("b", 0.5, 0.5)]
    table = markov.lookup_table(trans, ends, cls="cls")
    scored = markov.score_markov(chain(spark, [["a", "b"], ["c"], []]), table, ident=["i"]).orderBy("i")
    assert [round(r.ll_time_llm, 6) for r in scored.collect()] == [-0.346574, -23.025851]
    assert value(spark, labels.clip_likelihood(F.coalesce(F.col("x").cast("double"), F.lit(-100.0))), x=None) == -100.0


def test_empty_sequences_count_when_totals_are_given(spark):
    totals = spark.createDataFrame([("llm", "time_gap", 4)], "cls string, attr string, n_sequences long")
    counts = markov.step_counts(chain(spark, [["a"], ["b"]]), by=["cls"])
    ends = markov.sequence_ends(counts, by=["cls"], totals=totals)
    assert {r.p_start for r in ends.collect()} == {0.25}


def test_mann_whitney(spark):
    d = spark.createDataFrame([(1, 3.0), (1, 4.0), (0, 1.0), (0, 3.0)], "label int, x double")
    s = stats.class_stats(d, ["x"], label="label").first()
    assert (s.mann_whitney_u, s.llm_median, s.non_llm_median) == (3.5, 3.5, 2.0)
    # Normal approximation with ties and continuity correction.
    sigma = math.sqrt(4 / 12 * (5 - 6 / 12))
    assert s.p_value == pytest.approx(math.erfc((3.5 - 2 - 0.5) / sigma / math.sqrt(2)))


def test_ensemble(spark):
    rows = [(0.9, 0.4, 0.3), (0.1, 0.2, 0.6), (None, None, None)]
    p = spark.createDataFrame(rows, "a double, b double, c double")
    got = one(evaluate.ensemble(p, probs=["a", "b", "c"]).select("predicted_label", "confidence"))
    assert got == [(1, 0.9), (0, 0.9), (0, 0.0)]


def test_chart(spark):
    f = spark.createDataFrame([(0.0, 1, "llm", None), (9.99, 2, "non_llm", "Claude"), (10.0, 4, "non_llm", "")],
                              "start_ts double, total_bytes long, traffic_class string, model_llm_prediction string")
    assert one(store.chart(f).orderBy("time")) == [(0, 3, 3, 2), (10, 4, 0, 1)]


def test_listing_and_detail(spark):
    c = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id long, created_at long")
    f = spark.createDataFrame([(1, "llm", None), (2, "llm", "x"), (2, "non_llm", None)],
                              "capture_id long, traffic_class string, model_llm_prediction string")
    assert one(store.capture_listing(c, f).select("id", "flow_count", "llm_flow_count")) == [(2, 2, 1), (1, 1, None), (3, 0, None)]
    assert sorted(one(store.capture_detail(c, f).select("id", "llm_flow_count"))) == [(1, 1), (2, 1), (3, 0)]


@pytest.mark.parametrize("text,want", [
    ('["a","b"]', ["a", "b"]), ('x ["a"] y', ["a"]), ("1. do this", ["do this"]), ('["a",1]', []), ("[]", []),
    ('["a"] junk ]\nline\n- 2. two', ["line", "two"]), ('{"a": 1}\n.,\n12.', [""]), ('["a", null]', []),
    ('["q\\"\\u0041"]', ['q"A']),
])
def test_normalize_chain(spark, text, want):
    assert value(spark, prompts.normalize_chain(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("61:62", "ab"), ("abc", None), ("ff", None), ("zz", None)])
def test_hex_payload(spark, text, want):
    assert value(spark, payload.hex_text(F.col("t")), t=text) == want


def test_readable(spark):
    assert value(spark, payload.is_readable(F.col("t")), t="") is False
    assert value(spark, payload.is_readable(F.col("t")), t="a" * 9 + "é") is False
    assert value(spark, payload.is_readable(F.col("t")), t="a" * 10 + "é") is True


def test_document_numbers(spark):
    old = spark.createDataFrame([("c", "flowlet_000001"), ("c", "flowlet_000003"), ("c", "flowlet_x"), ("c", "notes")], "cap string, field string")
    assert documents.next_index(old, capture="cap").first()["next_index"] == 4
    f = spark.createDataFrame([("c", 1, "llm"), ("c", 2, "non_llm"), ("d", 1, "llm")], "cap string, n int, traffic_class string")
    rows = documents.document_rows(f, capture="cap", order=["n"], existing=old).orderBy("cap", "field")
    assert one(rows.select("cap", "field")) == [("c", "flowlet_000004"), ("c", "flowlet_000005"), ("d", "flowlet_000001")]


def test_document_transform_is_pluggable(spark):
    f = spark.createDataFrame([("c", 1, "llm")], "cap string, n int, traffic_class string")
    rows = documents.document_rows(f, capture="cap", order=["n"], transform=lambda d: d.withColumn("extra", F.lit(5)))
    assert rows.first()["value"]["extra"] == 5


def test_metadata_merge(spark):
    old = spark.createDataFrame([("c", "kept", None)], "cap string, notes string, file string")
    new = spark.createDataFrame([("c", "new", "f"), ("d", "n", "g")], "cap string, notes string, file string")
    got = documents.merge_metadata(old, new, capture="cap").orderBy("cap")
    assert one(got) == [("c", "kept", "f"), ("d", "n", "g")]


def test_ip_map_carries_over_files(spark):
    heads = spark.createDataFrame([("d/1", "X", "A"), ("d/3", "X", "B")], "source_file string, ip string, name string")
    f = spark.createDataFrame([(f"d/{i}", "X", "Y") for i in (1, 2, 3)], "source_file string, src_ip string, dst_ip string")
    seen = addresses.carry_ip_map(heads, addresses.end_addresses(f))
    got = addresses.label_by_ip(f, seen, truth_map=heads).orderBy("source_file")
    assert one(got.select("llm_name", "ground_truth_llm", "outgoing", "direction_encoded")) == [
        ("A", "A", False, -1), ("A", None, False, -1), ("B", "B", False, -1)]


def test_large_ip_map_is_joined_by_shuffle(spark):
    m = spark.createDataFrame([("X", "A"), ("Z", "B")], "ip string, name string")
    f = spark.createDataFrame([("X", "Y"), ("Q", "Z")], "src_ip string, dst_ip string")
    small = addresses.label_by_ip(f, m)
    large = addresses.label_by_ip(f, m, max_broadcast_rows=1)
    assert sorted(one(small.select("src_ip", "llm_name", "outgoing"))) == sorted(one(large.select("src_ip", "llm_name", "outgoing")))


@pytest.mark.parametrize("words,want", [("SYN, ACK", "[S.]"), ("", "[.]"), (None, "[.]"), ("fin psh", "[PF]")])
def test_flags(spark, words, want):
    assert value(spark, render.flag_letters(F.col("t").cast("string")), t=words) == want


def test_class_report_matches_published_numbers(spark):
    c = spark.createDataFrame([(14395, 23, 788, 1145)], "tn long, fp long, fn long, tp long")
    m = evaluate.metrics(c).first()
    assert m.accuracy == pytest.approx(0.9504005871200538) and m.f1 == pytest.approx(0.7384714608190907)
    r = {x["class"]: x for x in evaluate.class_report(c).collect()}
    assert r["macro avg"]["f1_score"] == pytest.approx(0.8555368688845968)
    assert r["weighted avg"]["precision"] == pytest.approx(0.9519074921140861)
    zero = evaluate.metrics(spark.createDataFrame([(5, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert (zero.precision, zero.recall, zero.f1) == (0.0, 0.0, 0.0)


def test_status_and_event_time(spark):
    log = spark.createDataFrame([(1, "running", 1), (1, "completed", 3), (2, "running", 2)], "capture_id int, status string, changed_at int")
    assert sorted(one(store.current_status(log).select("capture_id", "status"))) == [(1, "completed"), (2, "running")]
    p = spark.createDataFrame([("x/capture_20251217_001115.txt", 1.25)], "source_file string, ts double")
    assert str(captures.with_event_time(p).first()["event_time"]) == "2025-12-17 00:00:01.250000"


def test_exact_rank_query_places_equal_times_and_keeps_the_groups_of_its_sql(spark, tmp_path):
    from table_queries.model import mann_whitney_exact

    at = "2024-01-01 00:00:0"
    small = [(1, at + "1", 1, "click"), (2, at + "1", 1, "view"), (3, at + "2", 1, "error"), (4, at + "2", 1, "error")]
    large = [(10 + i, f"2024-01-01 00:01:{i:02d}", 2, "click" if i % 2 else "error") for i in range(17)]
    rows = spark.createDataFrame(small + large, "event_id long, ts string, user_id long, event_type string")
    rows.select("event_id", F.to_timestamp_ntz("ts").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    # all four places are known, so 2 of the 6 orders are as far out; a group of 17 rows has no row in the SQL
    assert one(mann_whitney_exact(spark, str(tmp_path)).select("user_id", "n1", "n0", "u", "p_value")) == [(1, 2, 2, 0.0, 0.3333333333)]


def test_training_joins_partitions_to_a_few_per_core(spark):
    from pyspark.ml.classification import LogisticRegression

    from burstlens.operators import features, models

    seen = []

    class Watched(LogisticRegression):
        def _fit(self, dataset):
            seen.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    rows = spark.range(400, numPartitions=200).select(F.col("id").alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    models.train(features.assemble(rows, ["a"], keep=["label"]), {"m": Watched(maxIter=1)})
    assert seen == [models.PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism]


def test_fourier_features_are_the_cosines_of_each_row(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from burstlens.operators.models import FourierFeatures

    rows = spark.range(5, numPartitions=2).select("id", array_to_vector(F.array(F.col("id") * 0.5, F.lit(1.0))).alias("scaled"))
    made = FourierFeatures(width=2, gamma=0.5, size=3)
    got = {r[0]: r[1] for r in made.transform(rows).select("id", vector_to_array("fourier")).collect()}
    rng = np.random.default_rng(42)
    w, b = rng.normal(0.0, 1.0, (2, 3)), rng.uniform(0.0, 2 * np.pi, 3)
    for i in range(5):
        assert got[i] == pytest.approx(list(np.sqrt(2 / 3) * np.cos(np.array([i * 0.5, 1.0]) @ w + b)))
    assert made.transform(rows.limit(0)).count() == 0


def test_the_report_plans_its_statistics_once(spark):
    from burstlens.operators import models
    from burstlens.plans import analysis

    rows = spark.range(60).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id").cast("string").alias("g"))
    report = analysis.analyse(rows, names=["a"], label="label", group="g", estimators={"random_forest": models.estimators(1, trees=2)["random_forest"]})
    for name in ("correlation", "statistical_tests", "significant_features", "most_correlated"):
        assert "Range" not in report[name]._jdf.queryExecution().optimizedPlan().toString()
