"""Streams over several files give the batch result."""

import time

import pytest
from pyspark.sql import functions as F

from burstlens.functions import labels
from burstlens.operators import addresses, bursts
from burstlens.session import scratch_path
from burstlens.sources import captures
from burstlens.streaming import jobs, late, targets


def source(spark, files=5):
    """Events in several files, in order of time."""
    path = scratch_path(spark, "events")
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7 + F.col("id") % 5).alias("at"), (F.col("id") % 97).alias("size"))
    for i in range(files):
        rows.where(f"id >= {2000 // files * i} and id < {2000 // files * (i + 1)}").coalesce(1).write.mode("append").parquet(path)
    return path, rows


def same(a, b):
    assert sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))


def test_bursts(spark):
    path, rows = source(spark)
    stream = jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=1)
    s = jobs.burst_stream(stream, key=["k"], event_time="at", size="size", gap="20 seconds", watermark="1 hour")
    out = scratch_path(spark, "out")
    jobs.finish(jobs.append_results(s, out))
    end = rows.agg(F.max("at")).first()[0]
    b = bursts.with_bursts(rows.withColumn("t", F.unix_micros("at")), key=["k"], ts="t", order=["id"], gap=20_000_000)
    batch = bursts.burst_features(b, key=["k"], ts="t", size="size")
    cols = ["k", "start_ts", "end_ts", "packet_count", "total_bytes"]
    got = spark.read.parquet(out).withColumns({c: F.unix_micros(c) for c in ("start_ts", "end_ts")})
    closed = batch.where(F.col("end_ts") + 20_000_000 <= F.unix_micros(F.lit(end)) - 3_600_000_000)
    same(got.select(cols), closed.select(cols))


def hits():
    return F.col("id") % 137 == 50


def marked(spark, out):
    return targets.marked(spark, out).select("k", "id", "is_first_hit")


def batch_marks(rows):
    return addresses.target_streams(rows, stream="k", order="id", hit=hits()).select("k", "id", "is_first_hit")


def test_target_streams_over_batches(spark, monkeypatch):
    monkeypatch.setattr(targets, "HELD", 3)
    path, rows = source(spark)
    out = scratch_path(spark, "out")
    stream = jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=1)
    q = targets.mark_target_streams(stream, out, stream="k", order="id", hit=hits())
    jobs.finish(q)
    assert len([p for p in q.recentProgress if p.numInputRows]) == 5
    assert spark.conf.get(targets.STATE_PROVIDER, "") != targets.ROCKS
    same(marked(spark, out), batch_marks(rows))


def test_target_streams_over_many_arrow_batches_a_task(spark):
    """A task reads more rows than one Arrow batch holds: what is held and what comes may differ in nullability."""
    path, rows = source(spark)
    out = scratch_path(spark, "out")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        stream = jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=2)
        jobs.finish(targets.mark_target_streams(stream, out, stream="k", order="id", hit=hits()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same(marked(spark, out), batch_marks(rows))


def test_killed_target_streams_go_on(spark, monkeypatch):
    path, rows = source(spark)
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    start = lambda: targets.mark_target_streams(
        jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=1), out, stream="k", order="id", hit=hits(), checkpoint=checkpoint)
    mark, seen = targets._mark, []

    def dies(*a):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("killed in the third batch, after its state was asked")
        return mark(*a)

    monkeypatch.setattr(targets, "_mark", dies)
    with pytest.raises(Exception, match="killed"):
        jobs.finish(start())
    assert spark.read.parquet(f"{out}/rows").select("batch").distinct().count() == 2
    monkeypatch.setattr(targets, "_mark", mark)
    jobs.finish(start())
    same(marked(spark, out), batch_marks(rows))


def test_forgotten_streams_leave_the_state(spark):
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("arriving", "out", "checkpoint"))

    def run(hour, keys):
        rows = spark.createDataFrame([(k + 1000 * hour, k, 1_700_000_000 + 3600 * hour) for k in keys], "id long, k long, s long")
        rows.select("id", "k", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_table_stream(spark, folder, glob="*.parquet")
        q = targets.mark_target_streams(stream, out, stream="k", order="id", hit=F.col("id") < 1000, event_time="at", watermark="1 minute", forget_after_ms=5_000_000, checkpoint=checkpoint)
        jobs.finish(q)
        return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators][-1]

    sizes = [run(0, range(300)), run(1, [7, 9]), run(2, [7]), run(3, [7, 8, 9])]
    assert sizes[0] >= 300 and sizes[-1] < 10
    got = sorted((r.k, r.id) for r in targets.marked(spark, out).collect() if r.id >= 1000)
    assert got == [(7, 1007), (7, 2007), (7, 3007), (9, 1009), (9, 3009)]  # 8 was last seen too long ago


def late_source(spark):
    """Events of which some arrive much later than their time; a busy key and null keys among them."""
    path, rows = scratch_path(spark, "late"), None
    for i in range(4):
        part = spark.range(400 * i, 400 * i + 400).select(
            "id", F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 31 == 0, None).otherwise(F.col("id") % 9).cast("int").alias("k"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 40 - F.when(F.col("id") % 23 == 0, 9000).otherwise(0)).alias("at"), (F.col("id") % 97).alias("size"))
        part.coalesce(1).write.mode("append").parquet(path)
        rows = part if rows is None else rows.union(part)
    return path, rows


def split(spark, path, *spans):
    out, control, checkpoint = (scratch_path(spark, n) for n in ("split", "control", "checkpoint"))
    rows = late.with_control(jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=1), control, "at")
    run = lambda: jobs.finish(late.split_arrivals(rows, out, event_time="at", watermark=spans[-1], checkpoint=checkpoint))
    run()
    late.send_closing(spark, out, control, "at", *spans)
    run()
    return out


def test_late_rows_and_the_closing_row_make_bursts_whole(spark):
    path, rows = late_source(spark)
    parts = split(spark, path, "90 seconds", "10 minutes")
    found = late.late_rows(spark, parts)
    assert 10 < found.count() < 80
    s = jobs.burst_stream(late.in_time(spark, parts), key=["k"], event_time="at", size="size", gap="90 seconds", watermark="10 minutes")
    out = scratch_path(spark, "out")
    jobs.finish(jobs.append_results(s, out))
    got = late.correct_bursts(spark.read.parquet(out).drop("batch"), found, key=["k"], event_time="at", size="size", gap="90 seconds")
    b = bursts.with_bursts(rows.withColumn("t", F.unix_micros("at")), key=["k"], ts="t", order=["id"], gap=90_000_000)
    batch = bursts.burst_features(b, key=["k"], ts="t", size="size")
    cols = ["k", "start_ts", "end_ts", "packet_count", "total_bytes"]
    got = got.withColumns({c: F.unix_micros(c) for c in ("start_ts", "end_ts")}).select(cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select(cols).collect()))
    none = late.correct_bursts(spark.read.parquet(out).drop("batch"), found.limit(0), key=["k"], event_time="at", size="size", gap="90 seconds")
    assert none.count() == spark.read.parquet(out).count()


def test_late_rows_and_the_closing_row_make_the_chart_whole(spark):
    path, rows = late_source(spark)
    parts = split(spark, path, "10 seconds", "1 minute")
    llm, out = F.col("k") == 0, scratch_path(spark, "out")
    jobs.finish(jobs.append_results(jobs.chart_stream(late.in_time(spark, parts), event_time="at", size="size", llm=llm), out))
    got = late.correct_chart(spark.read.parquet(out).drop("batch"), late.late_rows(spark, parts), event_time="at", size="size", llm=llm, width="10 seconds")
    same(got, rows.groupBy(F.window("at", "10 seconds").start.alias("time")).agg(*jobs.chart_sums("size", llm)))


def test_counts_go_down_again(spark):
    stored = spark.createDataFrame([(c, "llm" if i % 2 else "non_llm", "X" if i % 3 else None) for c in (1, 2, 3, None) for i in range(10)], "capture_id int, traffic_class string, model_llm_prediction string")
    of = lambda c: stored.where(f"capture_id = {c}")
    changes = [jobs.added(stored), jobs.removed(stored, of(2)), jobs.replaced(of(3), of(3).limit(4)), jobs.added(of(2).limit(1)), jobs.removed(of(2).limit(1), of(2)), jobs.removed(stored, stored.limit(0))]
    folder = scratch_path(spark, "changes")
    for c in changes:
        c.coalesce(1).write.mode("append").parquet(folder)
    want = jobs.count_stream(stored.where("capture_id is null or capture_id = 1").unionByName(of(3).limit(4)))
    for every, folders in ((None, 6), (2, 0), (4, 2)):
        out = scratch_path(spark, "counts")
        q = jobs.upsert_results(jobs.count_stream(jobs.read_table_stream(spark, folder, glob="*.parquet", files_per_batch=1)), out, key=["capture_id"], compact_every=every)
        jobs.finish(q)
        same(jobs.counted(spark, out), want)
        left = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")
        assert len(left.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(left)) == folders
        assert len(jobs._bases(spark, out)) == (0 if every is None else 1)


def test_chart_and_counts(spark):
    path, rows = source(spark)
    stream = jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=2)
    out = scratch_path(spark, "out")
    jobs.finish(jobs.append_results(jobs.chart_stream(stream, event_time="at", size="size", llm=F.col("k") == 0), out))
    end = rows.agg(F.max("at")).first()[0]
    t = F.timestamp_seconds(F.floor(F.unix_seconds("at") / 10) * 10)
    batch = rows.groupBy(t.alias("time")).agg(
        F.sum("size").alias("total_bytes"), F.sum(F.when(F.col("k") == 0, F.col("size")).otherwise(0)).alias("llm_bytes"), F.count("*").alias("count"))
    closed = batch.where(F.unix_seconds("time") + 10 <= F.unix_seconds(F.lit(end)) - 60)
    assert spark.read.parquet(out).select("batch").distinct().count() >= 3
    same(spark.read.parquet(out).drop("batch"), closed)


def test_closed_windows_leave_the_state_and_late_rows_are_left_out(spark):
    path = scratch_path(spark, "late")
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    for i in range(4):
        rows = spark.range(100).select(at(F.lit(i * 3600) + F.col("id") * 30).alias("at"), F.lit(1).alias("size"))
        rows = rows.union(spark.range(1).select(at(F.lit(0)), F.lit(1))) if i == 3 else rows
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=1)
    out = scratch_path(spark, "out")
    q = jobs.append_results(jobs.chart_stream(stream, event_time="at", size="size", llm=F.col("size") == 1), out)
    jobs.finish(q)
    states = [p.stateOperators[0] for p in q.recentProgress if p.stateOperators]
    assert max(s.numRowsTotal for s in states) < 250 and states[-1].numRowsTotal < 10
    assert sum(s.numRowsDroppedByWatermark for s in states) == 1
    assert spark.read.parquet(out).agg(F.sum("count")).first()[0] >= 390


def test_upserts_give_the_running_table(spark):
    path, rows = source(spark)
    flow = lambda d: d.select(F.col("k").alias("capture_id"), F.when(F.col("id") % 2 == 0, "llm").alias("traffic_class"), F.lit(None).cast("string").alias("model_llm_prediction"))
    out = scratch_path(spark, "counts")
    jobs.finish(jobs.upsert_results(jobs.count_stream(flow(jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=1))), out))
    same(jobs.latest(spark, out, ["capture_id"]), jobs.count_stream(flow(rows)))


def test_parse_arriving_captures(spark, tmp_path):
    for i in range(4):
        head = "LLM_IP A 8.8.8.8\n\n" if i else ""
        body = "".join(f"00:00:0{j % 10}.5 IP (proto TCP (6))\n    10.0.0.{i}.{1000 + j} > 8.8.8.8.443: length {j}\n" for j in range(40))
        (tmp_path / f"capture_{i}.txt").write_text(head + body)
    out = scratch_path(spark, "packets")
    jobs.finish(jobs.parse_arriving(jobs.read_line_stream(spark, str(tmp_path), files_per_batch=1), out))
    cols = ["source_file", "ts", "src_ip", "src_port", "dst_ip", "dst_port", "length"]
    same(spark.read.parquet(out).select(cols), captures.parse_packets(captures.read_lines(spark, str(tmp_path))).select(cols))


def test_gap_labels_are_total(spark):
    df = spark.createDataFrame([(None,), (0.0,), (5.0,)], "g double")
    assert [r[0] for r in df.select(labels.gap_state(F.col("g"))).collect()] == [None, "GAP_0_10ms", "GAP_GT_1s"]


def test_arriving_slices_grow_in_files(spark, monkeypatch):
    import check_queries
    from table_queries import load, streams

    folder, registry = "/root/testdata/sf0.001", load()
    monkeypatch.setattr(streams, "ROWS_A_FILE", 60)
    e = spark.read.parquet(f"{folder}/events.parquet").withColumn("_us", streams.micros(F.col("ts")))
    path, files = streams._arriving(spark, e)
    assert files > 1 and len(spark.read.parquet(path).inputFiles()) == 4 * files
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == e.count() and max(sizes) <= 120
    con = check_queries.database(folder)
    for name in ("stream_flowlets", "stream_chart"):
        assert check_queries.compare(spark, con, folder, name, registry.QUERIES[name], registry.SQL[name]).startswith("ok")
    same_time = spark.range(500).select("id", F.lit(7).cast("long").alias("_us"))
    path, files = streams._arriving(spark, same_time)
    assert len(spark.read.parquet(path).inputFiles()) == 4 * files and spark.read.parquet(path).count() == 500
