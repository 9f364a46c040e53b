"""The streaming jobs run over the events files until no input is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstlens.session import scratch_path
from burstlens.streaming import jobs, late, targets
from table_queries.adapters import ENDS, FLOWLETS, EV, ends, micros, table
from table_queries.captures import WHITELIST, _PACKETS, _parsed_columns, written_capture
from table_queries.registry import query


SLICES = 4
ROWS_A_FILE = 1_000_000


def _arriving(spark, e, by="_us"):
    """Folder of ``e`` in slices of arrival, and the files of each slice: a number that grows with the rows and is the same for all."""
    quarters = e.agg(F.percentile_approx(by, [i / SLICES for i in range(1, SLICES)]), F.count(F.lit(1)))
    cuts, rows = quarters.first()
    files = max(1, -(-rows // (SLICES * ROWS_A_FILE)))
    path = scratch_path(spark, "arriving")
    cuts = cuts or []
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None]), 1):
        part = e if low is None else e.where(F.col(by) > low)
        part = part if high is None else part.where(F.col(by) <= high)
        part.repartition(files).write.mode("append").parquet(path)
        # a part without rows makes no file; a batch must hold one slice and nothing of the next
        for _ in range(k * files - len(spark.read.parquet(path).inputFiles())):
            e.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path, files


def _columns(s):
    return s.select(
        "event_id", "user_id", "event_type", "value", F.timestamp_micros("_us").alias("at"), F.floor("value").cast("long").alias("size"))


def _events(spark, sf):
    """The events in order of time, arriving in four slices, one a batch."""
    path, files = _arriving(spark, table(spark, sf, "events").withColumn("_us", micros(F.col("ts"))))
    return _columns(jobs.read_table_stream(spark, path, glob="*.parquet", files_per_batch=files))


def _split(spark, sf, *spans):
    """Folder of the events in time and the late ones: one in 17 arrives 12 days after its time; then the closing row."""
    e = table(spark, sf, "events").withColumn("_us", micros(F.col("ts")))
    e = e.withColumn("_arrival", F.col("_us") + F.when(F.col("event_id") % 17 == 0, 12 * 86_400_000_000).otherwise(0))
    arriving, files = _arriving(spark, e, by="_arrival")
    path, control, checkpoint = (scratch_path(spark, n) for n in ("split", "control", "checkpoint"))
    rows = late.with_control(_columns(jobs.read_table_stream(spark, arriving, glob="*.parquet", files_per_batch=files)), control, "at")
    split = lambda: jobs.finish(late.split_arrivals(rows, path, event_time="at", watermark=spans[-1], checkpoint=checkpoint))
    split()
    late.send_closing(spark, path, control, "at", *spans)
    split()
    return path


def _closed(spark, stream, name):
    path = scratch_path(spark, name)
    jobs.finish(jobs.append_results(stream, path))
    return spark.read.parquet(path).drop("batch")


def _latest(spark, stream, name, key):
    path = scratch_path(spark, name)
    jobs.finish(jobs.upsert_results(stream, path))
    return jobs.latest(spark, path, key)


@query(f"WITH {FLOWLETS} SELECT user_id, start_ts, end_ts, packet_count, total_bytes FROM fl")
def stream_flowlets(spark, sf):
    """All bursts: those that the closing row let out, with the late events merged in."""
    path = _split(spark, sf, "6 hours", "1 day")
    s = jobs.burst_stream(late.in_time(spark, path), key=["user_id"], event_time="at", size="size", gap="6 hours", watermark="1 day")
    out = late.correct_bursts(_closed(spark, s, "bursts"), late.late_rows(spark, path), key=["user_id"], event_time="at", size="size", gap="6 hours")
    return out.select("user_id", F.unix_micros("start_ts").alias("start_ts"), F.unix_micros("end_ts").alias("end_ts"),
                      "packet_count", "total_bytes")


@query(f"""WITH {EV} SELECT t // 600000000 * 600000000 AS time, CAST(sum(size) AS BIGINT) AS total_bytes,
  CAST(sum(CASE WHEN user_id % 3 = 0 THEN size ELSE 0 END) AS BIGINT) AS llm_bytes, count(*) AS count FROM ev GROUP BY 1""")
def stream_chart(spark, sf):
    """All windows: those that the closing row let out, with the late events added."""
    path, llm = _split(spark, sf, "10 minutes", "1 hour"), F.col("user_id") % 3 == 0
    s = jobs.chart_stream(late.in_time(spark, path), event_time="at", size="size", llm=llm, width="10 minutes", watermark="1 hour")
    out = late.correct_chart(_closed(spark, s, "chart"), late.late_rows(spark, path), event_time="at", size="size", llm=llm, width="10 minutes")
    return out.withColumn("time", F.unix_micros("time"))


@query(f"WITH {EV} SELECT event_id, t FROM ev")
def stream_split(spark, sf):
    """Every event comes out of the split once, in time or late."""
    path = _split(spark, sf, "1 day")
    rows = late.late_rows(spark, path).unionByName(spark.read.parquet(f"{path}/in_time").where("not closing").drop("batch", "closing"))
    return rows.select("event_id", F.unix_micros("at").alias("t"))


@query(f"""WITH {ENDS}, r AS (SELECT event_id, src_ip, dst_ip, upper(event_type) || (event_id % 3) AS name FROM en WHERE event_id % 7 = 0),
x AS (SELECT dst_ip AS ip, event_id * 2 AS o, name FROM r UNION ALL SELECT src_ip, event_id * 2 + 1, name FROM r)
SELECT ip, arg_min(name, o) AS name FROM x WHERE ip NOT LIKE '10.%' GROUP BY ip""")
def stream_ip_map(spark, sf):
    name = F.concat(F.upper("event_type"), (F.col("event_id") % 3).cast("string"))
    r = ends(_events(spark, sf)).withColumn("detected", F.when(F.col("event_id") % 7 == 0, name))
    return _latest(spark, jobs.running_ip_map(r, order=["event_id"], src="src_ip", dst="dst_ip"), "ipmap", ["ip"])


@query(WHITELIST)
def stream_whitelist_s(spark, sf):
    path = scratch_path(spark, "targets")
    hit = (F.col("event_type") == "error") & (F.col("value") > 60)
    jobs.finish(targets.mark_target_streams(_events(spark, sf), path, stream="user_id", order="event_id", hit=hit))
    rows = targets.marked(spark, path)
    return rows.where((F.col("size") > 0) | F.col("is_first_hit")).select("user_id", "event_id", "is_first_hit")


@query(f"""WITH {EV} SELECT user_id % 8 AS capture_id, count(*) AS flow_count, count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS llm_flow_count,
  count(CASE WHEN value > 60 THEN 1 END) AS classified_count FROM ev GROUP BY 1""")
def stream_counts(spark, sf):
    e = _events(spark, sf).withColumns({
        "capture_id": F.col("user_id") % 8, "traffic_class": F.when(F.col("user_id") % 3 == 0, "llm").otherwise("non_llm"),
        "model_llm_prediction": F.when(F.col("value") > 60, "ChatGPT")})
    return _latest(spark, jobs.count_stream(e), "counts", ["capture_id"])


@query(f"WITH {ENDS} {_PACKETS}")
def stream_parse(spark, sf):
    """Written captures parsed file by file as they are found."""
    lines = jobs.read_line_stream(spark, f"{written_capture(spark, sf)}/*", glob="*.txt", files_per_batch=5)
    path = scratch_path(spark, "packets")
    jobs.finish(jobs.parse_arriving(lines, path))
    return _parsed_columns(spark.read.parquet(path))


def _bursts_of(spark, sf):
    """Events as stored bursts of 40 captures."""
    return table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("capture_id"), F.when(F.col("user_id") % 3 == 0, "llm").otherwise("non_llm").alias("traffic_class"),
        F.when(F.col("value") > 60, "ChatGPT").alias("model_llm_prediction"), "event_id")


@query(f"""WITH {EV}, kept AS (SELECT user_id % 40 AS capture_id, user_id, value, event_id FROM ev WHERE user_id % 40 % 5 <> 2 AND NOT (user_id % 40 % 7 = 3 AND event_id % 2 = 0))
SELECT capture_id, count(*) AS flow_count, count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS llm_flow_count,
  count(CASE WHEN value > 60 THEN 1 END) AS classified_count FROM kept GROUP BY 1""")
def stream_retracted_counts(spark, sf):
    """Counts over six arriving change files: captures in two halves, every fifth capture deleted, every seventh read once more
    with half of its bursts, one of the deleted ones added and deleted again; merged into a base table every second batch."""
    rows, folder = _bursts_of(spark, sf), scratch_path(spark, "changes")
    again = rows.where("capture_id % 7 = 3")
    gone = rows.select("capture_id").where("capture_id % 5 = 2").distinct()
    late_one = gone.where("capture_id = 12")
    changes = [
        jobs.added(rows.where("capture_id < 20")), jobs.added(rows.where("capture_id >= 20")), jobs.removed(rows, gone),
        jobs.replaced(again.join(gone, "capture_id", "left_anti"), again.where("event_id % 2 = 1").join(gone, "capture_id", "left_anti")),
        jobs.added(rows.join(late_one, "capture_id", "left_semi")), jobs.removed(rows, late_one)]
    files = max(1, -(-rows.count() // ROWS_A_FILE))
    for change in changes:
        change.repartition(files).write.mode("append").parquet(folder)
    stream, path = jobs.read_table_stream(spark, folder, glob="*.parquet", files_per_batch=files), scratch_path(spark, "counts")
    jobs.finish(jobs.upsert_results(jobs.count_stream(stream), path, key=["capture_id"], compact_every=2))
    return jobs.counted(spark, path)
