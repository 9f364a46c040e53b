"""Streams whose results are whole in the end: late rows are set aside and merged in, a closing row lets the last windows out.

Two queries in a row, each run as often as wanted on its own checkpoint:

* ``split_arrivals`` reads what arrives and writes each batch as rows in time and late rows. A row is late when its time lies before the engine's
  watermark of the batch. That watermark is asked of a keyed processor, which gets one probe a task; records do not pass it.
* the windowed query reads the rows in time (``in_time``). Its own watermark never overtakes the first one's, because it has seen whole earlier
  batches at most, so it drops nothing.

``correct_bursts`` and ``correct_chart`` merge the late rows into the closed windows. ``send_closing`` writes a row later than all others
into a control folder that ``with_control`` reads beside the records: it moves the watermark past every open window and is in no result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from burstlens.operators import bursts
from burstlens.operators.scan import drop_slices, scan, sliced
from burstlens.streaming import jobs
from burstlens.streaming.targets import start_with_state

CLOSING = "closing"


def send_closing(spark: SparkSession, path: str, control: str, event_time: str, *spans: str) -> None:
    """Write a closing row, later than every row that has been split by all of these spans (gap or width, and watermark) and a second."""
    rows = spark.read.parquet(f"{path}/in_time").unionByName(spark.read.parquet(f"{path}/late"))
    at = F.max(event_time) + F.expr("interval 1 second")
    for span in spans:
        at = at + F.expr(f"interval {span}")
    rows.agg(at.cast("timestamp").alias("at")).where("at is not null").coalesce(1).write.mode("append").parquet(control)


def with_control(records: DataFrame, control: str, event_time: str) -> DataFrame:
    """The records, and the closing rows with nothing but a time; ``closing`` tells them apart."""
    spark = records.sparkSession
    spark.range(0).select(F.timestamp_seconds(F.lit(0)).alias("at")).coalesce(1).write.mode("append").parquet(control)  # the folder must exist
    rows = spark.readStream.schema("at timestamp").parquet(control)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema if f.name != event_time]
    closing = rows.select(F.col("at").cast(records.schema[event_time].dataType).alias(event_time), *others, F.lit(True).alias(CLOSING))
    return records.withColumn(CLOSING, F.lit(False)).unionByName(closing)


class Watermark(StatefulProcessor):
    """Answers the watermark of the batch, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield Row(watermark=timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _watermark(records: DataFrame, event_time: str) -> DataFrame:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = sum(batch.num_rows for batch in batches)
        if some:
            yield pa.RecordBatch.from_pydict({"probe": [0]}, pa.schema([("probe", pa.int32())]))

    return records.select(event_time).mapInArrow(one, "probe int").groupBy("probe").transformWithState(Watermark(), T.StructType([T.StructField("watermark", T.LongType())]), "append", "EventTime")


def split_arrivals(records: DataFrame, path: str, *, event_time: str, watermark: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows in time below ``path``/in_time and late rows below ``path``/late, by batch; a repeated batch overwrites its own folders."""
    timed = records.withWatermark(event_time, watermark)
    mark = _watermark(timed, event_time)
    record = timed.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"), F.lit(None).cast("long").alias("watermark"))
    told = mark.select(F.lit(None).cast(record.schema["record"].dataType).alias("record"), "watermark")

    def write(rows: DataFrame, batch: int) -> None:
        here = f"{path}/arrived/batch={batch}"
        rows.write.mode("overwrite").parquet(here)
        arrived = rows.sparkSession.read.schema(rows.schema).parquet(here)
        at = arrived.where("watermark is not null").agg(F.max("watermark")).first()[0] or 0
        all_rows = arrived.where("record is not null").select("record.*")
        late = F.coalesce(F.col(event_time) < F.timestamp_millis(F.lit(at)), F.lit(False))
        all_rows.where(~late).write.mode("overwrite").parquet(f"{path}/in_time/batch={batch}")
        all_rows.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        jobs.drop_folder(rows.sparkSession, here)

    return start_with_state(record.unionByName(told), write, mode="append", checkpoint=checkpoint, trigger=trigger, partitions=1)


def in_time(spark: SparkSession, path: str) -> DataFrame:
    """The rows in time as a stream, whole batches at a time."""
    return jobs.read_table_stream(spark, f"{path}/in_time", glob="*.parquet").drop("batch")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/late").drop("batch", CLOSING)


def correct_bursts(closed: DataFrame, late: DataFrame, *, key: Sequence[str], event_time: str, size: str, gap: str) -> DataFrame:
    """Closed bursts (key, start_ts, end_ts, packet_count, total_bytes) with the late rows merged in.

    Late rows make bursts of their own; of the keys that have any, these and the closed ones are joined wherever they
    lie within ``gap`` of each other. Bursts of other keys stay as they are. Each kind is apart in itself, so
    the furthest end so far is the later of the last ends of both kinds, which an ordered scan carries along, also over a busy key.
    """
    width = F.expr(f"interval {gap}")
    columns = [*key, "start_ts", "end_ts", "packet_count", "total_bytes"]
    seconds = late.sparkSession.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + width)).alias("g")).first()[0]
    timed = late.where(F.col(event_time).isNotNull()).select(*key, F.unix_micros(event_time).alias("_t"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    own = bursts.burst_features(bursts.with_bursts(timed, key=key, ts="_t", gap=seconds), key=key, ts="_t", size="_size")
    own = own.select(*key, F.timestamp_micros("start_ts").alias("start_ts"), F.timestamp_micros("end_ts").alias("end_ts"), "packet_count", "total_bytes")
    touched = own.select(*[F.col(k).alias(f"_k_{k}") for k in key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    kept = closed.select(columns).join(touched, same, "left_anti")
    mixed = closed.select(columns).join(touched, same, "left_semi").withColumn("_own", F.lit(0)).unionByName(own.withColumn("_own", F.lit(1)))
    cut = sliced(mixed, key, "start_ts")
    order = ["start_ts", "_own"]
    ends = scan(cut, key, order, carry={"_c": F.when(F.col("_own") == 0, F.col("end_ts")), "_l": F.when(F.col("_own") == 1, F.col("end_ts"))})
    ends = scan(ends, key, order, lag={"_before": F.greatest("_c", "_l")})
    opens = F.col("_before").isNull() | (F.col("start_ts") > F.col("_before") + width)
    numbered = scan(ends.withColumn("_opens", opens.cast("long")), key, order, running={"_n": F.col("_opens")})
    joined = drop_slices(numbered).groupBy(*key, "_n").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("total_bytes"))
    return kept.unionByName(joined.select(columns))


def correct_chart(closed: DataFrame, late: DataFrame, *, event_time: str, size: str, llm: Column, width: str) -> DataFrame:
    """Closed chart windows with the late rows added to theirs."""
    own = late.groupBy(F.window(event_time, width).alias("w")).agg(*jobs.chart_sums(size, llm)).select(F.col("w.start").alias("time"), "total_bytes", "llm_bytes", "count")
    return closed.select(own.columns).unionByName(own).groupBy("time").agg(*[F.sum(c).alias(c) for c in ("total_bytes", "llm_bytes", "count")])
