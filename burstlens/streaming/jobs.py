"""Structured Streaming forms of the time-based operators.

Each builder returns a streaming DataFrame or starts a query; the batch
operators define the result.  Windows are closed by the watermark: their rows
come out once, when no later row can change them (``append_results``), their
state is dropped, and rows later than the watermark are left out, which the
batch form never does.  Running values per key have no end; each batch gives
those that changed (``upsert_results``), and ``latest`` reads the last of each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from burstlens.functions import addresses
from burstlens.session import scratch_path
from burstlens.sources import captures


def read_table_stream(spark: SparkSession, path: str, *, glob: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder; the schema is that of the files there."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_line_stream(spark: SparkSession, path: str, *, glob: str = "capture*.txt", files_per_batch: int | None = None) -> DataFrame:
    """Lines of arriving capture files, with the file and block they come from."""
    reader = spark.readStream.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        captures.local_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("value"),
    )


def start(df: DataFrame, batch: Callable[[DataFrame, int], None], *, mode: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return writer.trigger(**trigger).start()


def _results(df: DataFrame, path: str, mode: str, checkpoint: str | None, trigger: dict | None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if then:
            then(rows, batch)

    return start(df, write, mode=mode, trigger=trigger or {"availableNow": True},
                  checkpoint=checkpoint or scratch_path(df.sparkSession, "checkpoint"))


def append_results(
    df: DataFrame, path: str, *, checkpoint: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Rows of closed windows, each once, under their batch number; a repeated batch overwrites its own folder."""
    return _results(df, path, "append", checkpoint, trigger)


def upsert_results(
    df: DataFrame, path: str, *, checkpoint: str | None = None, trigger: dict | None = None,
    key: Sequence[str] = (), compact_every: int | None = None,
) -> StreamingQuery:
    """Rows that a batch changed, under its number; ``latest`` gives the table. A repeated batch overwrites its own folder.

    With ``compact_every`` every so many batches are merged by ``key`` into a base table and dropped, so that what
    is kept grows with the keys and not with the batches.
    """

    def then(rows: DataFrame, batch: int) -> None:
        if compact_every and (batch + 1) % compact_every == 0:
            compact(rows.sparkSession, path, key, batch)

    return _results(df, path, "update", checkpoint, trigger, then)


def _bases(spark: SparkSession, path: str) -> list[int]:
    """The batches up to which a base table has been written whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-base/upto=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or [])


def compact(spark: SparkSession, path: str, key: Sequence[str], batch: int) -> None:
    """One base table of the last row of each key up to ``batch``; what it replaces is deleted once it is whole."""
    old = _bases(spark, path)
    if not old or old[-1] < batch:
        latest(spark, path, key, upto=batch).write.mode("overwrite").parquet(f"{path}-base/upto={batch}")
    first = old[-1] + 1 if old else 0
    for n in range(first, batch + 1):
        drop_folder(spark, f"{path}/batch={n}")
    for n in old:
        if n < batch:
            drop_folder(spark, f"{path}-base/upto={n}")


def latest(spark: SparkSession, path: str, key: Sequence[str], *, upto: int | None = None) -> DataFrame:
    """The last row of each key over the batches at ``path`` and their base table, if any."""
    bases = _bases(spark, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    newer = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    newer = [n for n in (int(f.getPath().getName().partition("=")[2]) for f in newer or []) if not bases or n > bases[-1]]
    parts = [spark.read.parquet(f"{path}-base/upto={bases[-1]}").withColumn("batch", F.lit(bases[-1]))] if bases else []
    if newer or not bases:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in newer]) if newer else spark.read.parquet(path)
        parts.append(rows if upto is None else rows.where(F.col("batch") <= upto))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def parse_arriving(
    lines: DataFrame, path: str, *, checkpoint: str | None = None, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Packets of each arriving file, appended as parquet under its batch number.

    A capture file is complete when it appears, so each micro-batch is parsed
    by the batch operator; a repeated batch overwrites its own folder.
    """

    def parse(rows: DataFrame, batch: int) -> None:
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        captures.parse_packets(numbered, **options).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    spark = lines.sparkSession
    return start(lines, parse, mode="append", trigger=trigger or {"availableNow": True},
                  checkpoint=checkpoint or scratch_path(spark, "checkpoint"))


def running_ip_map(records: DataFrame, *, order: Sequence[str], src: str = "src", dst: str = "dst", name: str = "detected") -> DataFrame:
    """Public address -> first name, as a running combinable minimum."""
    ends = F.array(
        F.struct(F.col(dst).alias("ip"), F.lit(0).alias("pos")), F.struct(F.col(src).alias("ip"), F.lit(1).alias("pos"))
    )
    rows = records.where(F.col(name).isNotNull()).select(*order, F.col(name).alias("name"), F.inline(ends))
    public = (F.col("ip") != "") & ~addresses.is_private_ip(F.col("ip"))
    return rows.where(public).groupBy("ip").agg(F.min_by("name", F.struct(*order, "pos")).alias("name"))


def _closes(apart: list[str]) -> list[Column]:
    """Whether a group is that of a closing row; as an aggregate, so that no filter on it reaches the rows before the watermark."""
    return [F.bool_or(c).alias("closes") for c in apart]


def burst_stream(
    packets: DataFrame, *, key: Sequence[str], event_time: str, size: str, gap: str, watermark: str
) -> DataFrame:
    """Bursts as session windows: a gap of exactly ``gap`` still joins; rows marked ``closing`` move the watermark only.

    A session with ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    set merges sessions inside each input partition before the shuffle, so that a
    busy key sends its sessions and not its packets to one task.
    """
    session = F.session_window(event_time, gap)
    apart = ["closing"] if "closing" in packets.columns else []
    out = packets.withWatermark(event_time, watermark).groupBy(*key, *apart, session.alias("session")).agg(
        F.min(event_time).alias("start_ts"),
        F.max(event_time).alias("end_ts"),
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.coalesce(F.col(size), F.lit(0)).cast("long")).alias("total_bytes"),
        *_closes(apart),
    )
    return (out.where("not closes") if apart else out).drop("session", "closes", *apart)


def chart_sums(size: str, llm: Column) -> list[Column]:
    return [F.sum(size).alias("total_bytes"), F.sum(F.when(llm, F.col(size)).otherwise(0)).alias("llm_bytes"), F.count(F.lit(1)).alias("count")]


def chart_stream(
    rows: DataFrame, *, event_time: str, size: str, llm: Column, width: str = "10 seconds", watermark: str = "1 minute"
) -> DataFrame:
    """Bytes, llm bytes and rows per tumbling window; rows marked ``closing`` move the watermark only."""
    apart = ["closing"] if "closing" in rows.columns else []
    out = rows.withWatermark(event_time, watermark).groupBy(F.window(event_time, width).alias("w"), *apart).agg(*chart_sums(size, llm), *_closes(apart))
    out = out.where("not closes") if apart else out
    return out.select(F.col("w.start").alias("time"), "total_bytes", "llm_bytes", "count")


COUNTED = ("traffic_class", "model_llm_prediction")


def added(flowlets: DataFrame, *, capture: str = "capture_id") -> DataFrame:
    """Change rows that add stored bursts to the counts of their captures."""
    return flowlets.select(capture, *COUNTED, F.lit(1).cast("long").alias("sign"))


def removed(flowlets: DataFrame, captures: DataFrame, *, capture: str = "capture_id") -> DataFrame:
    """Change rows that take the stored bursts of deleted captures out again."""
    gone = flowlets.join(captures.select(capture).distinct(), capture, "left_semi")
    return gone.select(capture, *COUNTED, F.lit(-1).cast("long").alias("sign"))


def replaced(stored: DataFrame, fresh: DataFrame, *, capture: str = "capture_id") -> DataFrame:
    """Change rows of captures that were read once more: what is stored of them goes, what was read now counts."""
    return removed(stored, fresh, capture=capture).unionByName(added(fresh, capture=capture))


def count_stream(changes: DataFrame, *, capture: str = "capture_id") -> DataFrame:
    """Running counts per capture, as in the listing; with a column ``sign`` (1 or -1) rows count up or down."""
    sign = F.col("sign") if "sign" in changes.columns else F.lit(1).cast("long")
    held = lambda c: F.sum(F.when(c, sign).otherwise(F.lit(0).cast("long")))
    return changes.groupBy(capture).agg(
        F.sum(sign).alias("flow_count"),
        held(F.coalesce(F.col("traffic_class") == "llm", F.lit(False))).alias("llm_flow_count"),
        held(F.col("model_llm_prediction").isNotNull()).alias("classified_count"),
    )


def counted(spark: SparkSession, path: str, *, capture: str = "capture_id") -> DataFrame:
    """The captures that still hold bursts, with their counts."""
    return latest(spark, path, [capture]).where("flow_count > 0")
