"""Target streams over arriving records, with the first hit of every stream in the engine's keyed state.

Records never pass the state. Each task reduces the records it reads to one probe per stream (the stream, and its smallest hit if any), so a
stream that holds a third of all rows sends as many probes to its key as there are tasks, not its rows. The state merges the
probes; its answer (first hit, and whether that was known before this batch) is joined back to the records of the batch in
the sink, by the adaptive planner.

The state holds one value per stream. With ``forget_after`` a timer in event time forgets a stream whose last record lies that far behind the
watermark. The engine checkpoints the state, so a query that was killed goes on where it stood; each batch writes the folder of its
own number, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from burstlens.session import scratch_path
from burstlens.streaming import jobs

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Streams that a task holds before it sends their probes.
HELD = 100_000


def probes(records: DataFrame, stream: str, order: str, hit: Column, seen: Column) -> DataFrame:
    """stream, ``first`` (the smallest order of a hit, or null) and ``seen`` (the latest): one row per stream and task (or per ``HELD`` streams of a task)."""
    kind = records.schema[order].dataType
    out = T.StructType([T.StructField("stream", T.StringType()), T.StructField("first", kind), T.StructField("seen", T.LongType())])
    rows = records.select(F.col(stream).cast("string").alias("stream"), F.when(hit, F.col(order)).alias("first"), seen.alias("seen"))

    def merge(parts: list[pa.Table]) -> pa.Table:
        # A batch may say that a column has no nulls, what is held never does.
        whole = pa.concat_tables(parts, promote_options="default")
        return whole.group_by("stream").aggregate([("first", "min"), ("seen", "max")]).rename_columns(["stream", "first", "seen"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = merge([pa.Table.from_batches([batch]), *([held] if held else [])])
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = None
        if held:
            yield from held.to_batches()

    return rows.where("stream is not null and stream <> ''").mapInArrow(reduce, out)


class FirstHit(StatefulProcessor):
    """Keeps the first hit of a stream, that of the first batch with one; answers in every batch that mentions such a stream."""

    def __init__(self, kind: str, forget_after_ms: int | None):
        self.kind, self.forget_after_ms = kind, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"first {self.kind}, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found, seen = [], 0
        for r in rows:
            found += [r["first"]] if r["first"] is not None else []
            seen = max(seen, r["seen"] or 0)
        known = self.held.exists()
        if known:
            first, before = self.held.get()
            seen = max(seen, before)
        elif found:
            first = min(found)
            if self.forget_after_ms:
                self.handle.registerTimer(seen + self.forget_after_ms)
        if known or found:
            self.held.update((first, seen))
            yield Row(stream=key[0], first=first, known=known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.held.get()[1] + self.forget_after_ms
        if due > expiredTimerInfo.getExpiryTimeInMs():  # mentioned since
            self.handle.registerTimer(due)
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_hits(found: DataFrame, forget_after_ms: int | None) -> DataFrame:
    """stream, first and known, for the streams that a batch mentions and that have a hit."""
    kind = found.schema["first"].dataType
    out = T.StructType([found.schema["stream"], T.StructField("first", kind), T.StructField("known", T.BooleanType())])
    return found.groupBy("stream").transformWithState(FirstHit(kind.simpleString(), forget_after_ms), out, "update", "EventTime" if forget_after_ms else "None")


def _mark(records: DataFrame, answers: DataFrame, stream: str, order: str) -> DataFrame:
    """Records at and after the first hit of their stream, with ``is_first_hit``."""
    joined = records.join(answers, records[stream].cast("string") == answers["stream"]).where(F.col("known") | (F.col(order) >= F.col("first")))
    return joined.withColumn("is_first_hit", ~F.col("known") & (F.col(order) == F.col("first"))).drop(answers["stream"], "first", "known")


def start_with_state(
    df: DataFrame, write: Callable[[DataFrame, int], None], *, mode: str, checkpoint: str | None, trigger: dict | None, partitions: int | None = None,
) -> StreamingQuery:
    """Start a query with a keyed processor: its state lies in the store that such processors need, in ``partitions`` parts if given."""
    spark = df.sparkSession
    wanted = {STATE_PROVIDER: ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return jobs.start(df, write, mode=mode, checkpoint=checkpoint or scratch_path(spark, "checkpoint"), trigger=trigger or {"availableNow": True})
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def mark_target_streams(
    records: DataFrame, path: str, *, stream: str, order: str, hit: Column, event_time: str | None = None, watermark: str = "1 hour",
    forget_after_ms: int | None = None, checkpoint: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Records of target streams from the first hit on, written per batch below ``path``; forgetting takes an event time."""
    if event_time:
        records = records.withWatermark(event_time, watermark)
    seen = F.unix_millis(event_time) if event_time else F.lit(0).cast("long")
    answers = first_hits(probes(records, stream, order, F.coalesce(hit, F.lit(False)), seen), forget_after_ms)
    empty = F.lit(None)
    record = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"), empty.cast(answers.schema.simpleString()).alias("answer"))
    answer = answers.select(empty.cast(record.schema["record"].dataType).alias("record"), F.struct("*").alias("answer"))

    def write(rows: DataFrame, batch: int) -> None:
        here = f"{path}/arrived/batch={batch}"
        rows.write.mode("overwrite").parquet(here)  # the state is asked once; both sides of the join read what it said
        arrived = rows.sparkSession.read.schema(rows.schema).parquet(here)
        told = arrived.where("answer is not null").select("answer.*")
        _mark(arrived.where("record is not null").select("record.*"), told, stream, order).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        jobs.drop_folder(rows.sparkSession, here)

    return start_with_state(record.unionByName(answer), write, mode="update", checkpoint=checkpoint, trigger=trigger)


def marked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch")
