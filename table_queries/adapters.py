"""The test tables seen as packets, timelines, captures and stored bursts.

Next to each adapter stands the SQL that builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.functions.addresses import KEY, flow_key_columns
from burstlens.operators import bursts

GAP = 6 * 3600 * 1_000_000  # microseconds between bursts
USER = ["user_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Wall-clock microseconds since 1970, whatever the session time zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86400
    seconds = day + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECONDS"), ts) * 1_000_000).cast("long")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """events as packets: time in microseconds, size in whole units."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("t"),
        F.floor("value").cast("long").alias("size"),
    )


EV = """ev AS (
  SELECT event_id, user_id, event_type, value, CAST(epoch_us(ts) AS BIGINT) AS t, CAST(floor(value) AS BIGINT) AS size
  FROM events)"""


def ends(e: DataFrame) -> DataFrame:
    """Addresses and ports: one client per user, one server per event type;
    every third event is an answer."""
    u = F.col("user_id")
    octet = lambda d: F.floor(u / d).cast("long") % 256
    client = F.format_string("10.%d.%d.%d", octet(65536), octet(256), u % 256)
    kind = F.col("event_type")
    server = (
        F.when(kind == "click", "142.250.0.20").when(kind == "view", "8.8.8.8").when(kind == "purchase", "10.99.0.1")
        .when(kind == "signup", "10.99.0.2").otherwise("224.0.0.251")
    )
    port = (
        F.when(kind == "click", 443).when(kind == "view", 53).when(kind == "purchase", 8080).when(kind == "signup", 443)
    )
    mine = (50000 + u % 10000).cast("int")
    answer = F.col("event_id") % 3 == 0
    pick = lambda a, b: F.when(answer, b).otherwise(a)
    return e.withColumns({
        "src_ip": pick(client, server), "src_port": pick(mine, port), "dst_ip": pick(server, client),
        "dst_port": pick(port, mine), "protocol": F.when(kind == "error", "udp").otherwise("tcp"),
    })


ENDS = EV + """, e0 AS (
  SELECT *, '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS client,
    CASE event_type WHEN 'click' THEN '142.250.0.20' WHEN 'view' THEN '8.8.8.8' WHEN 'purchase' THEN '10.99.0.1'
      WHEN 'signup' THEN '10.99.0.2' ELSE '224.0.0.251' END AS server,
    CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 53 WHEN 'purchase' THEN 8080 WHEN 'signup' THEN 443 END AS port,
    CAST(50000 + user_id % 10000 AS INTEGER) AS mine, event_id % 3 = 0 AS answer,
    CASE event_type WHEN 'error' THEN 'udp' ELSE 'tcp' END AS protocol
  FROM ev), en AS (
  SELECT event_id, user_id, event_type, value, t, size, protocol,
    CASE WHEN answer THEN server ELSE client END AS src_ip, CASE WHEN answer THEN port ELSE mine END AS src_port,
    CASE WHEN answer THEN client ELSE server END AS dst_ip, CASE WHEN answer THEN mine ELSE port END AS dst_port
  FROM e0)"""


def user_bursts(spark: SparkSession, sf: str, **options) -> DataFrame:
    return bursts.with_bursts(events(spark, sf), key=USER, ts="t", order=["event_id"], gap=GAP, **options)


BURSTS = EV + f""", g AS (
  SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev), b AS (
  SELECT *, (gap IS NULL OR gap > {GAP}) AS opens,
    CAST(sum(CASE WHEN gap IS NULL OR gap > {GAP} THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flowlet_id
  FROM g)"""


def user_flowlets(spark: SparkSession, sf: str, **options) -> DataFrame:
    return bursts.burst_features(user_bursts(spark, sf, **options), key=USER, ts="t", size="size")


FLOWLETS = BURSTS + """, fl AS (
  SELECT user_id, flowlet_id, min(t) AS start_ts, max(t) AS end_ts, max(t) - min(t) AS duration,
    count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS total_bytes,
    coalesce(avg(CASE WHEN NOT opens THEN gap END), 0) AS inter_packet_time_mean,
    coalesce(stddev_samp(CASE WHEN NOT opens THEN gap END), 0) AS inter_packet_time_std,
    coalesce(avg(size), 0) AS packet_size_mean, coalesce(stddev_samp(size), 0) AS packet_size_std
  FROM b GROUP BY user_id, flowlet_id)"""


def with_class(df: DataFrame) -> DataFrame:
    return df.withColumn("cls", F.when(F.col("user_id") % 3 == 0, "llm").otherwise("non_llm"))


CLS = "CASE WHEN user_id % 3 = 0 THEN 'llm' ELSE 'non_llm' END"


def flow_packets(spark: SparkSession, sf: str) -> DataFrame:
    """events with the directed flow key columns."""
    return ends(events(spark, sf)).withColumns(flow_key_columns())


KEYS = ENDS + """, k AS (
  SELECT event_id, user_id, event_type, t, size, src_ip, coalesce(src_port, 0) AS src_port, dst_ip,
    coalesce(dst_port, 0) AS dst_port, upper(protocol) AS protocol FROM en)"""


def flow_flowlets(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts per directed flow; each client belongs to one user."""
    b = bursts.with_bursts(flow_packets(spark, sf), key=list(KEY), ts="t", order=["event_id"], gap=GAP)
    return bursts.burst_features(b, key=list(KEY), ts="t", size="size", first=F.col("event_id"))


FLOWS = KEYS + f""", kg AS (
  SELECT *, t - lag(t) OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, protocol ORDER BY t, event_id) AS gap FROM k),
kb AS (
  SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > {GAP} THEN 1 ELSE 0 END)
      OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, protocol ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
    AS flowlet_id FROM kg),
kf AS (
  SELECT src_ip, src_port, dst_ip, dst_port, protocol, flowlet_id, min(t) AS start_ts, max(t) AS end_ts,
    count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS total_bytes, min(event_id) AS first_at
  FROM kb GROUP BY ALL)"""


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts per user as the stored table: eight captures, half of them classified."""
    f = with_class(user_flowlets(spark, sf))
    name = F.when(F.col("total_bytes") % 5 == 0, "").when(F.col("total_bytes") > 60, "ChatGPT").otherwise("non_llm")
    classified = (F.col("user_id") % 8 >= 4) & (F.col("flowlet_id") % 4 != 0)
    return f.select(
        (F.col("user_id") * 100000 + F.col("flowlet_id")).alias("id"),
        (F.col("user_id") % 8).alias("capture_id"),
        "user_id", "flowlet_id", (F.col("start_ts") / 1_000_000).alias("start_ts"), "packet_count", "total_bytes",
        F.col("cls").alias("traffic_class"),
        F.when(classified, name).alias("model_llm_prediction"),
        F.when(classified, F.col("total_bytes") % 101 / 100).alias("model_llm_confidence"),
        F.when(F.col("user_id") % 2 == 0, F.when(F.col("cls") == "llm", "chatgpt").otherwise("claude")).alias("ground_truth_llm"),
    )


STORED = FLOWLETS + f""", st AS (
  SELECT user_id * 100000 + flowlet_id AS id, user_id % 8 AS capture_id, user_id, flowlet_id, start_ts / 1000000.0 AS start_ts,
    packet_count, total_bytes, {CLS} AS traffic_class,
    CASE WHEN user_id % 8 >= 4 AND flowlet_id % 4 <> 0 THEN
      CASE WHEN total_bytes % 5 = 0 THEN '' WHEN total_bytes > 60 THEN 'ChatGPT' ELSE 'non_llm' END END AS model_llm_prediction,
    CASE WHEN user_id % 8 >= 4 AND flowlet_id % 4 <> 0 THEN total_bytes % 101 / 100.0 END AS model_llm_confidence,
    CASE WHEN user_id % 2 = 0 THEN CASE WHEN user_id % 3 = 0 THEN 'chatgpt' ELSE 'claude' END END AS ground_truth_llm
  FROM fl)"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Capture registry: one row per capture number that occurs, and two empty ones."""
    ids = events(spark, sf).select((F.col("user_id") % 10).alias("id")).distinct()
    return ids.select(
        "id", F.format_string("/captures/capture_%03d.txt", "id").alias("file_path"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600 * (F.col("id") % 3 + 1)).alias("created_at"),
    )


REGISTRY = """rg AS (
  SELECT id, printf('/captures/capture_%03d.txt', id) AS file_path, 1700000000 + id * 3600 * (id % 3 + 1) AS created
  FROM (SELECT DISTINCT user_id % 10 AS id FROM events))"""
