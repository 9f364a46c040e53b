"""Bursts, flows and paired queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstlens.functions import addresses, labels, render
from burstlens.functions.addresses import KEY
from burstlens.operators import bursts, flows, queries
from burstlens.plans.ingest import with_direction
from burstlens.session import scratch_path, stage
from burstlens.sources import sinks, tables
from table_queries.adapters import (
    BURSTS, ENDS, EV, FLOWLETS, FLOWS, USER, ends, events, flow_flowlets, table, user_bursts, user_flowlets,
)
from table_queries.registry import query

_FLOWLETS_SQL = f"WITH {FLOWLETS} SELECT user_id, flowlet_id, start_ts, end_ts, duration, packet_count, total_bytes FROM fl"
_COLUMNS = ["user_id", "flowlet_id", "start_ts", "end_ts", "duration", "packet_count", "total_bytes"]


@query(_FLOWLETS_SQL)
def flowlets(spark, sf):
    return user_flowlets(spark, sf).select(*_COLUMNS)


@query(_FLOWLETS_SQL)
def flowlets_sliced(spark, sf):
    """The same with every busy user cut into slices, as a hot key is at scale."""
    return user_flowlets(spark, sf, target_rows=40).select(*_COLUMNS)


@query(f"""WITH {FLOWLETS} SELECT user_id, flowlet_id,
  round(inter_packet_time_mean, 3) AS gap_mean, round(inter_packet_time_std / 1e6, 5) AS gap_std,
  round(packet_size_mean, 6) AS size_mean, round(packet_size_std, 6) AS size_std FROM fl""")
def packet_stats(spark, sf):
    return user_flowlets(spark, sf).select(
        "user_id", "flowlet_id",
        F.round("inter_packet_time_mean", 3).alias("gap_mean"),
        F.round(F.col("inter_packet_time_std") / 1e6, 5).alias("gap_std"),
        F.round("packet_size_mean", 6).alias("size_mean"), F.round("packet_size_std", 6).alias("size_std"))


@query(f"""WITH {BURSTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, flowlet_id ORDER BY t, event_id) - 1 AS p FROM b)
SELECT user_id, flowlet_id, CAST(p // 4 AS INTEGER) AS part,
  coalesce(string_agg(CASE WHEN NOT opens THEN CAST(gap AS VARCHAR) END, ',' ORDER BY t, event_id), '') AS gaps,
  string_agg(CAST(size AS VARCHAR), ',' ORDER BY t, event_id) AS sizes
FROM n GROUP BY user_id, flowlet_id, p // 4""")
def packet_sequences(spark, sf):
    s = bursts.burst_sequences(user_bursts(spark, sf), key=USER, ts="t", order=["event_id"], size="size", part_size=4)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return s.select("user_id", "flowlet_id", "part", text("inter_packet_times").alias("gaps"),
                    text("packet_sizes").alias("sizes"))


_FLOW_SUMMARY = f"""WITH {FLOWS} SELECT src_ip, src_port, dst_ip, dst_port, protocol, CAST(sum(packet_count) AS BIGINT) AS packets,
  CAST(sum(total_bytes) AS BIGINT) AS bytes, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS flowlets,
  min(first_at) AS flow_ord FROM kf GROUP BY src_ip, src_port, dst_ip, dst_port, protocol"""


@query(_FLOW_SUMMARY)
def flow_summary(spark, sf):
    return flows.flow_summary(flow_flowlets(spark, sf), key=list(KEY), first="first_at")


@query(_FLOW_SUMMARY + " ORDER BY bytes DESC, flow_ord LIMIT 10")
def top_flows(spark, sf):
    return flows.top_flows(flow_summary(spark, sf), 10)


_NESTED = f"""WITH {FLOWLETS} SELECT user_id, 'burst' AS kind, flowlet_id AS id, start_ts, end_ts, packet_count, total_bytes FROM fl
  UNION ALL SELECT user_id, 'flow', count(*), min(start_ts), max(end_ts), CAST(sum(packet_count) AS BIGINT), CAST(sum(total_bytes) AS BIGINT) FROM fl GROUP BY user_id"""


def _nested(spark, sf, part_size):
    """Nested flows as one row per list entry, and the totals of each flow."""
    fields = ["start_ts", "end_ts", "packet_count", "total_bytes"]
    nested = flows.nested_flows(user_flowlets(spark, sf), key=USER, part_size=part_size, fields=fields)
    entries = nested.select("user_id", F.lit("burst").alias("kind"), F.explode("flowlets").alias("x")).select("user_id", "kind", F.col("x.id").cast("long").alias("id"), *[F.col(f"x.{c}") for c in fields])
    totals = nested.groupBy("user_id").agg(
        F.sum(F.size("flowlets")).alias("id"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("packets").alias("packet_count"), F.sum("bytes").alias("total_bytes"))
    return entries.unionByName(totals.withColumn("kind", F.lit("flow")))


@query(_NESTED)
def nested_flows(spark, sf):
    return _nested(spark, sf, 10_000)


@query(_NESTED)
def nested_flows_parts(spark, sf):
    """The same from lists of four bursts."""
    return _nested(spark, sf, 4)


@query(f"""WITH {ENDS}, x AS (SELECT *, coalesce(src_port, 0) AS sp, coalesce(dst_port, 0) AS dp FROM en), y AS (
  SELECT *, src_ip || ':' || sp <= dst_ip || ':' || dp AS keeps FROM x)
SELECT CASE WHEN keeps THEN src_ip ELSE dst_ip END AS src_ip, CASE WHEN keeps THEN sp ELSE dp END AS src_port,
  CASE WHEN keeps THEN dst_ip ELSE src_ip END AS dst_ip, CASE WHEN keeps THEN dp ELSE sp END AS dst_port,
  upper(protocol) AS protocol, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM y GROUP BY ALL""")
def bidirectional_keys(spark, sf):
    keyed = ends(events(spark, sf)).withColumns(addresses.flow_key_columns(bidirectional=True))
    return keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


_DIRECTION = """CASE WHEN src_ip LIKE '10.%' AND dst_ip NOT LIKE '10.%' THEN 'client_to_server'
  WHEN dst_ip LIKE '10.%' AND src_ip NOT LIKE '10.%' THEN 'server_to_client'
  WHEN dst_port = 443 AND src_port <> 443 THEN 'client_to_server'
  WHEN src_port = 443 AND dst_port <> 443 THEN 'server_to_client' ELSE 'unknown' END"""


@query(f"""WITH {FLOWS}, d AS (SELECT *, {_DIRECTION} AS direction FROM kf)
SELECT src_ip, src_port, dst_ip, dst_port, protocol, flowlet_id, direction, direction = 'client_to_server' AS outgoing,
  CASE WHEN direction = 'client_to_server' THEN 1 ELSE -1 END AS direction_encoded FROM d""")
def flow_direction(spark, sf):
    return with_direction(flow_flowlets(spark, sf)).select(
        *KEY, "flowlet_id", "direction", "outgoing", "direction_encoded")


@query(f"""WITH {EV}, n AS (SELECT event_id, event_id * 2654435761 % 4294967296 AS v FROM ev)
SELECT event_id, (v // 16777216) || '.' || (v // 65536 % 256) || '.' || (v // 256 % 256) || '.' || (v % 256) AS ip,
  v // 16777216 IN (0, 10, 127) OR v // 65536 IN (43518, 49320) OR v // 1048576 = 2753 OR v // 131072 = 25353
  OR (v // 256 = 12582912 AND v NOT IN (3221225481, 3221225482)) OR v // 256 IN (12582914, 12989284, 13303921)
  OR v >= 4026531840 AS is_private FROM n""")
def private_addresses(spark, sf):
    v = F.col("event_id") * 2654435761 % 4294967296
    o = lambda d: F.floor(F.col("v") / d).cast("long") % 256
    ip = F.format_string("%d.%d.%d.%d", o(16777216), o(65536), o(256), F.col("v") % 256)
    named = events(spark, sf).select("event_id", v.alias("v")).select("event_id", ip.alias("ip"))
    return named.withColumn("is_private", addresses.is_private_ip(F.col("ip")))


_CONV_PAIRS = """c AS (SELECT conv_id, turn, role, length(text) AS bytes FROM conversations),
u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS query_id FROM c WHERE role = 'user'),
p AS (SELECT c.conv_id, c.turn, c.role, c.bytes, u.query_id FROM c LEFT JOIN u ON c.conv_id = u.conv_id AND u.turn =
  (SELECT max(turn) FROM u v WHERE v.conv_id = c.conv_id AND v.turn <= c.turn) WHERE c.role IN ('user', 'assistant'))"""


def _conversation_pairs(spark, sf):
    c = table(spark, sf, "conversations").withColumn("bytes", F.length("text").cast("long"))
    known = queries.timeline(c, direction="role", upload="user", response="assistant")
    return queries.pair_queries(
        known, scope=["conv_id"], start="turn", end="turn", order=[],
        upload=F.col("role") == "user", response=F.col("role") == "assistant")


@query(f"""WITH {_CONV_PAIRS} SELECT conv_id, turn, query_id,
  CASE WHEN query_id IS NULL THEN NULL WHEN role = 'user' THEN 'upload' ELSE 'response' END AS query_role FROM p""")
def query_pairs(spark, sf):
    return _conversation_pairs(spark, sf).select("conv_id", "turn", "query_id", "query_role")


@query(f"""WITH {_CONV_PAIRS} SELECT conv_id, query_id, max(CASE WHEN role = 'user' THEN turn END) AS upload_start_ts,
  CAST(max(CASE WHEN role = 'user' THEN bytes END) AS BIGINT) AS upload_bytes,
  min(CASE WHEN role = 'assistant' THEN turn END) AS response_start_ts,
  max(CASE WHEN role = 'assistant' THEN turn END) AS response_end_ts,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN bytes END), 0) AS BIGINT) AS response_bytes,
  count(CASE WHEN role = 'assistant' THEN 1 END) AS responses,
  CASE WHEN count(CASE WHEN role = 'assistant' THEN 1 END) > 0 THEN 'high' ELSE 'low' END AS confidence
FROM p WHERE query_id IS NOT NULL GROUP BY conv_id, query_id""")
def query_summary(spark, sf):
    out = queries.query_summary(_conversation_pairs(spark, sf), scope=["conv_id"], start="turn", end="turn", size="bytes")
    return out.drop("upload_end_ts")


# Bursts per user with a role by their number: uploads are every third burst.
_ROLES = FLOWLETS + """, r AS (SELECT *, CASE WHEN flowlet_id % 3 = 1 THEN 'client_to_server'
  WHEN flowlet_id % 7 = 0 THEN 'unknown' ELSE 'server_to_client' END AS direction FROM fl),
up AS (SELECT user_id, start_ts, end_ts, flowlet_id, total_bytes,
  row_number() OVER (PARTITION BY user_id ORDER BY start_ts) AS query_id,
  lead(start_ts) OVER (PARTITION BY user_id ORDER BY start_ts) AS next_upload_ts FROM r WHERE direction = 'client_to_server'),
pr AS (SELECT r.user_id, r.flowlet_id, r.start_ts, r.end_ts, r.total_bytes, r.direction, up.query_id,
  CASE WHEN up.query_id IS NULL THEN NULL WHEN r.direction = 'client_to_server' THEN 'upload' ELSE 'response' END AS query_role
  FROM r LEFT JOIN up ON r.user_id = up.user_id AND (
    (r.direction = 'client_to_server' AND r.flowlet_id = up.flowlet_id) OR
    (r.direction = 'server_to_client' AND r.start_ts >= up.end_ts AND (up.next_upload_ts IS NULL OR r.start_ts < up.next_upload_ts)))
  WHERE r.direction <> 'unknown')"""


def _directed(spark, sf):
    d = F.when(F.col("flowlet_id") % 3 == 1, "client_to_server").when(F.col("flowlet_id") % 7 == 0, "unknown")
    return user_flowlets(spark, sf).withColumn("direction", d.otherwise("server_to_client"))


def _paired(spark, sf, **options):
    return queries.pair_queries(
        queries.timeline(_directed(spark, sf)), scope=USER, order=["flowlet_id"],
        upload=F.col("direction") == "client_to_server", response=F.col("direction") == "server_to_client", **options)


@query(f"WITH {_ROLES} SELECT user_id, flowlet_id, query_id, query_role FROM pr")
def query_pairs_bursts(spark, sf):
    return _paired(spark, sf).select("user_id", "flowlet_id", "query_id", "query_role")


@query(f"WITH {_ROLES} SELECT user_id, flowlet_id, query_id, query_role FROM pr")
def query_pairs_sliced(spark, sf):
    """The same with busy users cut into slices."""
    return _paired(spark, sf, target_rows=20).select("user_id", "flowlet_id", "query_id", "query_role")


@query(f"""WITH {_ROLES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, query_id ORDER BY start_ts, flowlet_id) - 1 AS k
  FROM pr WHERE query_role = 'response')
SELECT user_id, query_id, CAST(k // 2 AS INTEGER) AS part, string_agg(flowlet_id || ':' || total_bytes, ',' ORDER BY k) AS responses
FROM n GROUP BY user_id, query_id, k // 2""")
def nested_responses(spark, sf):
    """Responses of each query in lists of two."""
    n = queries.nested_responses(_paired(spark, sf), scope=USER, fields=["flowlet_id", "total_bytes"],
                                 order=["start_ts", "flowlet_id"], part_size=2)
    text = F.transform("response_flowlets", lambda r: F.concat_ws(":", r["flowlet_id"], r["total_bytes"]))
    return n.select("user_id", "query_id", "part", F.array_join(text, ",").alias("responses"))


_RECORDS = f"""WITH {BURSTS} SELECT 'u' || user_id AS src_ip, flowlet_id, row_number() OVER (PARTITION BY user_id, flowlet_id ORDER BY t, event_id) - 1 AS place, size, NULL AS total_bytes, NULL AS gap_sum FROM b
  UNION ALL SELECT 'u' || user_id, flowlet_id, count(*), NULL, CAST(sum(size) AS BIGINT), CAST(coalesce(sum(CASE WHEN NOT opens THEN gap END), 0) AS BIGINT) FROM b GROUP BY user_id, flowlet_id"""


def _records(spark, sf, part_size):
    """Exchanged records written as JSON lines and read with the record schema: one row per packet, and the totals of each burst."""
    b = user_bursts(spark, sf)
    key_fields = {"src_ip": F.concat(F.lit("u"), F.col("user_id").cast("string")), "src_port": F.lit(1), "dst_ip": F.lit("d"),
                  "dst_port": F.lit(2), "protocol": F.lit("TCP")}
    found = bursts.burst_features(b, key=USER, ts="t", size="size").withColumns(key_fields)
    seq = bursts.burst_sequences(b, key=USER, ts="t", order=["event_id"], size="size", part_size=part_size)
    path = scratch_path(spark, "records")
    sinks.write_json(bursts.feature_records(found, seq, key=USER, flow_key=KEY), path)
    r = tables.load_flowlets(spark, path, "json", multi_line=False)
    total = F.aggregate("inter_packet_times", F.lit(0.0), lambda a, x: a + x)
    null = F.lit(None).cast("long")
    entries = r.select("flow_key.src_ip", "flowlet_id", "part", F.posexplode("packet_sizes").alias("at", "size")).select(
        "src_ip", "flowlet_id", (F.col("part").cast("long") * part_size + F.col("at")).alias("place"), F.col("size").cast("long").alias("size"), null.alias("total_bytes"), null.alias("gap_sum"))
    totals = r.groupBy("flow_key.src_ip", "flowlet_id").agg(
        F.sum("packet_count").alias("place"), F.sum("total_bytes").alias("total_bytes"), F.round(F.sum(total)).cast("long").alias("gap_sum")).withColumn("size", null)
    return entries.unionByName(totals)


@query(_RECORDS)
def feature_records(spark, sf):
    return _records(spark, sf, 100_000)


@query(_RECORDS)
def feature_records_parts(spark, sf):
    """The same from sequences of four packets a part."""
    return _records(spark, sf, 4)


@query(f"WITH {_ROLES} SELECT user_id, flowlet_id, start_ts, next_upload_ts FROM up")
def next_upload(spark, sf):
    up = _directed(spark, sf).where(F.col("direction") == "client_to_server")
    return queries.next_upload(up, scope=USER, order=["flowlet_id"]).select(
        "user_id", "flowlet_id", "start_ts", "next_upload_ts")


@query(f"""WITH {_ROLES} SELECT user_id, query_id, upload_bytes, response_bytes FROM (
  SELECT user_id, query_id, max(CASE WHEN query_role = 'upload' THEN total_bytes END) AS upload_bytes,
    CAST(coalesce(sum(CASE WHEN query_role = 'response' THEN total_bytes END), 0) AS BIGINT) AS response_bytes
  FROM pr WHERE query_id IS NOT NULL GROUP BY user_id, query_id) ORDER BY user_id, query_id LIMIT 10""")
def first_queries(spark, sf):
    s = queries.query_summary(_paired(spark, sf), scope=USER)
    return queries.first_queries(s, 10, scope=USER).select("user_id", "query_id", "upload_bytes", "response_bytes")


@query(f"""WITH {_ROLES} SELECT direction, count(*) AS n, CAST(sum(CASE WHEN direction = 'client_to_server' THEN 1 ELSE -1 END) AS BIGINT)
  AS code, min(start_ts) AS first_ts, max(start_ts) AS last_ts FROM r WHERE direction <> 'unknown' GROUP BY direction""")
def timeline(spark, sf):
    known = queries.timeline(_directed(spark, sf))
    return known.groupBy("direction").agg(
        F.count(F.lit(1)).alias("n"), F.sum(addresses.direction_code(F.col("direction")).cast("long")).alias("code"),
        F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"))


@query(f"""WITH {_ROLES}, cf AS (SELECT user_id, query_id, count(CASE WHEN query_role = 'response' THEN 1 END) AS n
  FROM pr WHERE query_id IS NOT NULL GROUP BY user_id, query_id),
j AS (SELECT pr.*, cf.n FROM pr LEFT JOIN cf ON pr.user_id = cf.user_id AND pr.query_id = cf.query_id)
SELECT 'evt_' || row_number() OVER (ORDER BY user_id, flowlet_id) AS id,
  replace(strftime(make_timestamp(start_ts), '%Y-%m-%dT%H:%M:%S.%fZ'), '.000000Z', 'Z') AS timestamp, 'unknown' AS "userId",
  'u' || user_id AS "srcIp", 'unknown' AS "dstIp", total_bytes AS bytes, 'UNKNOWN' AS protocol,
  query_id IS NOT NULL AS "llmUsage", CASE WHEN query_id IS NOT NULL THEN CAST(CASE WHEN n > 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) END AS "llmConfidence"
FROM j""")
def traffic_events(spark, sf):
    paired = stage(_paired(spark, sf), "paired")
    found = queries.query_summary(paired, scope=USER)
    shaped = paired.withColumns({
        "src_ip": F.concat(F.lit("u"), F.col("user_id").cast("string")), "dst_ip": F.lit(""),
        "protocol": F.lit(None).cast("string"),
    })
    out = queries.traffic_events(
        shaped, found, scope=USER, order=["user_id", "flowlet_id"], base_timestamp="1970-01-01T00:00:00.000Z",
        start_seconds=F.col("start_ts").cast("decimal(20,0)") / 1_000_000)
    return out.select("id", "timestamp", "userId", "srcIp", "dstIp", "bytes", "protocol", "llmUsage", "llmConfidence")


_BY_CAPTURE = FLOWLETS + """, pf AS (SELECT user_id % 8 AS capture, user_id, count(*) AS flowlets,
  sum(packet_count) AS packets FROM fl GROUP BY user_id)"""


def _captures(spark, sf):
    per_flow = flows.flow_summary(user_flowlets(spark, sf), key=USER)
    return per_flow.withColumn("capture", F.col("user_id") % 8)


@query(f"""WITH {_BY_CAPTURE} SELECT capture, count(*) AS flows_count, CAST(sum(flowlets) AS BIGINT) AS flowlets_count,
  CAST(sum(packets) AS BIGINT) AS packets FROM pf GROUP BY capture""")
def capture_totals(spark, sf):
    return flows.capture_totals(_captures(spark, sf), file="capture")


@query(f"""WITH {_BY_CAPTURE} SELECT count(DISTINCT capture) AS files_processed, count(*) AS total_flows,
  CAST(sum(flowlets) AS BIGINT) AS total_flowlets FROM pf""")
def dataset_totals(spark, sf):
    return flows.dataset_totals(capture_totals(spark, sf))


@query("""SELECT count(DISTINCT CASE WHEN user_id % 3 = 0 THEN user_id END) AS llm_flows,
  count(DISTINCT CASE WHEN user_id % 3 <> 0 THEN user_id END) AS non_llm_flows FROM events""")
def class_totals(spark, sf):
    per_flow = flows.flow_summary(user_flowlets(spark, sf), key=USER)
    return flows.class_totals(per_flow.withColumn("traffic_class", F.when(F.col("user_id") % 3 == 0, "llm").otherwise("non_llm")))


@query(f"""WITH {BURSTS}, h AS (SELECT gap / 1e6 / 3600 * 1000 AS ms FROM b WHERE NOT opens)
SELECT CASE WHEN ms < 10 THEN 'GAP_0_10ms' WHEN ms < 100 THEN 'GAP_10_100ms' WHEN ms < 1000 THEN 'GAP_100ms_1s'
  ELSE 'GAP_GT_1s' END AS state, count(*) AS n FROM h GROUP BY 1""")
def gap_buckets(spark, sf):
    inner = user_bursts(spark, sf).where(~F.col("opens"))
    return inner.groupBy(labels.gap_state(F.col("gap") / 1e6 / 3600).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV} SELECT event_id, strftime(make_timestamp(t), '%H:%M:%S.%f') AS clock,
  'T:' || CASE WHEN value < 50 THEN '[S.]' WHEN value < 100 THEN '[P.]' ELSE '[.]' END AS flags FROM ev""")
def record_formats(spark, sf):
    e = events(spark, sf)
    words = F.when(F.col("value") < 50, "SYN, ACK").when(F.col("value") < 100, "PSH, ACK").otherwise("")
    epoch = (F.col("t").cast("decimal(28,6)") / 1_000_000).cast("decimal(28,6)").cast("string")
    return e.select("event_id", render.epoch_clock(epoch).alias("clock"),
                    F.concat(F.lit("T:"), render.flag_letters(words)).alias("flags"))


