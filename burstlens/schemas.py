"""Explicit schemas of the stored and exchanged tables."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


FLOW_KEY = _struct(
    ("src_ip", _S), ("src_port", _I), ("dst_ip", _S), ("dst_port", _I), ("protocol", _S)
)
_STATISTICS = (
    ("start_ts", _D), ("end_ts", _D), ("duration", _D), ("packet_count", _L), ("total_bytes", _L),
    ("inter_packet_time_mean", _D), ("inter_packet_time_std", _D),
    ("packet_size_mean", _D), ("packet_size_std", _D),
    ("inter_packet_times", T.ArrayType(_D)), ("packet_sizes", T.ArrayType(_I)),
)
# One exchanged burst record; direction or name fields are null where unused.
FLOWLET = _struct(
    ("flow_key", FLOW_KEY), ("flowlet_id", _L), ("traffic_class", _S), ("llm_name", _S),
    ("ground_truth_llm", _S), ("source_file", _S), ("direction", _S), ("outgoing", _B),
    ("direction_encoded", _I), *_STATISTICS,
    # null or 0 unless the lists of a burst are kept in parts
    ("part", _I), ("prev_size", _I), ("prev_gap", _D), ("more", _B),
)
CAPTURE = _struct(
    ("id", _L), ("file_path", _S), ("created_at", T.TimestampType()), ("status", _S),
    ("llm_ip_map", T.MapType(_S, _S)), ("notes", _S),
)
FLOWLET_TABLE = _struct(
    ("id", _L), ("capture_id", _L), *[(f.name, f.dataType) for f in FLOW_KEY], ("flowlet_id", _L),
    ("traffic_class", _S), ("llm_name", _S), ("ground_truth_llm", _S), ("outgoing", _B),
    ("direction_encoded", _I), *_STATISTICS,
    ("model_llm_prediction", _S), ("model_llm_confidence", _D),
)
TRAFFIC_EVENT = _struct(
    ("id", _S), ("timestamp", _S), ("userId", _S), ("srcIp", _S), ("dstIp", _S), ("bytes", _L),
    ("protocol", _S), ("llmUsage", _B), ("llmProvider", _S), ("llmModel", _S), ("llmConfidence", _D),
)
PROMPT_BANK = _struct(
    ("category", _S), ("model", _S), ("prompts", T.ArrayType(_S)), ("chain_length", _I)
)

# Field order of the decoded records (all text).
RECORD_20 = (
    "epoch", "dsfield", "ttl", "id", "flags", "proto", "len", "src", "sport", "dst", "dport",
    "tcp_flags", "checksum", "seq", "ack", "window", "tcp_len", "sni", "authority", "dns_name",
)
RECORD_13 = (
    "time", "src", "dst", "stream", "protocol", "frame_len", "info", "http2_data", "file_data",
    "sni", "authority", "host", "dns_name",
)
RECORD_8 = ("time", "src", "dst", "protocol", "frame_len", "info", "http2_data", "file_data")
