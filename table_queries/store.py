"""Stored captures and bursts: listings, charts, documents, write-back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from burstlens.functions import render
from burstlens.operators import documents, evaluate, pages, store
from burstlens.session import scratch_path, stage
from burstlens.sources import bucketed, sinks, tables
from table_queries.adapters import EV, REGISTRY, STORED, registry, stored, table
from table_queries.registry import query

_COUNTS = f"""{STORED}, {REGISTRY}, cc AS (SELECT capture_id, count(*) AS flow_count,
  count(CASE WHEN traffic_class = 'llm' THEN 1 END) AS llm_flow_count, count(model_llm_prediction) AS classified FROM st GROUP BY capture_id)"""


@query(f"""WITH {_COUNTS} SELECT id, file_path, coalesce(flow_count, 0) AS flow_count,
  CASE WHEN classified > 0 THEN llm_flow_count END AS llm_flow_count, row_number() OVER (ORDER BY created DESC, id) AS place
FROM rg LEFT JOIN cc ON rg.id = cc.capture_id""")
def capture_listing(spark, sf):
    """Newest first; the place in the list is given as a column."""
    from pyspark.sql import Window

    listed = store.capture_listing(registry(spark, sf), stored(spark, sf))
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("long")
    return listed.select("id", "file_path", "flow_count", "llm_flow_count", place.alias("place"))


@query(f"""WITH {_COUNTS} SELECT id, file_path, coalesce(flow_count, 0) AS flow_count, coalesce(llm_flow_count, 0) AS llm_flow_count
FROM rg LEFT JOIN cc ON rg.id = cc.capture_id""")
def capture_detail(spark, sf):
    return store.capture_detail(registry(spark, sf), stored(spark, sf)).select("id", "file_path", "flow_count", "llm_flow_count")


@query(f"""WITH {STORED} SELECT id, user_id, flowlet_id, total_bytes FROM (
  SELECT * FROM st WHERE capture_id = 3 ORDER BY start_ts, id LIMIT 40 OFFSET 25)""")
def flowlet_page(spark, sf):
    one = store.of_capture(stored(spark, sf), 3)
    return store.flowlet_page(one, skip=25, limit=40).select("id", "user_id", "flowlet_id", "total_bytes")


@query(f"""WITH {STORED} SELECT id, row, row // 500 AS page FROM (SELECT id, row_number() OVER (ORDER BY start_ts, id) - 1 AS row FROM st)""")
def flowlet_pages(spark, sf):
    """All pages of the stored bursts of all captures, as the page folders hold them."""
    path = scratch_path(spark, "pages")
    pages.write_pages(stored(spark, sf).select("id", "start_ts"), path, order=["start_ts", "id"], page_rows=500)
    return spark.read.parquet(f"{path}/rows").select("id", "row", F.col("part").cast("long").alias("page"))


@query(f"""WITH {STORED}, o AS (SELECT id, total_bytes, row_number() OVER (ORDER BY start_ts, id) - 1 AS row FROM st)
SELECT 'page' AS way, id, total_bytes FROM o WHERE row BETWEEN 130 AND 179 UNION ALL SELECT 'cursor', id, total_bytes FROM o WHERE row BETWEEN 100 AND 149""")
def flowlet_cursor(spark, sf):
    """One page by number, and the third page behind the cursors of the first two."""
    path, order, cursor = scratch_path(spark, "pages"), ["start_ts", "id"], None
    pages.write_pages(stored(spark, sf).select("id", "start_ts", "total_bytes"), path, order=order, page_rows=50)
    for _ in range(2):
        cursor = pages.after(spark, path, cursor, order=order, limit=50).agg(F.max(F.struct(*order))).first()[0]
    third = pages.after(spark, path, cursor, order=order, limit=50)
    one = pages.page(spark, path, skip=130, limit=50)
    out = lambda rows, way: rows.select(F.lit(way).alias("way"), "id", "total_bytes")
    return out(one, "page").unionByName(out(third, "cursor"))


_LLM = "traffic_class = 'llm' OR coalesce(model_llm_prediction NOT IN ('', 'non_llm'), false)"


@query(f"""WITH {STORED} SELECT capture_id, CAST(floor(start_ts / 86400) * 86400 AS BIGINT) AS time, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
  CAST(sum(CASE WHEN {_LLM} THEN total_bytes ELSE 0 END) AS BIGINT) AS llm_bytes, count(*) AS count FROM st GROUP BY 1, 2""")
def chart_buckets(spark, sf):
    return store.chart_points(store.chart(stored(spark, sf), by=["capture_id"], width=86400), by=["capture_id"])


@query(f"""WITH {STORED} SELECT id, ground_truth_llm, model_llm_prediction,
  lower(nullif(ground_truth_llm, '')) = lower(nullif(model_llm_prediction, '')) AS match FROM st
  WHERE nullif(ground_truth_llm, '') IS NOT NULL OR nullif(model_llm_prediction, '') IS NOT NULL""")
def pred_vs_truth(spark, sf):
    rows = evaluate.compare_rows(stored(spark, sf), truth="ground_truth_llm", prediction="model_llm_prediction")
    return rows.select("id", "ground_truth_llm", "model_llm_prediction", "match")


@query(f"""WITH {STORED} SELECT id, 'cap.txt' AS name,
  printf('%02d', CAST(s // 3600 AS BIGINT)) || ':' || printf('%02d', CAST(s % 3600 // 60 AS BIGINT)) || ':' || printf('%02d', CAST(s % 60 AS BIGINT)) AS clock,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1)) ELSE printf('%.1f MB', round(b / 1048576.0, 1)) END AS size,
  CASE WHEN model_llm_confidence IS NULL OR model_llm_confidence = 0 THEN '-' ELSE printf('%.0f%%', model_llm_confidence * 100) END AS confidence
FROM (SELECT *, CAST(floor(start_ts) AS BIGINT) % 360000 AS s, total_bytes * (flowlet_id * 37 + 1) AS b FROM st)""")
def listing_display(spark, sf):
    st = stored(spark, sf)
    amount = F.col("total_bytes") * (F.col("flowlet_id") * 37 + 1)
    return st.select(
        "id", render.base_name(F.lit("/a/b/cap.txt")).alias("name"),
        render.clock_label(F.floor("start_ts") % 360000).alias("clock"), render.size_label(amount).alias("size"),
        render.percent_label(F.col("model_llm_confidence")).alias("confidence"))


@query(f"WITH {REGISTRY} SELECT file_path FROM rg WHERE id % 3 <> 0")
def new_captures(spark, sf):
    files = registry(spark, sf)
    return store.new_captures(files, files.where("id % 3 = 0")).select("file_path")


@query(f"""WITH {REGISTRY}, old AS (SELECT * FROM rg WHERE id % 3 = 0), fresh AS (SELECT * FROM rg WHERE id % 3 <> 0)
SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY file_path) AS id, file_path, 'completed' AS status FROM fresh""")
def register_captures(spark, sf):
    files = registry(spark, sf)
    rows = store.register_captures(files, files.where("id % 3 = 0"), created_at=F.lit("2025-01-01 00:00:00"))
    return rows.select("id", "file_path", "status")


@query(f"WITH {STORED}, {REGISTRY} SELECT id FROM rg WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.capture_id = rg.id)")
def unparsed_captures(spark, sf):
    return store.unparsed_captures(registry(spark, sf), stored(spark, sf)).select("id")


@query(f"""WITH {EV} SELECT user_id AS capture_id, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
  WHEN 'click' THEN 'stopped' ELSE 'completed' END, t) AS status, max(t) AS changed_at FROM ev GROUP BY user_id""")
def capture_status(spark, sf):
    from table_queries.adapters import events

    kind = F.col("event_type")
    word = F.when(kind == "error", "failed").when(kind == "view", "running").when(kind == "click", "stopped").otherwise("completed")
    log = events(spark, sf).select(F.col("user_id").alias("capture_id"), word.alias("status"), F.col("t").alias("changed_at"))
    return store.current_status(log)


def _predictions(st):
    return st.where("capture_id = 2 and flowlet_id % 2 = 1").select(
        "id", F.lit("Claude").alias("model_llm_prediction"), F.lit(0.75).alias("model_llm_confidence"))


@query(f"""WITH {STORED} SELECT id, capture_id,
  CASE WHEN capture_id = 2 AND flowlet_id % 2 = 1 THEN 'Claude' ELSE model_llm_prediction END AS model_llm_prediction,
  CASE WHEN capture_id = 2 AND flowlet_id % 2 = 1 THEN 0.75 ELSE CAST(model_llm_confidence AS DOUBLE) END AS model_llm_confidence FROM st""")
def writeback(spark, sf):
    """Stored table, predictions joined into one capture, that partition replaced, read back."""
    path = scratch_path(spark, "flowlets")
    sinks.write_flowlet_table(stored(spark, sf), path)
    one = tables.read_flowlet_table(spark, path, capture_id=2)
    sinks.replace_captures(store.with_predictions(one, _predictions(one)), path)
    return tables.load_flowlets(spark, path, "table").select(
        "id", F.col("capture_id").cast("long").alias("capture_id"), "model_llm_prediction", "model_llm_confidence")


def _bucketed(spark, sf):
    """A store of the bursts whose count of buckets follows the rows; its name, folder and buckets."""
    name, path, st = f"store_{uuid.uuid4().hex}", scratch_path(spark, "store"), stage(stored(spark, sf), "stored")
    buckets = bucketed.bucket_count(st.count(), bucket_rows=20_000)
    bucketed.create_store(st, name, path, buckets=buckets)
    return name, path, buckets


_TWICE = "total_bytes % 3 = 0"


@query(f"""WITH {STORED} SELECT id, capture_id, total_bytes,
  CASE WHEN {_TWICE} THEN 'Gemini' WHEN capture_id = 2 AND flowlet_id % 2 = 1 THEN 'Claude' ELSE model_llm_prediction END AS model_llm_prediction,
  CASE WHEN {_TWICE} THEN NULL WHEN capture_id = 2 AND flowlet_id % 2 = 1 THEN 0.75 ELSE CAST(model_llm_confidence AS DOUBLE) END AS model_llm_confidence FROM st""")
def bucketed_writeback(spark, sf):
    """Two rounds of predictions appended to a bucketed store and joined in when it is read; the later round wins."""
    name, path, buckets = _bucketed(spark, sf)
    now = bucketed.bursts(spark, name, capture_id=2)
    bucketed.append_predictions(_predictions(now), name, path, version=1, buckets=buckets)
    later = bucketed.bursts(spark, name).where(_TWICE).select(
        "id", F.lit("Gemini").alias("model_llm_prediction"), F.lit(None).cast("double").alias("model_llm_confidence"))
    bucketed.append_predictions(later, name, path, version=2, buckets=buckets)
    return bucketed.bursts(spark, name).select("id", "capture_id", "total_bytes", "model_llm_prediction", "model_llm_confidence")


@query(f"""WITH {_COUNTS}, bp AS (SELECT capture_id, count(CASE WHEN total_bytes % 7 = 0 THEN 1 END) AS said FROM st GROUP BY 1)
SELECT id, file_path, coalesce(flow_count, 0) AS flow_count, CASE WHEN classified + said > 0 THEN llm_flow_count END AS llm_flow_count
FROM rg LEFT JOIN cc ON rg.id = cc.capture_id LEFT JOIN bp ON rg.id = bp.capture_id WHERE id <> 4""")
def bucketed_listing(spark, sf):
    """The listing from a bucketed store that got predictions, lost capture 4 and was written anew."""
    name, path, buckets = _bucketed(spark, sf)
    said = bucketed.bursts(spark, name).where("total_bytes % 7 = 0").select(
        "id", F.lit("non_llm").alias("model_llm_prediction"), F.lit(0.5).alias("model_llm_confidence"))
    bucketed.append_predictions(said, name, path, version=1, buckets=buckets)
    files = registry(spark, sf)
    gone = files.where("id = 4").select(F.col("id").alias("capture_id"))
    bucketed.compact(spark, name, path, scratch_path(spark, "store"), buckets=buckets, deleted=gone)
    left = files.where("id <> 4")
    return store.capture_listing(left, bucketed.bursts(spark, name)).select("id", "file_path", "flow_count", "llm_flow_count")


@query(f"WITH {STORED}, {REGISTRY} SELECT capture_id, count(*) AS n FROM st WHERE capture_id NOT IN (SELECT id FROM rg WHERE id % 3 = 0) GROUP BY 1")
def delete_captures(spark, sf):
    gone = registry(spark, sf).where("id % 3 = 0").select(F.col("id").alias("capture_id"))
    return store.without_captures(stored(spark, sf), gone).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))


_DOCS = f"""{STORED}, nb AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY start_ts, id) AS n FROM st)"""


@query(f"""WITH {_DOCS} SELECT capture_id, printf('flowlet_%06d', n) AS field, id, total_bytes, traffic_class = 'llm' AS is_llm_prediction,
  ground_truth_llm AS ground_truth_llm_name FROM nb""")
def documents_overwrite(spark, sf):
    """Documents packed as maps in pieces of 50 fields, and read out again."""
    rows = documents.document_rows(stored(spark, sf), capture="capture_id", order=["start_ts", "id"])
    packed = documents.pack_documents(rows, capture="capture_id", max_fields=50)
    out = documents.unpack_documents(packed, capture="capture_id")
    v = F.col("value")
    return out.select("capture_id", "field", v["id"].alias("id"), v["total_bytes"].alias("total_bytes"),
                      v["is_llm_prediction"].alias("is_llm_prediction"), v["ground_truth_llm_name"].alias("ground_truth_llm_name"))


@query(f"WITH {_DOCS} SELECT capture_id, printf('flowlet_%06d', n) AS field, id, total_bytes * 8 AS bits FROM nb")
def documents_own_transform(spark, sf):
    """Documents shaped by a transform of the caller."""
    bits = lambda d: d.select("capture_id", "_n", "id", (F.col("total_bytes") * 8).alias("bits"))
    rows = documents.document_rows(stored(spark, sf), capture="capture_id", order=["start_ts", "id"], transform=bits)
    return rows.select("capture_id", "field", "value.id", "value.bits")


@query(f"""WITH {STORED}, a AS (SELECT capture_id, count(*) AS n FROM st WHERE flowlet_id <= 10 GROUP BY 1),
late AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY start_ts, id) AS k FROM st WHERE flowlet_id > 10)
SELECT late.capture_id, printf('flowlet_%06d', coalesce(a.n, 0) + k) AS field, id FROM late LEFT JOIN a ON a.capture_id = late.capture_id""")
def documents_append(spark, sf):
    st = stored(spark, sf)
    first = documents.document_rows(st.where("flowlet_id <= 10"), capture="capture_id", order=["start_ts", "id"])
    added = documents.document_rows(
        st.where("flowlet_id > 10"), capture="capture_id", order=["start_ts", "id"], existing=first, target_rows=200)
    return added.select("capture_id", "field", F.col("value")["id"].alias("id"))


@query(f"""WITH {_DOCS} SELECT printf('flowlet_%06d', n) AS field, id FROM nb WHERE capture_id = 5""")
def document_list(spark, sf):
    rows = documents.document_rows(stored(spark, sf), capture="capture_id", order=["start_ts", "id"])
    packed = documents.pack_documents(rows, capture="capture_id")
    return documents.list_flowlets(packed, 5, capture="capture_id").select("field", F.col("value")["id"].alias("id"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'caps/' || source ELSE '/other/' || source END AS path FROM documents")
def relative_paths(spark, sf):
    d = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/caps/"), "source")).otherwise(F.concat(F.lit("/other/"), "source"))
    return d.select("doc_id", render.relative_path(path, "/data").alias("path"))


@query(f"""WITH {STORED} SELECT id, capture_id, total_bytes, traffic_class, model_llm_prediction FROM st""")
def sink_roundtrip(spark, sf):
    """Stored bursts as JSON lines and back."""
    path = scratch_path(spark, "json")
    sinks.write_json(stored(spark, sf), path)
    schema = "id bigint, capture_id bigint, total_bytes bigint, traffic_class string, model_llm_prediction string"
    return spark.read.schema(schema).json(path)


@query(f"WITH {STORED} SELECT capture_id, count(*) AS n, count(DISTINCT id) AS ids, max(id) % 4294967296 AS top FROM (SELECT capture_id, capture_id * 4294967296 + row_number() OVER (PARTITION BY capture_id ORDER BY start_ts, user_id) AS id FROM st) GROUP BY 1")
def row_ids(spark, sf):
    out = sinks.with_row_ids(stored(spark, sf).drop("id"), order=["start_ts", "user_id"])
    return out.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), (F.max("id") % 4294967296).alias("top"))
