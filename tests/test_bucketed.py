"""Stores in buckets: no exchange of stored bursts, newest predictions, compaction, reopening."""

import random
import re

import pytest
from pyspark.sql import functions as F

from burstlens.operators import store
from burstlens.session import scratch_path
from burstlens.sources import bucketed

SCHEMA = "id long, capture_id long, total_bytes long, traffic_class string, model_llm_prediction string, model_llm_confidence double"


def rows_of(r, n=400):
    out = []
    for i in range(n):
        c = 0 if r.random() < 0.4 else r.randrange(1, 9)
        out.append(((c << 32) + i, c, r.randrange(1000), r.choice(["llm", "non_llm", None]), r.choice([None, "x"]), r.choice([None, 0.5])))
    return out


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucket_count():
    assert [bucketed.bucket_count(n, bucket_rows=10) for n in (0, 1, 10, 11, 20, 21, 40, 41)] == [1, 1, 1, 2, 2, 4, 4, 8]


def test_newest_prediction_counts(spark, no_broadcast):
    r = random.Random(5)
    rows, path = rows_of(r), scratch_path(spark, "store")
    bucketed.create_store(spark.createDataFrame(rows, SCHEMA), "newest", path, buckets=4)
    want = {x[0]: x for x in rows}
    for version in (1, 3, 2):
        said = [(x[0], r.choice(["a", "b", None]), r.choice([0.25, None])) for x in r.sample(rows, 120)] + [(-7, "nobody", 1.0)]
        bucketed.append_predictions(spark.createDataFrame(said, "id long, model_llm_prediction string, model_llm_confidence double"),
                                    "newest", path, version=version, buckets=4)
        for i, p, c in said:
            if i in want and (version == 3 or len(want[i]) == 6 or want[i][6] <= version):
                want[i] = (*want[i][:4], p, c, version)
    got = bucketed.bursts(spark, "newest")
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((x[:6] for x in want.values()), key=str)
    assert "Exchange" not in plan_of(got)
    one = bucketed.bursts(spark, "newest", capture_id=3)
    assert one.count() == sum(x[1] == 3 for x in rows) and "EqualTo(capture_id,3)" in plan_of(one)
    bucketed.close_store(spark, "newest")


def test_listing_moves_counts_only(spark, no_broadcast):
    rows, path = rows_of(random.Random(6)), scratch_path(spark, "store")
    bucketed.create_store(spark.createDataFrame(rows, SCHEMA), "listed", path, buckets=4)
    counts = store.capture_counts(bucketed.bursts(spark, "listed"))
    plan = plan_of(counts)
    # The one exchange stands above the combined counts: below it there is none.
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and plan.index("partial_count") > plan.index("Exchange")
    assert {x["capture_id"]: x["flow_count"] for x in counts.collect()} == {
        c: sum(x[1] == c for x in rows) for c in {x[1] for x in rows}}
    bucketed.close_store(spark, "listed")


def test_compact_reopen_and_delete(spark):
    r = random.Random(7)
    rows, path, new = rows_of(r), scratch_path(spark, "store"), scratch_path(spark, "store")
    bucketed.create_store(spark.createDataFrame(rows[:300], SCHEMA), "kept", path, buckets=2)
    bucketed.append_bursts(spark.createDataFrame(rows[300:], SCHEMA), "kept", path, buckets=2)
    said = [(x[0], "p", 0.5) for x in rows[::3]]
    bucketed.append_predictions(spark.createDataFrame(said, "id long, model_llm_prediction string, model_llm_confidence double"),
                                "kept", path, version=1, buckets=2)
    before = sorted(map(tuple, bucketed.bursts(spark, "kept").collect()), key=str)
    gone = spark.createDataFrame([(0,), (0,), (99,)], "capture_id long")
    assert bucketed.compact(spark, "kept", path, new, buckets=2, new_buckets=8, deleted=gone) == 8
    after = sorted(map(tuple, bucketed.bursts(spark, "kept").collect()), key=str)
    assert after == [x for x in before if x[1] != 0]
    assert spark.table("kept_predictions").count() == 0
    bucketed.open_store(spark, "kept", path, buckets=2)  # the old folder is whole
    assert sorted(map(tuple, bucketed.bursts(spark, "kept").collect()), key=str) == before
    with pytest.raises(FileNotFoundError):
        bucketed.open_store(spark, "kept", path, buckets=4)
    bucketed.close_store(spark, "kept")


def test_empty_store_and_bad_name(spark):
    path = scratch_path(spark, "store")
    bucketed.create_store(spark.createDataFrame([], SCHEMA), "hollow", path, buckets=2)
    assert bucketed.bursts(spark, "hollow").count() == 0
    bucketed.close_store(spark, "hollow")
    with pytest.raises(ValueError):
        bucketed.bursts(spark, "a.b; drop")
