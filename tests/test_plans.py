"""Physical plans that must not regress: what is pushed down, and what is never planned."""

import re

import pytest

import __spark_entry__ as entry
from checks import views as v
from haulbook.operators import aggregates, joins
from haulbook.operators.filters import where_all
from haulbook.plans import folds

SF_DIR = "/root/testdata/sf0.001"
PURE = [
    "agg_summary",
    "agg_latest_progress",
    "agg_last_result",
    "tx_progress",
    "tx_results",
    "set_merge_streams",
    "tx_expand",
    "tx_reconsider_requests",
    "tx_priority_requests",
    "rep_request_status",
    "cp_preflight",
    "cp_byte_ranges",
    "cp_expand_recursive",
    "top_admission",
    "tx_admit",
]


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_nothing_meets_in_one_task(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "Window", "ArrowEvalPython"):
        assert operator not in text, operator


def test_summary_reads_only_what_it_needs(spark):
    text = plan(aggregates.summaries(v.transfers(spark, SF_DIR), v.requests(spark, SF_DIR)))
    columns = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert all("o_totalprice" not in names and "c_name" not in names for names in columns)
    assert "partial_min" in text


def test_messages_are_reduced_before_the_shuffle(spark):
    text = plan(folds.apply_progress(v.transfers(spark, SF_DIR), v.progress(spark, SF_DIR), v.now()))
    assert "partial_max_by" in text


def test_optional_filters_are_pushed_down(spark, tmp_path):
    v.transfers(spark, SF_DIR).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    text = plan(where_all(rows, rows.request_id == "1", rows.status == "failed").select("id"))
    assert "EqualTo(request_id,1)" in text and "EqualTo(status,failed)" in text
    assert "body" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_hot_request_is_split(spark, tmp_path):
    """Two in three transfers belong to one request; the join splits its partition instead of waiting for it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    transfers = spark.range(300_000).selectExpr(
        "cast(id AS string) AS id", "if(id % 3 = 0, cast(id % 1000 AS string), 'hot') AS request_id",
        "uuid() AS body",
    )
    requests = transfers.selectExpr("request_id AS id", "1 AS received_at").distinct()
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = joins.transfers_with_requests(transfers, requests)
        counted = joined.selectExpr("*", "length(body) AS n")
        assert len(counted.collect()) == 300_000
        assert "skew=true" in plan(counted)
    finally:
        for key in settings:
            spark.conf.unset(key)
