"""Counts, summaries, pages and lookups over the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from haulbook.operators import aggregates, filters, joins
from haulbook.plans import report
from haulbook.schemas import STATUSES

COUNTS = ", ".join(f"count(*) FILTER (status = '{status}') AS {status}" for status in STATUSES)
DETAILS = """id, status, priority, body AS request_body, submitted_at, updated_at, info AS reported_info, steps_run"""
SUMMARIES = f"""
    SELECT r.id, r.received_at, {COUNTS}, min(submitted_at) AS submitted_at, max(updated_at) AS updated_at
    FROM requests r JOIN transfers t ON t.request_id = r.id"""

#: A request with many transfers, from the data: the one with the most, lowest id first.
BUSIEST = """SELECT request_id FROM transfers GROUP BY request_id ORDER BY count(*) DESC, request_id LIMIT 1"""


def busiest_request(transfers) -> str:
    counts = aggregates.count_transfers(transfers)
    return counts.orderBy(F.desc("n"), "request_id").first()["request_id"]


def wanted_requests(requests):
    """Every third request, and as many ids nobody has."""
    third = requests.where("cast(id AS bigint) % 3 = 0").select("id")
    return third.unionByName(third.select(F.concat(F.lit("x"), "id").alias("id")))


WANTED_REQUESTS = """
    SELECT id FROM requests WHERE CAST(id AS BIGINT) % 3 = 0
    UNION ALL SELECT 'x' || id AS id FROM requests WHERE CAST(id AS BIGINT) % 3 = 0"""


def wanted_transfers(transfers):
    """Every transfer with an even key, half of them under a request that is not theirs."""
    key = F.col("id").cast("bigint")
    request = F.when(key % 4 == 0, F.concat(F.lit("x"), "request_id")).otherwise(F.col("request_id"))
    return transfers.where(key % 2 == 0).select(request.alias("request_id"), "id")


WANTED_TRANSFERS = """
    SELECT CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'x' || request_id ELSE request_id END AS request_id, id
    FROM transfers WHERE CAST(id AS BIGINT) % 2 = 0"""


@check(
    "jn_transfers_requests",
    v.with_views(
        "requests",
        "transfers",
        query="SELECT t.*, r.received_at FROM transfers t JOIN requests r ON r.id = t.request_id",
    ),
)
def transfers_with_requests(spark, sf_dir):
    return joins.transfers_with_requests(v.transfers(spark, sf_dir), v.requests(spark, sf_dir))


@check("agg_count_requests", v.with_views("requests", query="SELECT count(*) AS n FROM requests"))
def count_requests(spark, sf_dir):
    return aggregates.count_requests(v.requests(spark, sf_dir))


@check(
    "agg_count_transfers",
    v.with_views(
        "transfers",
        query="""SELECT request_id, 'any' AS status, count(*) AS n FROM transfers GROUP BY request_id
                 UNION ALL
                 SELECT request_id, 'failed' AS status, count(*) AS n FROM transfers
                 WHERE status = 'failed' GROUP BY request_id""",
    ),
)
def count_transfers(spark, sf_dir):
    rows = v.transfers(spark, sf_dir)
    every = aggregates.count_transfers(rows).withColumn("status", F.lit("any"))
    failed = aggregates.count_transfers(rows, "failed").withColumn("status", F.lit("failed"))
    return every.unionByName(failed)


@check(
    "agg_count_by_status",
    v.with_views("transfers", query="SELECT status, count(*) AS n FROM transfers GROUP BY status"),
)
def count_by_status(spark, sf_dir):
    return aggregates.count_by_status(v.transfers(spark, sf_dir))


@check(
    "agg_request_status",
    v.with_views(
        "requests",
        "transfers",
        query="""SELECT r.id, t.status, count(t.id) AS n FROM requests r JOIN transfers t ON t.request_id = r.id
                 GROUP BY r.id, t.status""",
    ),
)
def request_status_counts(spark, sf_dir):
    return aggregates.request_status_counts(v.transfers(spark, sf_dir), v.requests(spark, sf_dir))


@check(
    "agg_status_map",
    v.with_views(
        "transfers",
        query="""SELECT request_id, s.status, count(*) FILTER (t.status = s.status) AS n
                 FROM transfers t, (SELECT unnest(['pending', 'submitted', 'inprogress', 'failed', 'succeeded',
                                                   'expanded']) AS status) s
                 GROUP BY request_id, s.status""",
    ),
)
def status_map(spark, sf_dir):
    maps = aggregates.request_status_map(v.transfers(spark, sf_dir))
    return maps.select("request_id", F.explode("status_counts").alias("status", "n"))


@check(
    "agg_request_times",
    v.with_views(
        "transfers",
        query="""SELECT request_id, min(submitted_at) AS submitted_at, max(updated_at) AS updated_at
                 FROM transfers GROUP BY request_id""",
    ),
)
def request_times(spark, sf_dir):
    return aggregates.request_times(v.transfers(spark, sf_dir))


@check("agg_summary", v.with_views("requests", "transfers", query=f"{SUMMARIES} GROUP BY r.id, r.received_at"))
def summary(spark, sf_dir):
    return aggregates.summaries(v.transfers(spark, sf_dir), v.requests(spark, sf_dir))


@check("prj_details", v.with_views("transfers", query=f"SELECT {DETAILS} FROM transfers"))
def details(spark, sf_dir):
    return report.details(v.transfers(spark, sf_dir))


@check(
    "flt_ids",
    v.with_views(
        "requests", wanted=WANTED_REQUESTS, query="SELECT * FROM requests WHERE id IN (SELECT id FROM wanted)"
    ),
)
def rows_with_ids(spark, sf_dir):
    rows = v.requests(spark, sf_dir)
    return filters.with_ids(rows, wanted_requests(rows))


@check(
    "flt_optional",
    v.with_views(
        "transfers",
        query="""SELECT *, 'failed' AS asked FROM transfers WHERE status = 'failed'
                 UNION ALL SELECT *, 'any' AS asked FROM transfers""",
    ),
)
def optional_filters(spark, sf_dir):
    rows = v.transfers(spark, sf_dir)
    failed = filters.where_all(rows, F.col("id").isNotNull(), F.col("status") == "failed")
    every = filters.where_all(rows, F.col("id").isNotNull(), None)
    return failed.withColumn("asked", F.lit("failed")).unionByName(every.withColumn("asked", F.lit("any")))


@check(
    "jn_semi_exists",
    v.with_views(
        "requests",
        wanted=WANTED_REQUESTS,
        query="""SELECT id, id IN (SELECT id FROM requests) AS is_known FROM wanted""",
    ),
)
def semi_exists(spark, sf_dir):
    rows = v.requests(spark, sf_dir)
    wanted = wanted_requests(rows)
    known = joins.existing(wanted, rows, ["id"]).withColumn("is_known", F.lit(True))
    unknown = joins.missing(wanted, rows, ["id"]).withColumn("is_known", F.lit(False))
    return known.unionByName(unknown)


@check(
    "jn_orphans",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS request_id FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)""",
)
def orphans(spark, sf_dir):
    kept = v.table(spark, sf_dir, "customer").where("c_nationkey <> 7")
    rows = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("request_id")
    )
    return joins.orphans(rows, kept.select(F.col("c_custkey").cast("string").alias("id")))


@check(
    "top_list_requests",
    v.with_views(
        "requests",
        query="""(SELECT *, 'newest' AS first FROM requests ORDER BY received_at DESC, id DESC LIMIT 40 OFFSET 15)
                 UNION ALL
                 (SELECT *, 'oldest' AS first FROM requests ORDER BY received_at, id LIMIT 40 OFFSET 15)""",
    ),
)
def page_of_requests(spark, sf_dir):
    rows = v.requests(spark, sf_dir)
    newest = report.page_of_requests(rows, 15, 40, newest_first=True).withColumn("first", F.lit("newest"))
    oldest = report.page_of_requests(rows, 15, 40, newest_first=False).withColumn("first", F.lit("oldest"))
    return newest.unionByName(oldest)


@check(
    "top_list_transfers",
    v.with_views(
        "transfers",
        busiest=BUSIEST,
        query=f"""(SELECT {DETAILS}, 'any' AS asked FROM transfers
                   WHERE request_id IN (SELECT request_id FROM busiest) ORDER BY id LIMIT 5 OFFSET 2)
                  UNION ALL
                  (SELECT {DETAILS}, 'pending' AS asked FROM transfers
                   WHERE request_id IN (SELECT request_id FROM busiest) AND status = 'pending'
                   ORDER BY id DESC LIMIT 5)""",
    ),
)
def page_of_transfers(spark, sf_dir):
    rows = v.transfers(spark, sf_dir)
    request_id = busiest_request(rows)
    every = report.list_transfers(rows, request_id, 2, 5).items.withColumn("asked", F.lit("any"))
    pending = report.list_transfers(rows, request_id, 0, 5, descending=True, status="pending").items
    return every.unionByName(pending.withColumn("asked", F.lit("pending")))


@check(
    "top_page_total",
    v.with_views(
        "requests",
        "transfers",
        page="SELECT * FROM requests ORDER BY received_at DESC, id DESC LIMIT 50 OFFSET 10",
        query="""SELECT id, received_at, (SELECT count(*) FROM requests) AS total FROM page
                 WHERE id IN (SELECT request_id FROM transfers)""",
    ),
)
def page_with_total(spark, sf_dir):
    found = report.list_requests(v.transfers(spark, sf_dir), v.requests(spark, sf_dir), 10, 50)
    return found.items.select("id", "received_at", F.lit(found.total).cast("bigint").alias("total"))


@check(
    "rep_list_requests",
    v.with_views(
        "requests",
        "transfers",
        page="SELECT id FROM requests ORDER BY received_at DESC, id DESC LIMIT 100 OFFSET 20",
        query=f"{SUMMARIES} WHERE r.id IN (SELECT id FROM page) GROUP BY r.id, r.received_at",
    ),
)
def list_requests(spark, sf_dir):
    return report.list_requests(v.transfers(spark, sf_dir), v.requests(spark, sf_dir), 20, 100).items


@check(
    "rep_request_status",
    v.with_views(
        "requests",
        "transfers",
        wanted=WANTED_REQUESTS,
        found=f"{SUMMARIES} WHERE r.id IN (SELECT id FROM wanted) GROUP BY r.id, r.received_at",
        query="""SELECT *, CAST(NULL AS VARCHAR) AS reason FROM found
                 UNION ALL BY NAME
                 SELECT id, 'not_found' AS reason FROM wanted WHERE id NOT IN (SELECT id FROM requests)""",
    ),
)
def request_status(spark, sf_dir):
    rows = v.requests(spark, sf_dir)
    found = report.request_status(v.transfers(spark, sf_dir), rows, wanted_requests(rows))
    rejected = found.rejected.withColumnRenamed("request_id", "id")
    return found.found.unionByName(rejected, allowMissingColumns=True)


@check(
    "rep_list_transfers",
    v.with_views(
        "transfers",
        busiest=BUSIEST,
        query=f"""SELECT {DETAILS}, (SELECT count(*) FROM transfers
                                     WHERE request_id IN (SELECT request_id FROM busiest)) AS total
                  FROM transfers WHERE request_id IN (SELECT request_id FROM busiest)""",
    ),
)
def list_transfers(spark, sf_dir):
    rows = v.transfers(spark, sf_dir)
    found = report.list_transfers(rows, busiest_request(rows), 0, None)
    return found.items.withColumn("total", F.lit(found.total).cast("bigint"))


@check(
    "rep_transfer_details",
    v.with_views(
        "transfers",
        wanted=WANTED_TRANSFERS,
        query=f"""SELECT {DETAILS}, CAST(NULL AS VARCHAR) AS reason FROM transfers t
                  WHERE EXISTS (SELECT 1 FROM wanted w WHERE w.id = t.id AND w.request_id = t.request_id)
                  UNION ALL BY NAME
                  SELECT id, 'not_found' AS reason FROM wanted w
                  WHERE NOT EXISTS (SELECT 1 FROM transfers t WHERE w.id = t.id AND w.request_id = t.request_id)""",
    ),
)
def transfer_details(spark, sf_dir):
    rows = v.transfers(spark, sf_dir)
    found = report.transfer_details(rows, wanted_transfers(rows))
    return found.found.unionByName(found.rejected.drop("request_id"), allowMissingColumns=True)
