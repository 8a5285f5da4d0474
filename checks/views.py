"""The engine's inputs derived from the driver's tables, in Spark and as CTEs for the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- SQL side

#: Orders with their owner. Customers whose key ends in 0 hand theirs to a neighbour, so that their requests are empty.
OWNED = """(SELECT * REPLACE (CASE WHEN o_custkey % 10 <> 0 THEN o_custkey WHEN o_custkey = 0 THEN 1
                                ELSE o_custkey - 1 END AS o_custkey) FROM orders) AS owned"""

CTES = {
    "requests": """
        SELECT CAST(c_custkey AS VARCHAR) AS id,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey % 97 AS INT)) AS received_at
        FROM customer""",
    "transfers": """
        SELECT id, request_id, status, body,
               CASE WHEN status = 'pending' THEN NULL ELSE o_orderdate END AS submitted_at,
               CASE WHEN status IN ('pending', 'submitted') THEN NULL
                    ELSE o_orderdate + to_days(CAST(o_orderkey % 30 AS INT)) END AS updated_at,
               CAST(NULL AS VARCHAR) AS info,
               CAST(CASE WHEN status IN ('pending', 'submitted') THEN -1
                         WHEN status = 'inprogress' THEN o_orderkey % 4 ELSE 4 END AS INT) AS steps_run,
               priority
        FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS request_id,
                     CASE o_orderstatus
                       WHEN 'O' THEN 'pending'
                       WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'submitted' ELSE 'inprogress' END
                       ELSE CASE o_orderkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'expanded' END
                     END AS status,
                     o_orderkey, o_orderdate,
                     '{"i":' || o_orderkey || ',"tag":"' || o_orderpriority || '"}' AS body,
                     CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS SMALLINT) AS priority
              FROM """ + OWNED + """) x""",
    "progress": """
        SELECT CAST(CASE WHEN l_suppkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR) AS request_id,
               CAST(l_orderkey AS VARCHAR) AS transfer_id, CAST(l_linenumber - 1 AS INT) AS step,
               '{"part":' || l_partkey || ',"supp":' || l_suppkey || '}' AS info,
               l_partkey * 1000000 + l_suppkey AS arrival
        FROM lineitem JOIN """ + OWNED + """ ON l_orderkey = o_orderkey""",
    "results": """
        SELECT CAST(o_custkey AS VARCHAR) AS request_id, CAST(o_orderkey AS VARCHAR) AS transfer_id,
               CASE event_type WHEN 'error' THEN 'FATAL_FAILURE' WHEN 'signup' THEN 'EXPANDED'
                    ELSE 'SUCCESS' END AS signal,
               CASE event_type WHEN 'signup'
                    THEN '[' || replace(props, ' ', '') || ',{"again":' || event_id || '}]'
                    ELSE replace(props, ' ', '') END AS info,
               event_id AS arrival
        FROM events JOIN """ + OWNED + """ ON o_orderkey = event_id - event_id % 2""",
    "objects": """
        SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id,
               CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5, encode(text) AS content
        FROM documents""",
}

#: Results after expansion texts: last one per (request, transfer), and how many there were.
CTES["last_results"] = """
        SELECT request_id, transfer_id, signal, info, arrival, n_results
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id, transfer_id
                                           ORDER BY arrival DESC, signal DESC, info DESC) AS rn,
                     count(*) OVER (PARTITION BY request_id, transfer_id) AS n_results
              FROM results) x
        WHERE rn = 1"""
CTES["latest_progress"] = """
        SELECT request_id, transfer_id, step, info
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id, transfer_id
                                           ORDER BY step DESC, arrival, info DESC) AS rn
              FROM progress) x
        WHERE rn = 1"""
CTES["result_infos"] = """
        SELECT *, CASE WHEN signal = 'EXPANDED'
                       THEN '{"expandedTo":["' || md5(transfer_id || ':' || arrival || ':0') || '","'
                            || md5(transfer_id || ':' || arrival || ':1') || '"]}'
                       ELSE info END AS new_info,
                  CASE signal WHEN 'SUCCESS' THEN 'succeeded' WHEN 'FATAL_FAILURE' THEN 'failed'
                              ELSE 'expanded' END AS new_status
        FROM last_results"""
CTES["children"] = """
        SELECT md5(r.transfer_id || ':' || r.arrival || ':' || n) AS id, r.request_id,
               'pending' AS status,
               CASE n WHEN 0 THEN CAST(json_extract(r.info, '$[0]') AS VARCHAR)
                      ELSE CAST(json_extract(r.info, '$[1]') AS VARCHAR) END AS body,
               CAST(NULL AS TIMESTAMP) AS submitted_at, CAST(NULL AS TIMESTAMP) AS updated_at,
               CAST(NULL AS VARCHAR) AS info, CAST(-1 AS INT) AS steps_run, t.priority
        FROM results r JOIN transfers t ON t.id = r.transfer_id,
             (SELECT unnest([0, 1]) AS n) k
        WHERE r.signal = 'EXPANDED'"""
#: Sizes and states that copy decisions are made from.
CTES["copies"] = """
        SELECT path AS source_path, '/copied' || path AS target_path, doc_id,
               CASE WHEN doc_id % 13 = 0 THEN size + 1 ELSE size END AS expected_size, md5 AS expected_md5,
               FALSE AS force
        FROM objects"""
CTES["source_manifest"] = """
        SELECT path, size, md5, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'text/plain' END AS content_type
        FROM objects WHERE doc_id % 11 <> 0"""
CTES["target_manifest"] = """
        SELECT '/copied' || path AS path, size,
               CASE WHEN doc_id % 2 = 0 THEN md5 ELSE md5(md5) END AS md5,
               CAST(NULL AS VARCHAR) AS content_type
        FROM objects WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0"""

_NEEDS = {
    "last_results": ["results"],
    "latest_progress": ["progress"],
    "result_infos": ["results", "last_results"],
    "children": ["results", "transfers"],
    "copies": ["objects"],
    "source_manifest": ["objects"],
    "target_manifest": ["objects"],
}

# Fixed value of these checks: what "now" is.
NOW = "2024-06-01 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def with_views(*names: str, query: str, **extra: str) -> str:
    """A query after the CTEs it names and what those need; ``extra`` adds CTEs of its own, in order."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    ctes = [f"{name} AS ({CTES[name]})" for name in ordered] + [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(ctes)} {query}"


# --- Spark side


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owned(orders: DataFrame) -> DataFrame:
    key = F.col("o_custkey")
    return orders.withColumn("o_custkey", F.when(key % 10 != 0, key).when(key == 0, 1).otherwise(key - 1))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.make_dt_interval(mins=(F.col("c_custkey") % 97).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("received_at"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = (
        F.when(state == "O", "pending")
        .when((state == "P") & (key % 2 == 0), "submitted")
        .when(state == "P", "inprogress")
        .when(key % 3 == 0, "succeeded")
        .when(key % 3 == 1, "failed")
        .otherwise("expanded")
    )
    rows = owned(table(spark, sf_dir, "orders")).withColumn("status", status)
    new = F.col("status").isin("pending", "submitted")
    days = F.make_dt_interval(days=(key % 30).cast("int"))
    return rows.select(
        key.cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("request_id"),
        "status",
        F.to_json(F.struct(key.alias("i"), F.col("o_orderpriority").alias("tag"))).alias("body"),
        F.when(F.col("status") != "pending", F.col("o_orderdate")).alias("submitted_at"),
        F.when(~new, F.col("o_orderdate") + days).alias("updated_at"),
        F.lit(None).cast("string").alias("info"),
        F.when(new, -1).when(F.col("status") == "inprogress", key % 4).otherwise(4).cast("int").alias("steps_run"),
        (5 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("smallint").alias("priority"),
    )


def progress_of(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    customer = F.col("o_custkey") + F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0)
    owners = owned(orders).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lineitem.join(owners, "l_orderkey").select(
        customer.cast("string").alias("request_id"),
        F.col("l_orderkey").cast("string").alias("transfer_id"),
        (F.col("l_linenumber") - 1).alias("step"),
        F.to_json(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))).alias("info"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("arrival"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def results_of(events: DataFrame, orders: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    props = F.replace(F.col("props"), F.lit(" "), F.lit(""))
    again = F.to_json(F.struct(F.col("event_id").alias("again")))
    owners = owned(orders).select("o_orderkey", "o_custkey")
    return (
        events.withColumn("o_orderkey", F.col("event_id") - F.col("event_id") % 2)
        .join(owners, "o_orderkey")
        .select(
            F.col("o_custkey").cast("string").alias("request_id"),
            F.col("o_orderkey").cast("string").alias("transfer_id"),
            F.when(kind == "error", "FATAL_FAILURE")
            .when(kind == "signup", "EXPANDED")
            .otherwise("SUCCESS")
            .alias("signal"),
            F.when(kind == "signup", F.concat(F.lit("["), props, F.lit(","), again, F.lit("]")))
            .otherwise(props)
            .alias("info"),
            F.col("event_id").alias("arrival"),
        )
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        path.alias("path"),
        "doc_id",
        F.octet_length("text").cast("bigint").alias("size"),
        F.md5("text").alias("md5"),
    )


def object_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        path.alias("path"), "doc_id", F.encode("text", "UTF-8").alias("content")
    )


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)
    return objects(spark, sf_dir).select(
        F.col("path").alias("source_path"),
        F.concat(F.lit("/copied"), "path").alias("target_path"),
        "doc_id",
        (F.col("size") + wrong).alias("expected_size"),
        F.col("md5").alias("expected_md5"),
        F.lit(False).alias("force"),
    )


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    content_type = F.when(F.col("doc_id") % 3 != 0, "text/plain")
    return (
        objects(spark, sf_dir)
        .where("doc_id % 11 <> 0")
        .select("path", "size", "md5", content_type.alias("content_type"))
    )


def target_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("doc_id") % 2 == 0, F.col("md5")).otherwise(F.md5("md5"))
    return (
        objects(spark, sf_dir)
        .where("doc_id % 5 = 0 AND doc_id % 7 <> 0")
        .select(
            F.concat(F.lit("/copied"), "path").alias("path"),
            "size",
            digest.alias("md5"),
            F.lit(None).cast("string").alias("content_type"),
        )
    )
