"""Messages and bulk requests on their way into the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.ledger import everything, everything_sql
from checks.registry import check
from haulbook.plans import intake
from haulbook.plans.control import Outcome
from haulbook.session import run_dir
from haulbook.sources import messages
from haulbook.sources.ledger import Ledger

# --- envelopes

ENVELOPE = """'{{"ids":{{"request":"' || request_id || '","transfer":"' || {transfer} || '"}},"message":' || {message}
              || '}}'"""
PROGRESS_VALUE = ENVELOPE.format(transfer="transfer_id", message="'[' || step || ',' || info || ']'")
RESULT_VALUE = ENVELOPE.format(transfer="transfer_id", message="""'["' || signal || '",' || info || ']'""")


@check("prj_envelope", v.with_views("progress", query=f"SELECT {PROGRESS_VALUE} AS value, arrival FROM progress"))
def envelopes(spark, sf_dir):
    return messages.encode_progress(v.progress(spark, sf_dir))


@check("prj_progress_tuple", v.with_views("progress", query="SELECT * FROM progress"))
def progress_tuples(spark, sf_dir):
    return messages.as_progress(messages.decode(messages.encode_progress(v.progress(spark, sf_dir))))


@check("prj_result_tuple", v.with_views("results", query="SELECT * FROM results"))
def result_tuples(spark, sf_dir):
    return messages.as_results(messages.decode(messages.encode_results(v.results(spark, sf_dir))))


@check(
    "src_strict_decode",
    v.with_views(
        "results",
        query=f"""SELECT arrival, transfer_id, signal, info, CAST(NULL AS VARCHAR) AS corrupt FROM results
                  WHERE arrival % 7 <> 0
                  UNION ALL BY NAME
                  SELECT arrival, left({RESULT_VALUE}, -3) AS corrupt FROM results WHERE arrival % 7 = 0""",
    ),
)
def quarantine(spark, sf_dir):
    """One record in seven is cut short: strict decoding takes the others, the quarantine variant keeps it apart."""
    records = messages.encode_results(v.results(spark, sf_dir))
    cut = F.substr(F.col("value"), F.lit(1), F.length("value") - 3)
    damaged = records.withColumn("value", F.when(F.col("arrival") % 7 == 0, cut).otherwise(F.col("value")))
    strict = messages.as_results(messages.decode(damaged.where("arrival % 7 <> 0")))
    broken = messages.quarantined(messages.decode(damaged, strict=False))
    return strict.drop("request_id").unionByName(broken, allowMissingColumns=True)


@check(
    "snk_messages",
    v.with_views(
        "transfers",
        query=f"""SELECT {ENVELOPE.format(transfer="id", message="body")} AS value, CAST(id AS BIGINT) AS arrival
                  FROM transfers WHERE status = 'pending'""",
    ),
)
def write_messages(spark, sf_dir):
    folder = run_dir(spark, "snk_messages")
    pending = v.transfers(spark, sf_dir).where("status = 'pending'")
    messages.write_folder(messages.encode_requests(pending, F.col("id").cast("bigint")), folder)
    return messages.read_folder(spark, folder)


# --- bulk requests: one per customer, with the customer's orders as transfers


def payload():
    key, tag = F.col("o_orderkey"), F.col("o_orderpriority")
    mode = F.when(key % 41 == 0, F.lit("null")).otherwise(F.lit('"fast"'))
    return F.concat(
        F.lit('{"i":'),
        key,
        F.when(key % 2 == 0, F.concat(F.lit(',"opts":{"mode":'), mode, F.lit("}"))).otherwise(""),
        F.lit(',"tag":'),
        F.when(key % 37 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), tag, F.lit('"'))),
        F.when(key % 43 == 0, F.lit(',"zone":1')).otherwise(""),
        F.lit("}"),
    )


def items(spark, sf_dir):
    priority = 5 - F.substring("o_orderpriority", 1, 1).cast("int")
    rows = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("request_id"),
        F.col("o_orderkey").alias("ordinal"),
        payload().alias("payload"),
        F.when(F.col("o_orderkey") % 3 != 0, priority).cast("smallint").alias("priority"),
    )
    return intake.items_with_defaults(rows, defaults(spark, sf_dir))


def defaults(spark, sf_dir):
    """Three in four customers have default options."""
    key = F.col("c_custkey")
    text = F.concat(
        F.lit('{"opts":{"mode":"slow","retry":'), key % 3, F.lit('},"owner":"'), F.col("c_name"), F.lit('"}')
    )
    return (
        v.table(spark, sf_dir, "customer")
        .where("c_custkey % 4 <> 0")
        .select(
            key.cast("string").alias("request_id"),
            text.alias("payload"),
            F.when(key % 5 != 0, key % 5).cast("smallint").alias("priority"),
        )
    )


def request_ids(spark, sf_dir):
    return v.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("request_id"))


#: What the merge and the checks should give, from the columns and not from the JSON.
MERGED = """
    SELECT CAST(o_custkey AS VARCHAR) AS request_id, o_orderkey AS ordinal,
           '{"i":' || o_orderkey ||
           CASE WHEN o_custkey % 4 <> 0
                THEN ',"opts":{"mode":' || coalesce(mode, '"slow"') || ',"retry":' || o_custkey % 3 || '},"owner":"'
                     || c_name || '"'
                WHEN mode IS NOT NULL THEN ',"opts":{"mode":' || mode || '}'
                ELSE '' END ||
           ',"tag":' || tag || zone || '}' AS payload,
           CAST(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) END,
                         CASE WHEN o_custkey % 4 <> 0 AND o_custkey % 5 <> 0 THEN o_custkey % 5 END,
                         0) AS SMALLINT) AS priority,
           list_filter([CASE WHEN zone <> '' THEN '$: unexpected zone' END,
                        CASE WHEN mode = 'null' THEN '$.opts.mode: expected string, found null' END,
                        CASE WHEN tag = '7' THEN '$.tag: expected string, found integer' END],
                       lambda e: e IS NOT NULL) AS errors
    FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 41 = 0 THEN 'null' ELSE '"fast"' END
                         END AS mode,
                    CASE WHEN o_orderkey % 37 = 0 THEN '7' ELSE '"' || o_orderpriority || '"' END AS tag,
                    CASE WHEN o_orderkey % 43 = 0 THEN ',"zone":1' ELSE '' END AS zone
          FROM orders JOIN customer ON c_custkey = o_custkey) x"""
NEW_ROW = f"""
    md5(request_id || ':' || ordinal) AS id, request_id, 'pending' AS status, payload AS body,
    CAST(NULL AS TIMESTAMP) AS submitted_at, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS VARCHAR) AS info,
    CAST(-1 AS INT) AS steps_run, priority"""

SCHEMA = {
    "$schema": "http://json-schema.org/draft-04/schema",
    "type": "object",
    "properties": {
        "i": {"type": "integer"},
        "opts": {
            "type": "object",
            "properties": {"mode": {"type": "string", "pattern": "^(slow|fast)$"}, "retry": {"type": "integer"}},
            "required": ["mode"],
        },
        "owner": {"type": "string"},
        "tag": {"type": "string", "pattern": "^[1-5]-"},
    },
    "required": ["i", "tag"],
    "additionalProperties": False,
}


@check(
    "prj_default_merge",
    v.with_views(merged=MERGED, query="SELECT request_id, ordinal, payload, priority FROM merged"),
)
def merge_defaults(spark, sf_dir):
    return intake.merge_defaults(items(spark, sf_dir))


@check(
    "flt_validate",
    v.with_views(
        merged=MERGED,
        bad="SELECT DISTINCT request_id FROM merged WHERE len(errors) > 0",
        query="""SELECT request_id, ordinal, array_to_string(errors, '; ') AS errors,
                        request_id NOT IN (SELECT request_id FROM bad) AS is_accepted FROM merged""",
    ),
)
def validate(spark, sf_dir):
    # Written once, as intake does with a staging folder, because it is read twice.
    written = f"{run_dir(spark, 'flt_validate')}/items"
    intake.validate(intake.merge_defaults(items(spark, sf_dir)), SCHEMA).write.parquet(written)
    validated = spark.read.parquet(written)
    bad = intake.invalid_requests(validated).withColumn("is_accepted", F.lit(False))
    return validated.join(bad, "request_id", "left").select(
        "request_id",
        "ordinal",
        F.array_join("errors", "; ").alias("errors"),
        F.coalesce("is_accepted", F.lit(True)).alias("is_accepted"),
    )


@check(
    "tx_submit_batch",
    v.with_views(
        merged=MERGED,
        bad="SELECT DISTINCT request_id FROM merged WHERE len(errors) > 0",
        good="SELECT * FROM merged WHERE request_id NOT IN (SELECT request_id FROM bad)",
        ids="""SELECT CAST(c_custkey AS VARCHAR) AS request_id FROM customer
               WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT request_id FROM bad)""",
        query=f"""SELECT *, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS errors, NULL AS received_at
                  FROM ({everything_sql(
                      f"SELECT {NEW_ROW} FROM good",
                      "SELECT request_id, (SELECT count(*) FROM good g WHERE g.request_id = i.request_id) "
                      "AS updated_count FROM ids i",
                      "SELECT NULL AS reason WHERE FALSE",
                  )}) x
                  UNION ALL BY NAME
                  SELECT 'rejected' AS part, request_id, ordinal, array_to_string(errors, '; ') AS errors,
                         'invalid' AS reason, -1 AS updated_count
                  FROM merged WHERE len(errors) > 0
                  UNION ALL BY NAME
                  SELECT 'request' AS part, request_id AS id, {v.NOW_SQL} AS received_at, -1 AS updated_count
                  FROM ids""",
    ),
)
def submit(spark, sf_dir):
    staging = f"{run_dir(spark, 'tx_submit_batch')}/items"
    taken = intake.submit(request_ids(spark, sf_dir), items(spark, sf_dir), v.now(), SCHEMA, staging=staging)
    rejected = taken.rejected.withColumn("errors", F.array_join("errors", "; "))
    rows = everything(Outcome(taken.transfers, taken.acks, rejected))
    requests = taken.requests.withColumns({"part": F.lit("request"), "updated_count": F.lit(-1).cast("bigint")})
    return rows.unionByName(requests, allowMissingColumns=True)


@check("snk_requests", f"SELECT CAST(c_custkey AS VARCHAR) AS id, {v.NOW_SQL} AS received_at FROM customer")
def write_requests(spark, sf_dir):
    ledger = Ledger(spark, run_dir(spark, "snk_requests"))
    ledger.append(0, requests=intake.new_requests(request_ids(spark, sf_dir), v.now()))
    return ledger.requests(before=1)


@check("snk_transfers", v.with_views(merged=MERGED, query=f"SELECT {NEW_ROW} FROM merged"))
def write_transfers(spark, sf_dir):
    ledger = Ledger(spark, run_dir(spark, "snk_transfers"))
    ledger.append(0, transfers=intake.new_transfers(intake.merge_defaults(items(spark, sf_dir))))
    return ledger.transfers(before=1)
