"""Ledger storage, admission, control and message folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from haulbook.functions import json as fjson
from haulbook.functions import text
from haulbook.operators import aggregates, filters, joins
from haulbook.plans import admission, control, folds
from haulbook.schemas import TRANSFER_COLUMNS
from haulbook.session import run_dir
from haulbook.sources.ledger import Ledger

#: In-flight cap of the checks; it grows with the data, so that it leaves room for some but not all pending transfers.
CAP = "(SELECT count(*) * 2 // 5 FROM orders)"
ADMITTED = f"""
    SELECT t.*, r.received_at FROM transfers t JOIN requests r ON r.id = t.request_id WHERE t.status = 'pending'
    ORDER BY t.priority DESC, r.received_at, t.id
    LIMIT (SELECT greatest(0, {CAP} - count(*)) FROM transfers WHERE status IN ('submitted', 'inprogress'))"""

RECONSIDERED = "replace(status, 'failed', 'pending')"


def cap(spark, sf_dir) -> int:
    return v.table(spark, sf_dir, "orders").count() * 2 // 5


def row(**changes: str) -> str:
    """Ledger columns, some of them replaced."""
    return ", ".join(f"{changes[name]} AS {name}" if name in changes else name for name in TRANSFER_COLUMNS)


# --- storage


@check(
    "src_ledger",
    v.with_views(
        "transfers",
        query=f"""SELECT {row(status="CASE WHEN status = 'failed' AND priority > 1 THEN 'succeeded' "
                              "ELSE " + RECONSIDERED + " END",
                              steps_run="CASE WHEN status = 'failed' THEN 0 ELSE steps_run END")} FROM transfers""",
    ),
)
def read_ledger(spark, sf_dir):
    """State after two batches on what was loaded, with a snapshot between them; the second changes rows of the first."""
    ledger = Ledger(spark, run_dir(spark, "src_ledger"), buckets=8, every=1)
    ledger.load(v.transfers(spark, sf_dir), v.requests(spark, sf_dir))
    targets = v.requests(spark, sf_dir).select(F.col("id").alias("request_id"))
    again = control.reconsider_requests(ledger.transfers(), ledger.requests(), targets)
    ledger.append(0, transfers=again.changed)
    ledger.fold_if_due(1)
    ledger.append(1, transfers=ledger.changes(0).where("priority > 1").withColumn("status", F.lit("succeeded")))
    return ledger.transfers(before=2)


# --- admission


@check("top_admission", v.with_views("requests", "transfers", admitted=ADMITTED, query="SELECT id FROM admitted"))
def next_pending(spark, sf_dir):
    rows = v.transfers(spark, sf_dir)
    room = admission.slots(rows, cap(spark, sf_dir))
    return admission.next_pending(rows, v.requests(spark, sf_dir), room).select("id")


@check(
    "tx_admit",
    v.with_views(
        "requests",
        "transfers",
        admitted=ADMITTED,
        query=f"SELECT {row(status="'submitted'", submitted_at=v.NOW_SQL)} FROM admitted",
    ),
)
def admit(spark, sf_dir):
    return admission.admit(v.transfers(spark, sf_dir), v.requests(spark, sf_dir), cap(spark, sf_dir), v.now())


@check(
    "jn_update_from_batch",
    v.with_views(
        "requests",
        "transfers",
        admitted=ADMITTED,
        query=f"SELECT {row()} FROM transfers WHERE id IN (SELECT id FROM admitted)",
    ),
)
def update_from_batch(spark, sf_dir):
    rows = v.transfers(spark, sf_dir)
    return joins.update_from_batch(rows, next_pending(spark, sf_dir)).select(*TRANSFER_COLUMNS)


# --- control


def request_targets(spark, sf_dir):
    """Two in three requests, with a priority, and as many ids nobody has."""
    key = F.col("id").cast("bigint")
    priority = (key % 5).cast("smallint").alias("priority")
    some = v.requests(spark, sf_dir).where(key % 3 != 0).select(F.col("id").alias("request_id"), priority)
    return some.unionByName(some.select(F.concat(F.lit("x"), "request_id").alias("request_id"), "priority"))


REQUEST_TARGETS = """
    SELECT p || id AS request_id, CAST(CAST(id AS BIGINT) % 5 AS SMALLINT) AS priority
    FROM requests, (SELECT unnest(['', 'x']) AS p) x WHERE CAST(id AS BIGINT) % 3 <> 0"""


def transfer_targets(spark, sf_dir):
    """Two in three transfers, with a priority; every fourth under a request that is not theirs."""
    key = F.col("id").cast("bigint")
    request = F.when(key % 4 == 0, F.concat(F.lit("x"), "request_id")).otherwise(F.col("request_id"))
    return (
        v.transfers(spark, sf_dir)
        .where(key % 3 != 0)
        .select(request.alias("request_id"), "id", (key % 5).cast("smallint").alias("priority"))
    )


TRANSFER_TARGETS = """
    SELECT CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'x' || request_id ELSE request_id END AS request_id, id,
           CAST(CAST(id AS BIGINT) % 5 AS SMALLINT) AS priority
    FROM transfers WHERE CAST(id AS BIGINT) % 3 <> 0"""


def everything(outcome: control.Outcome):
    """All three parts of an outcome as one frame."""
    parts = [
        outcome.changed.withColumn("part", F.lit("changed")),
        outcome.acks.withColumn("part", F.lit("ack")),
        outcome.rejected.withColumn("part", F.lit("rejected")),
    ]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return rows.withColumn("updated_count", F.coalesce("updated_count", F.lit(-1)))


def everything_sql(changed: str, acks: str, rejected: str) -> str:
    return f"""
        SELECT * REPLACE (coalesce(updated_count, -1) AS updated_count) FROM (
            SELECT 'changed' AS part, * FROM ({changed}) c
            UNION ALL BY NAME SELECT 'ack' AS part, * FROM ({acks}) a
            UNION ALL BY NAME SELECT 'rejected' AS part, * FROM ({rejected}) r) x"""


@check(
    "tx_reconsider_requests",
    v.with_views(
        "requests",
        "transfers",
        targets=REQUEST_TARGETS,
        query=everything_sql(
            f"""SELECT {row(status="'pending'", steps_run="CAST(0 AS INT)")} FROM transfers
                WHERE status = 'failed' AND request_id IN (SELECT request_id FROM targets)""",
            """SELECT g.request_id, (SELECT count(*) FROM transfers t
                                     WHERE t.request_id = g.request_id AND t.status = 'failed') AS updated_count
               FROM targets g WHERE g.request_id IN (SELECT id FROM requests)""",
            """SELECT request_id, 'not_found' AS reason FROM targets
               WHERE request_id NOT IN (SELECT id FROM requests)""",
        ),
    ),
)
def reconsider_requests(spark, sf_dir):
    targets = request_targets(spark, sf_dir)
    return everything(
        control.reconsider_requests(v.transfers(spark, sf_dir), v.requests(spark, sf_dir), targets)
    )


KNOWN = "EXISTS (SELECT 1 FROM transfers t WHERE t.id = g.id AND t.request_id = g.request_id{})"


@check(
    "tx_reconsider_transfers",
    v.with_views(
        "transfers",
        targets=TRANSFER_TARGETS,
        query=everything_sql(
            f"""SELECT {row(status="'pending'", steps_run="CAST(0 AS INT)")} FROM transfers
                WHERE status = 'failed' AND (request_id, id) IN (SELECT (request_id, id) FROM targets)""",
            f"""SELECT request_id, id, CAST(CASE WHEN {KNOWN.format(" AND t.status = 'failed'")} THEN 1 ELSE 0 END
                                           AS BIGINT) AS updated_count
                FROM targets g WHERE {KNOWN.format("")}""",
            f"""SELECT request_id, id, 'not_found' AS reason FROM targets g WHERE NOT {KNOWN.format("")}""",
        ),
    ),
)
def reconsider_transfers(spark, sf_dir):
    return everything(control.reconsider_transfers(v.transfers(spark, sf_dir), transfer_targets(spark, sf_dir)))


@check(
    "tx_priority_requests",
    v.with_views(
        "requests",
        "transfers",
        targets=REQUEST_TARGETS,
        pending="""SELECT t.*, g.priority AS new_priority FROM transfers t JOIN targets g USING (request_id)
                   WHERE t.status = 'pending'""",
        query=everything_sql(
            f"SELECT {row(priority='new_priority')} FROM pending WHERE priority <> new_priority",
            """SELECT request_id, count(*) FILTER (priority <> new_priority) AS updated_count FROM pending
               GROUP BY request_id""",
            """SELECT request_id, CASE WHEN request_id IN (SELECT id FROM requests) THEN 'conflict'
                                       ELSE 'not_found' END AS reason
               FROM targets WHERE request_id NOT IN (SELECT request_id FROM pending)""",
        ),
    ),
)
def prioritise_requests(spark, sf_dir):
    targets = request_targets(spark, sf_dir)
    return everything(
        control.prioritise_requests(v.transfers(spark, sf_dir), v.requests(spark, sf_dir), targets)
    )


@check(
    "tx_priority_transfers",
    v.with_views(
        "transfers",
        targets=TRANSFER_TARGETS,
        found="""SELECT t.*, g.priority AS new_priority FROM transfers t JOIN targets g USING (request_id, id)""",
        query=everything_sql(
            f"""SELECT {row(priority='new_priority')} FROM found
                WHERE status = 'pending' AND priority <> new_priority""",
            """SELECT request_id, id, CAST(CASE WHEN priority <> new_priority THEN 1 ELSE 0 END AS BIGINT) AS updated_count
               FROM found WHERE status = 'pending'""",
            f"""SELECT request_id, id, 'conflict' AS reason FROM found WHERE status <> 'pending'
                UNION ALL SELECT request_id, id, 'not_found' AS reason FROM targets g
                WHERE NOT {KNOWN.format("")}""",
        ),
    ),
)
def prioritise_transfers(spark, sf_dir):
    return everything(control.prioritise_transfers(v.transfers(spark, sf_dir), transfer_targets(spark, sf_dir)))


# --- folds

PROGRESS_CHANGES = f"""
    SELECT t.id, t.request_id, 'inprogress' AS status, t.body, t.submitted_at, {v.NOW_SQL} AS updated_at, p.info,
           p.step AS steps_run, t.priority
    FROM transfers t JOIN latest_progress p ON p.transfer_id = t.id AND p.request_id = t.request_id
    WHERE t.status IN ('submitted', 'inprogress') AND t.steps_run < p.step"""
RESULT_CHANGES = f"""
    SELECT t.id, t.request_id, r.new_status AS status, t.body, t.submitted_at, {v.NOW_SQL} AS updated_at,
           r.new_info AS info, CAST(t.steps_run + r.n_results AS INT) AS steps_run, t.priority
    FROM transfers t JOIN result_infos r ON r.transfer_id = t.id AND r.request_id = t.request_id"""


@check("agg_latest_progress", v.with_views("latest_progress", query="SELECT * FROM latest_progress"))
def latest_progress(spark, sf_dir):
    return aggregates.latest_progress(v.progress(spark, sf_dir))


@check("agg_last_result", v.with_views("last_results", query="SELECT * FROM last_results"))
def last_result(spark, sf_dir):
    return aggregates.last_results(v.results(spark, sf_dir))


@check(
    "flt_progress_guard",
    v.with_views(
        "transfers",
        "progress",
        query="""SELECT t.id, t.request_id, t.status, t.steps_run, p.step, p.arrival
                 FROM transfers t JOIN progress p ON p.transfer_id = t.id AND p.request_id = t.request_id
                 WHERE t.status IN ('submitted', 'inprogress') AND t.steps_run < p.step""",
    ),
)
def progress_guard(spark, sf_dir):
    messages = v.progress(spark, sf_dir).drop("info")
    rows = joins.update_from_messages(v.transfers(spark, sf_dir), messages)
    rows = rows.where(filters.accepts_progress(F.col("status"), F.col("steps_run"), F.col("step")))
    return rows.select("id", "request_id", "status", "steps_run", "step", "arrival")


@check(
    "jn_update_from_messages",
    v.with_views(
        "transfers",
        "latest_progress",
        query="""SELECT t.id, t.request_id, t.status, t.steps_run, p.step, p.info AS new_info
                 FROM transfers t JOIN latest_progress p ON p.transfer_id = t.id AND p.request_id = t.request_id""",
    ),
)
def update_from_messages(spark, sf_dir):
    latest = aggregates.latest_progress(v.progress(spark, sf_dir)).withColumnRenamed("info", "new_info")
    rows = joins.update_from_messages(v.transfers(spark, sf_dir), latest)
    return rows.select("id", "request_id", "status", "steps_run", "step", "new_info")


@check("tx_progress", v.with_views("transfers", "latest_progress", query=PROGRESS_CHANGES))
def apply_progress(spark, sf_dir):
    return folds.apply_progress(v.transfers(spark, sf_dir), v.progress(spark, sf_dir), v.now())


@check("tx_results", v.with_views("transfers", "result_infos", query=RESULT_CHANGES))
def apply_results(spark, sf_dir):
    return folds.apply_results(v.transfers(spark, sf_dir), v.results(spark, sf_dir), v.now())


#: Progress, then results, over the whole ledger; unchanged rows stay out.
FOLDED = f"""
    SELECT t.id, t.request_id, coalesce(r.new_status, 'inprogress') AS status, t.body, t.submitted_at,
           {v.NOW_SQL} AS updated_at, CASE WHEN r.signal IS NULL THEN p.info ELSE r.new_info END AS info,
           CAST(coalesce(p.steps_run, t.steps_run) + coalesce(r.n_results, 0) AS INT) AS steps_run, t.priority
    FROM transfers t
    LEFT JOIN progressed p ON p.id = t.id
    LEFT JOIN result_infos r ON r.transfer_id = t.id AND r.request_id = t.request_id
    WHERE p.id IS NOT NULL OR r.signal IS NOT NULL"""


@check(
    "set_merge_streams",
    v.with_views(
        "transfers",
        "latest_progress",
        "result_infos",
        progressed=PROGRESS_CHANGES,
        query=FOLDED,
    ),
)
def merge_messages(spark, sf_dir):
    """Both kinds of messages as one frame, folded in one pass."""
    merged = folds.tag_messages(v.progress(spark, sf_dir), v.results(spark, sf_dir))
    return folds.fold_tagged(v.transfers(spark, sf_dir), merged, v.now())


@check(
    "jn_parent_priority",
    v.with_views(
        "transfers",
        "results",
        query="""SELECT r.transfer_id, r.request_id, r.arrival, t.priority FROM results r
                 LEFT JOIN transfers t ON t.id = r.transfer_id WHERE r.signal = 'EXPANDED'""",
    ),
)
def parent_priority(spark, sf_dir):
    expanded = v.results(spark, sf_dir).where("signal = 'EXPANDED'")
    rows = joins.parent_priority(expanded, v.transfers(spark, sf_dir))
    return rows.select("transfer_id", "request_id", "arrival", "priority")


@check(
    "agg_expanded_ids",
    v.with_views(
        "results",
        query="""SELECT transfer_id, arrival, n AS position, md5(transfer_id || ':' || arrival || ':' || n) AS child_id
                 FROM results, (SELECT unnest([0, 1]) AS n) k WHERE signal = 'EXPANDED'""",
    ),
)
def expanded_ids(spark, sf_dir):
    expanded = v.results(spark, sf_dir).where("signal = 'EXPANDED'")
    ids = folds.expanded_ids(F.col("transfer_id"), F.col("arrival"), F.col("info"))
    return expanded.select("transfer_id", "arrival", F.posexplode(ids).alias("position", "child_id"))


@check("tx_expand", v.with_views("children", query="SELECT * FROM children"))
def expand(spark, sf_dir):
    return folds.expand(v.transfers(spark, sf_dir), v.results(spark, sf_dir), v.requests(spark, sf_dir)).children


@check(
    "agg_ack",
    v.with_views(
        "transfers",
        "result_infos",
        changed=RESULT_CHANGES,
        query="SELECT request_id, count(*) AS updated_count FROM changed GROUP BY request_id",
    ),
)
def acknowledge(spark, sf_dir):
    return aggregates.acknowledge(apply_results(spark, sf_dir))


# --- message projections


@check(
    "prj_result_status",
    v.with_views(
        "results",
        query="""SELECT transfer_id, arrival, CASE signal WHEN 'SUCCESS' THEN 'succeeded'
                        WHEN 'FATAL_FAILURE' THEN 'failed' ELSE 'expanded' END AS status FROM results""",
    ),
)
def result_status(spark, sf_dir):
    status = fjson.status_of_signal(F.col("signal"))
    return v.results(spark, sf_dir).select("transfer_id", "arrival", status.alias("status"))


@check(
    "prj_failure_info",
    """SELECT event_id, '{"message":"Unhandled error' ||
              CASE WHEN event_id % 3 = 0 THEN '' ELSE ': ' || event_type END || '","detail":' ||
              CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"user ' || user_id || '"' END || '}' AS info
       FROM events""",
)
def failure_info(spark, sf_dir):
    message = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    cause = F.when(F.col("event_id") % 2 != 0, F.concat(F.lit("user "), F.col("user_id")))
    info = text.failure_info(F.lit("Unhandled error"), message, cause)
    return v.table(spark, sf_dir, "events").select("event_id", info.alias("info"))


@check(
    "prj_timestamp",
    """SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS stored_at FROM events""",
)
def timestamps(spark, sf_dir):
    millis = F.expr("unix_millis(cast(ts AS timestamp))")
    return v.table(spark, sf_dir, "events").select(
        "event_id", text.millis_to_timestamp(millis).alias("stored_at")
    )
