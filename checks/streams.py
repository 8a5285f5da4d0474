"""Structured Streaming runs over the driver's tables, compared by the state they end in."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.intake import RESULT_VALUE
from checks.ledger import ADMITTED, CAP, FOLDED, PROGRESS_CHANGES, cap, row
from checks.registry import check
from haulbook.operators.filters import done, undone
from haulbook.schemas import TRANSFER_COLUMNS
from haulbook.session import run_dir
from haulbook.sources import messages
from haulbook.sources.ledger import Ledger
from haulbook.streaming import progress_state, runner, stages
from haulbook.streaming.listen import Listener, listen, signals, ticks


#: Progress messages of a file of a topic, and transfers of a group of state and of a bucket of the ledger.
MESSAGES_PER_FILE, TRANSFERS_PER_GROUP, TRANSFERS_PER_BUCKET = 250_000, 1024, 250_000


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream."""
    schema = v.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def new_ledger(spark: SparkSession, sf_dir: str, root: str) -> Ledger:
    # Buckets of bounded size: a bucket is one task's work.
    buckets = max(8, v.table(spark, sf_dir, "orders").count() // TRANSFERS_PER_BUCKET)
    ledger = Ledger(spark, f"{root}/ledger", buckets=buckets)
    ledger.load(v.transfers(spark, sf_dir), v.requests(spark, sf_dir))
    return ledger


def drain(records: DataFrame, folder: str) -> None:
    """Write everything a stream has to parquet files."""
    query = (
        records.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    query.awaitTermination()


# --- topics


@check("src_messages", v.with_views("progress", query="SELECT * FROM progress"))
def read_topic(spark, sf_dir):
    root = run_dir(spark, "src_messages")
    messages.write_folder(messages.encode_progress(v.progress(spark, sf_dir)), f"{root}/topic")
    drain(messages.as_progress(messages.decode(messages.folder_stream(spark, f"{root}/topic"))), root)
    return spark.read.parquet(f"{root}/out")


@check(
    "src_microbatch",
    v.with_views("results", query=f"SELECT {RESULT_VALUE} AS value, arrival, TRUE AS is_bounded FROM results"),
)
def microbatches(spark, sf_dir):
    """Eight files, at most two per batch: no batch is larger, and the batches hold each record once."""
    root = run_dir(spark, "src_microbatch")
    records = messages.encode_results(v.results(spark, sf_dir)).repartition(8, "arrival")
    messages.write_folder(records, f"{root}/topic")

    def write(batch: DataFrame, number: int) -> None:
        source = F.col("_metadata.file_path")
        batch.withColumn("file", source).write.mode("overwrite").parquet(f"{root}/batches/batch={number}")

    stream = messages.folder_stream(spark, f"{root}/topic", max_files=2)
    query = (
        stream.select("value", "arrival", "_metadata")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    taken = spark.read.parquet(f"{root}/batches")
    sizes = taken.groupBy("batch").agg((F.count_distinct("file") <= 2).alias("is_bounded"))
    return taken.join(sizes, "batch").select("value", "arrival", "is_bounded")


# --- the listening job

STATE = f"""
    SELECT t.* FROM transfers t WHERE t.id NOT IN (SELECT id FROM folded)
    UNION ALL BY NAME SELECT * FROM folded UNION ALL BY NAME SELECT * FROM children"""
ADMITTED_AFTER = f"""
    SELECT s.id FROM state s JOIN requests r ON r.id = s.request_id WHERE s.status = 'pending'
    ORDER BY s.priority DESC, r.received_at, s.id
    LIMIT (SELECT greatest(0, {CAP} - count(*)) FROM state WHERE status IN ('submitted', 'inprogress'))"""
IS_ADMITTED = "id IN (SELECT id FROM admitted)"
AFTER_LISTENING = v.with_views(
    "requests",
    "transfers",
    "latest_progress",
    "result_infos",
    "children",
    progressed=PROGRESS_CHANGES,
    folded=FOLDED,
    state=STATE,
    admitted=ADMITTED_AFTER,
    query=f"""SELECT {row(status=f"CASE WHEN {IS_ADMITTED} THEN 'submitted' ELSE status END",
                          submitted_at=f"CASE WHEN {IS_ADMITTED} THEN {v.NOW_SQL} ELSE submitted_at END")}
              FROM state""",
)


class Killed(Listener):
    """Stops where a batch has written everything and its query has not committed it."""

    def handle(self, messages: DataFrame, batch: int) -> None:
        super().handle(messages, batch)
        raise InterruptedError("killed between write and commit")


def run_until_killed(stream: DataFrame, ledger: Ledger, **options) -> None:
    try:
        listen(stream, Killed(ledger, **options), available_now=True).awaitTermination()
    except StreamingQueryException as error:
        if "killed between" not in str(error):
            raise
        return
    raise AssertionError("the stream was not killed")


def all_signals(spark, sf_dir) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    progress = v.progress_of(table_stream(spark, sf_dir, "lineitem"), orders)
    return signals(progress, v.results_of(table_stream(spark, sf_dir, "events"), orders))


@check("str_listen", AFTER_LISTENING)
def listening(spark, sf_dir):
    root = run_dir(spark, "str_listen")
    ledger = new_ledger(spark, sf_dir, root)
    listener = Listener(ledger, cap(spark, sf_dir), f"{root}/outbox", clock=v.now)
    listen(all_signals(spark, sf_dir), listener, available_now=True).awaitTermination()
    return ledger.transfers()


@check("str_exactly_once", AFTER_LISTENING)
def exactly_once(spark, sf_dir):
    """The query is killed after its batch has written and before it commits; the next one processes the batch again."""
    root = run_dir(spark, "str_exactly_once")
    ledger = new_ledger(spark, sf_dir, root)
    run_until_killed(all_signals(spark, sf_dir), ledger, max_in_flight=cap(spark, sf_dir), clock=v.now)
    listen(all_signals(spark, sf_dir), Listener(ledger, cap(spark, sf_dir), clock=v.now), available_now=True).awaitTermination()
    return ledger.transfers()


@check(
    "str_progress_state",
    v.with_views(
        "latest_progress",
        "results",
        query="SELECT * FROM latest_progress ANTI JOIN results USING (request_id, transfer_id)",
    ),
)
def progress_in_state(spark, sf_dir):
    """Messages of both topics spread over files and batches without regard to their order; ended transfers have no state."""
    root = run_dir(spark, "str_progress_state")
    topics = {"progress": messages.encode_progress(v.progress(spark, sf_dir)), "results": messages.encode_results(v.results(spark, sf_dir))}
    # Files of some size, in two batches.
    files = max(4, v.table(spark, sf_dir, "lineitem").count() // MESSAGES_PER_FILE)
    streams = []
    for name, records in topics.items():
        messages.write_folder(records.repartition(files, "arrival"), f"{root}/{name}")
        streams.append(messages.decode(messages.folder_stream(spark, f"{root}/{name}", max_files=-(-files // 2))))
    stream = signals(messages.as_progress(streams[0]), messages.as_results(streams[1]))
    groups = max(64, v.table(spark, sf_dir, "orders").count() // TRANSFERS_PER_GROUP)
    query = progress_state.start_progress_state(stream, f"{root}/closed", f"{root}/checkpoint", groups=groups)
    query.awaitTermination()
    return progress_state.read_progress_state(spark, f"{root}/checkpoint")


@check(
    "str_sweep",
    v.with_views(
        "requests",
        "transfers",
        admitted=ADMITTED,
        query=f"SELECT {row(status="'submitted'", submitted_at=v.NOW_SQL)} FROM admitted",
    ),
)
def sweeping(spark, sf_dir):
    root = run_dir(spark, "str_sweep")
    ledger = new_ledger(spark, sf_dir, root)
    listener = Listener(ledger, cap(spark, sf_dir), f"{root}/outbox", clock=v.now)
    listen(ticks(table_stream(spark, sf_dir, "events")), listener, available_now=True).awaitTermination()
    return ledger.changes(0).select(*TRANSFER_COLUMNS)


@check(
    "str_no_double_submit",
    v.with_views(
        "requests",
        "transfers",
        admitted=ADMITTED,
        query="SELECT id AS transfer_id, CAST(1 AS BIGINT) AS submissions FROM admitted",
    ),
)
def no_double_submit(spark, sf_dir):
    """A sweep that is killed before its commit, its replay and the next sweep: every transfer is in the outbox once."""
    root = run_dir(spark, "str_no_double_submit")
    ledger = new_ledger(spark, sf_dir, root)
    records = messages.encode_results(v.results(spark, sf_dir)).repartition(2, "arrival")
    messages.write_folder(records, f"{root}/ticks")
    stream = ticks(messages.folder_stream(spark, f"{root}/ticks", max_files=1))
    options = {"max_in_flight": cap(spark, sf_dir), "outbox": f"{root}/outbox", "clock": v.now}
    run_until_killed(stream, ledger, **options)
    listen(stream, Listener(ledger, **options), available_now=True).awaitTermination()
    sent = messages.as_requests(messages.decode(messages.read_folder(spark, f"{root}/outbox/*")))
    return sent.groupBy("transfer_id").agg(F.count(F.lit(1)).alias("submissions"))


# --- the transfer stages, with a runner that moves through an object's bytes


@dataclass(frozen=True)
class RangeRunner:
    """Moves ``chunk`` bytes a step; an empty object ends at once, a negative size fails, ``objects`` expands."""

    chunk: int = 100

    def initialize(self, request: Any):
        if "objects" in request:
            return runner.Expanded([{"object": name, "size": self.chunk} for name in request["objects"]])
        if request["size"] < 0:
            raise ValueError("no such size") from KeyError(request["object"])
        return self.at(request["object"], 0, request["size"])

    def step(self, progress: Any):
        return self.at(progress["object"], progress["offset"] + self.chunk, progress["size"])

    def at(self, name: str, offset: int, size: int):
        if offset >= size:
            return runner.Done({"object": name, "bytes": size})
        return runner.Progress({"object": name, "offset": offset, "size": size})


#: Sizes by order key; the last place is taken by requests for two objects.
SIZES = (-1, 0, 100, 101, 250, -2)


def range_requests(spark, sf_dir) -> DataFrame:
    """Every order as a request for an object of -1 to 250 bytes, or for two objects."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("o"), key)
    size = F.element_at(F.array(*map(F.lit, SIZES)), (key % 6 + 1).cast("int"))
    body = F.when(key % 6 == 5, F.concat(F.lit('{"objects":["'), name, F.lit('a","'), name, F.lit('b"]}'))).otherwise(
        F.concat(F.lit('{"object":"'), name, F.lit('","size":'), size, F.lit("}"))
    )
    return v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("request_id"),
        key.cast("string").alias("transfer_id"),
        body.alias("body"),
        key.alias("arrival"),
    )


RANGES = f"""
    SELECT CAST(o_custkey AS VARCHAR) AS request_id, CAST(o_orderkey AS VARCHAR) AS transfer_id, o_orderkey AS arrival,
           'o' || o_orderkey AS object, {list(SIZES)}[o_orderkey % 6 + 1] AS size FROM orders"""


def ended_at_once(failure: str, empty: str) -> str:
    return f"""
    SELECT request_id, transfer_id, arrival, 0 AS step, TRUE AS is_done,
           CASE size WHEN -1 THEN 'FATAL_FAILURE' WHEN 0 THEN 'SUCCESS' ELSE 'EXPANDED' END AS signal,
           replace(CASE size WHEN -1 THEN '{failure}' WHEN 0 THEN '{empty}'
                        ELSE '[{{"object":"$a","size":100}},{{"object":"$b","size":100}}]' END, '$', object) AS info
    FROM ranges WHERE size <= 0"""


MESSAGE = '"message":"Unhandled error initializing transfer: no such size"'
DETAIL = """"detail":"''$''\""""
ENDED_AT_ONCE = ended_at_once(f"{{{MESSAGE},{DETAIL}}}", '{"object":"$","bytes":0}')
#: Decoded messages have their keys in alphabetic order.
ENDED_DECODED = ended_at_once(f"{{{DETAIL},{MESSAGE}}}", '{"bytes":0,"object":"$"}')
STARTED = """
    SELECT request_id, transfer_id, arrival, 0 AS step, FALSE AS is_done, CAST(NULL AS VARCHAR) AS signal,
           '{"object":"' || object || '","offset":0,"size":' || size || '}' AS info
    FROM ranges WHERE size > 0"""


@check(
    "udf_runner",
    v.with_views(
        ranges=RANGES,
        ended=ENDED_AT_ONCE,
        started=STARTED,
        query="""SELECT * FROM ended UNION ALL SELECT * FROM started
                 UNION ALL SELECT request_id, transfer_id, arrival, 1 AS step, size <= 100 AS is_done,
                                  CASE WHEN size <= 100 THEN 'SUCCESS' END AS signal,
                                  CASE WHEN size <= 100 THEN '{"object":"' || object || '","bytes":' || size || '}'
                                       ELSE '{"object":"' || object || '","offset":100,"size":' || size || '}' END AS info
                           FROM ranges WHERE size > 0""",
    ),
)
def run_user_code(spark, sf_dir):
    first = runner.initialize(range_requests(spark, sf_dir), RangeRunner())
    return first.unionByName(runner.advance(undone(first), RangeRunner()))


@check(
    "set_branch",
    v.with_views(
        ranges=RANGES,
        ended=ENDED_AT_ONCE,
        started=STARTED,
        query="""SELECT 'result' AS topic, transfer_id, info FROM ended
                 UNION ALL SELECT 'progress' AS topic, transfer_id, info FROM started""",
    ),
)
def branch(spark, sf_dir):
    steps = runner.initialize(range_requests(spark, sf_dir), RangeRunner())
    written = f"{run_dir(spark, 'set_branch')}/steps"
    steps.write.parquet(written)
    steps = spark.read.parquet(written)
    going, ended = undone(steps), done(steps)
    going = going.select(F.lit("progress").alias("topic"), "transfer_id", "info")
    return going.unionByName(ended.select(F.lit("result").alias("topic"), "transfer_id", "info"))


def range_topics(spark, sf_dir, name: str) -> tuple[stages.Topics, str]:
    root = run_dir(spark, name)
    topics = stages.Topics(f"{root}/topics")
    requests = range_requests(spark, sf_dir).withColumnRenamed("transfer_id", "id")
    records = messages.encode_requests(requests, F.col("arrival"))
    messages.write_folder(records, f"{topics.requests}/initial")
    return topics, f"{root}/work"


@check(
    "str_init_stage",
    v.with_views(
        ranges=RANGES,
        ended=ENDED_DECODED,
        started=STARTED,
        query="""SELECT request_id, transfer_id, step, NULL AS signal, info FROM started
                 UNION ALL SELECT request_id, transfer_id, -1 AS step, signal, info FROM ended""",
    ),
)
def init_stage(spark, sf_dir):
    topics, work = range_topics(spark, sf_dir, "str_init_stage")
    stages.start_init_stage(spark, topics, RangeRunner(), work).awaitTermination()
    started = messages.as_progress(messages.decode(messages.read_folder(spark, f"{topics.progress}/*")))
    ended = messages.as_results(messages.decode(messages.read_folder(spark, f"{topics.results}/*")))
    rows = started.unionByName(ended, allowMissingColumns=True).drop("arrival")
    return rows.withColumn("step", F.coalesce("step", F.lit(-1)))


@check(
    "str_step_stage",
    v.with_views(
        ranges=RANGES,
        ended=ENDED_DECODED,
        query="""SELECT request_id, transfer_id, signal, info FROM ended
                 UNION ALL SELECT request_id, transfer_id, 'SUCCESS' AS signal,
                                  '{"bytes":' || size || ',"object":"' || object || '"}' AS info
                           FROM ranges WHERE size > 0""",
    ),
)
def step_stage(spark, sf_dir):
    topics, work = range_topics(spark, sf_dir, "str_step_stage")
    stages.run_until_done(spark, topics, RangeRunner(), work)
    ended = messages.as_results(messages.decode(messages.read_folder(spark, f"{topics.results}/*")))
    return ended.drop("arrival")
