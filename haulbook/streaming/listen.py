"""The listening job: the one streaming query that writes the ledger.

Bulk requests, control messages, progress, results and ticks arrive as one union of tagged messages. Within a batch they
take effect in this order, each stage seeing what the ones before it did: intake; reconsider requests, then transfers;
re-prioritise requests, then transfers; progress, then results with the children of expansions; and last a sweep that admits
pending transfers while the cap leaves room. Every stage is an append of its own to the ledger under the batch's number, which
the query's checkpoint gives: a batch that was cut off is processed again, from the same messages and the same state, and
overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from haulbook.plans import control, intake
from haulbook.plans.admission import SWEEP_INTERVAL, admit
from haulbook.plans.folds import apply_folded, expand, folded
from haulbook.schemas import BULK_REQUEST, PROGRESS, RESULTS, TRANSFER_COLUMNS
from haulbook.sources.ledger import LAST_STAGE, Ledger, exists
from haulbook.sources.messages import MAX_WAIT, encode_requests, write_folder

#: What a message can be; its number is its stage within a batch.
KINDS = ("submit", "reconsider_requests", "reconsider_transfers", "prioritise_requests", "prioritise_transfers", "fold")
ADMIT_STAGE = LAST_STAGE

#: Messages of all kinds. ``signal`` is null in progress messages, ``step`` in results; ``bulk`` is there in submissions alone.
MESSAGES = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        *PROGRESS.fields,
        RESULTS["signal"],
        T.StructField("priority", T.ShortType()),
        T.StructField("bulk", T.StructType([field for field in BULK_REQUEST.fields if field.name != "request_id"])),
    ]
)

#: Answers to submissions and control messages: a count for what was found, a reason (and errors of a payload) for the rest.
REPLIES = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("transfer_id", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("updated_count", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)


def typed(rows: DataFrame, schema: T.StructType, **constants: str) -> DataFrame:
    """Rows with just these columns; constants where given, null where the rows have none."""
    columns = []
    for field in schema.fields:
        own = F.col(field.name) if field.name in rows.columns else F.lit(constants.get(field.name)).cast(field.dataType)
        # The order of arrival has the type of its topic.
        columns.append((own if field.name == "arrival" else own.cast(field.dataType)).alias(field.name))
    return rows.select(*columns)


def utc_now() -> Column:
    """Wall-clock time in UTC, without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def tagged(kind: str, rows: DataFrame) -> DataFrame:
    """Rows as messages of a kind; columns that the kind does not have are null."""
    return typed(rows, MESSAGES, kind=kind)


def signals(progress: DataFrame, results: DataFrame) -> DataFrame:
    """Decoded progress and result messages as one stream."""
    return tagged("fold", progress).unionByName(tagged("fold", results))


def submissions(bulk: DataFrame) -> DataFrame:
    """Bulk requests (request_id, transfers, defaults) as messages."""
    return tagged("submit", bulk.withColumn("bulk", F.struct("transfers", "defaults")))


def commands(kind: str, targets: DataFrame) -> DataFrame:
    """Control messages: targets with request_id, and id, priority and arrival as the kind needs them."""
    return tagged(kind, targets.withColumnRenamed("id", "transfer_id") if "id" in targets.columns else targets)


def ticks(stream: DataFrame) -> DataFrame:
    """Any stream, such as Spark's rate source, as messages that only make a batch happen, and with it a sweep."""
    return tagged("tick", stream.select())


@dataclass
class Listener:
    """What a batch does to the ledger. Without ``max_in_flight`` nothing is admitted.

    With ``schema``, payloads are validated; unless ``strict``, expansions of unknown transfers are set aside instead of
    failing the batch. Envelopes of admitted transfers go to the folder ``outbox``, as the last thing a batch does.
    """

    ledger: Ledger
    max_in_flight: int | None = None
    outbox: str | None = None
    strict: bool = True
    clock: Callable[[], Column] = utc_now
    schema: Mapping | str | None = None

    def handle(self, messages: DataFrame, batch: int) -> None:
        """One batch of the stream."""
        if self.outbox is not None and exists(messages.sparkSession, f"{self._sent(batch)}/_SUCCESS"):
            # Cut off between its end and its commit. Sending again would submit twice.
            return
        self.ledger.fold_if_due(batch)
        # Every stage picks its own messages, the fold reads them several times.
        messages = messages.persist()
        try:
            kinds = {row[0] for row in messages.select("kind").distinct().collect()}
            if unknown := kinds - {*KINDS, "tick"}:
                raise ValueError(f"messages of unknown kinds: {sorted(map(str, unknown))}")
            for stage, kind in enumerate(KINDS):
                if kind in kinds:
                    getattr(self, kind)(messages.where(F.col("kind") == kind), batch, stage)
        finally:
            messages.unpersist()
        self.sweep(batch)

    def submit(self, messages: DataFrame, batch: int, stage: int) -> None:
        """New requests with all their transfers, but for requests with a bad payload; a request that is there already
        stays as it is."""
        first = messages.select("request_id", "bulk", "bulk.*", "arrival").groupBy("request_id").agg(
            F.min_by(F.struct("transfers", "defaults"), F.struct("arrival", F.to_json("bulk"))).alias("bulk")
        )
        bulk = first.select("request_id", "bulk.*")
        known = self.ledger.requests(batch, stage).select(F.col("id").alias("request_id"))
        old = bulk.select("request_id").join(known, "request_id", "left_semi")
        new = bulk.join(known, "request_id", "left_anti")
        staging = f"{self.ledger.root}/staging/batch={batch}"
        taken = intake.submit_bulk(new, self.clock(), self.schema, staging)
        self.ledger.append(batch, stage, taken.transfers, taken.requests)
        self._reply(batch, "submit", taken.acks, taken.rejected, old.withColumn("reason", F.lit(control.CONFLICT)))

    def reconsider_requests(self, messages: DataFrame, batch: int, stage: int) -> None:
        targets = messages.select("request_id").distinct()
        requests = self.ledger.requests(batch, stage)
        self._controlled(control.reconsider_requests(self.ledger.transfers(batch, stage), requests, targets), batch, stage)

    def reconsider_transfers(self, messages: DataFrame, batch: int, stage: int) -> None:
        targets = messages.select("request_id", F.col("transfer_id").alias("id")).distinct()
        self._controlled(control.reconsider_transfers(self.ledger.transfers(batch, stage), targets), batch, stage)

    def prioritise_requests(self, messages: DataFrame, batch: int, stage: int) -> None:
        """Of several priorities for one target the one that arrived last."""
        targets = messages.groupBy("request_id").agg(F.max_by("priority", "arrival").alias("priority"))
        requests = self.ledger.requests(batch, stage)
        self._controlled(control.prioritise_requests(self.ledger.transfers(batch, stage), requests, targets), batch, stage)

    def prioritise_transfers(self, messages: DataFrame, batch: int, stage: int) -> None:
        targets = messages.groupBy("request_id", F.col("transfer_id").alias("id")).agg(
            F.max_by("priority", "arrival").alias("priority")
        )
        self._controlled(control.prioritise_transfers(self.ledger.transfers(batch, stage), targets), batch, stage)

    def fold(self, messages: DataFrame, batch: int, stage: int) -> None:
        """New images of the transfers that messages are about, and the children of expansions."""
        now = self.clock()
        messages = messages.select(*PROGRESS.fieldNames(), "signal")
        # Reduced once, whatever number of parts the ledger has.
        once = folded(messages).persist()
        try:
            self._fold(messages, once, batch, stage, now)
        finally:
            once.unpersist()

    def _fold(self, messages: DataFrame, once: DataFrame, batch: int, stage: int, now: Column) -> None:
        ids = once.select(F.col("transfer_id").alias("id")).distinct()
        # The snapshot meets the messages in one join. Images are reduced to the transfers in question before they are grouped.
        snapshot, *images = self.ledger.parts(batch, stage)
        parts = [snapshot, *(part.join(ids, "id", "left_semi") for part in images)]
        changed = reduce(DataFrame.unionByName, [apply_folded(part, once, now) for part in parts])
        transfers, requests = reduce(DataFrame.unionByName, parts), self.ledger.requests(batch, stage)
        expansion = expand(transfers, messages.where(F.col("signal").isNotNull()), requests, self.strict)
        if not self.strict:
            expansion.rejected.write.mode("overwrite").parquet(f"{self.ledger.root}/rejected/batch={batch}")
        self.ledger.append(batch, stage, changed.unionByName(expansion.children))

    def sweep(self, batch: int) -> None:
        """Submit what the cap leaves room for, and put the envelopes into the outbox."""
        if self.max_in_flight is None:
            return
        transfers = self.ledger.open_transfers(batch, ADMIT_STAGE)
        requests = self.ledger.requests(batch, ADMIT_STAGE)
        self.ledger.append(batch, ADMIT_STAGE, admit(transfers, requests, self.max_in_flight, self.clock()))
        if self.outbox is not None:
            sent = encode_requests(self.ledger.changes(batch, ADMIT_STAGE), F.lit(batch).cast("bigint"))
            write_folder(sent, self._sent(batch), "overwrite")

    def replies(self, spark: SparkSession) -> DataFrame:
        """Answers to all submissions and control messages, with the batch they were part of."""
        folder = f"{self.ledger.root}/replies"
        return spark.read.schema(REPLIES).option("basePath", folder).parquet(folder)

    def _controlled(self, outcome: control.Outcome, batch: int, stage: int) -> None:
        self.ledger.append(batch, stage, outcome.changed.select(*TRANSFER_COLUMNS))
        self._reply(batch, KINDS[stage], outcome.acks, outcome.rejected)

    def _reply(self, batch: int, kind: str, *answers: DataFrame) -> None:
        rows = [typed(answer.withColumnRenamed("id", "transfer_id"), REPLIES, kind=kind) for answer in answers]
        folder = f"{self.ledger.root}/replies/batch={batch}/stage={KINDS.index(kind)}"
        reduce(DataFrame.unionByName, rows).write.mode("overwrite").parquet(folder)

    def _sent(self, batch: int) -> str:
        return f"{self.outbox}/sweep-{batch}"


def listen(
    messages: DataFrame, listener: Listener, available_now: bool = False, max_wait: str = MAX_WAIT, ticking: bool = False
) -> StreamingQuery:
    """Start the ledger's writer on a stream of tagged messages; ``ticking`` adds a tick per sweep interval."""
    if ticking:
        spark = messages.sparkSession
        seconds = SWEEP_INTERVAL.split()[0]
        source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1)
        messages = messages.unionByName(ticks(source.option("advanceMillisPerBatch", int(seconds) * 1000).load()))
        max_wait = SWEEP_INTERVAL
    writer = messages.writeStream.foreachBatch(listener.handle).option("checkpointLocation", listener.ledger.checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=max_wait).start()
