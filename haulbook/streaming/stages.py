"""The transfer stages as streams: requests to first steps, and progress to next steps until a result.

Each batch writes its steps once, then routes them to the progress and the result topic; all three folders are named
after the batch, so a replayed batch overwrites what it wrote before and user code runs at least once per step.

`start_stages` is both stages in one query, for as long as it is wanted: what it adds to the progress topic is part of its own
source, so every batch takes the next step of all that is under way beside the first step of what has come in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haulbook.operators.filters import done, undone
from haulbook.sources.messages import (
    as_progress,
    as_requests,
    decode,
    encode_progress,
    encode_results,
    folder_stream,
    write_folder,
)
from haulbook.streaming.runner import STEPS_DDL, Runner, advance, initialize


@dataclass(frozen=True)
class Topics:
    """Folders of the three topics; every writer has its own sub-folder per batch."""

    root: str

    @property
    def requests(self) -> str:
        return f"{self.root}/requests"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    @property
    def results(self) -> str:
        return f"{self.root}/results"


def route(steps: DataFrame, topics: Topics, writer: str, batch: int) -> None:
    """Unfinished steps to the progress topic, the others to the result topic."""
    write_folder(encode_progress(undone(steps)), f"{topics.progress}/{writer}-{batch}", "overwrite")
    write_folder(encode_results(done(steps)), f"{topics.results}/{writer}-{batch}", "overwrite")


def _stage(
    spark: SparkSession, source: str, topics: Topics, work_dir: str, writer: str, take_step, max_files: int | None
) -> StreamingQuery:
    def handle(batch: DataFrame, number: int) -> None:
        # Later batches hold later arrivals, so that the order of results follows the order of steps.
        steps = take_step(decode(batch)).withColumn("arrival", F.lit(number).cast("bigint"))
        written = f"{work_dir}/{writer}-steps/batch={number}"
        steps.write.mode("overwrite").parquet(written)
        route(batch.sparkSession.read.schema(STEPS_DDL).parquet(written), topics, writer, number)

    records = folder_stream(spark, f"{source}/*", max_files)
    return (
        records.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{work_dir}/{writer}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def start_init_stage(
    spark: SparkSession, topics: Topics, runner: Runner, work_dir: str, max_files: int | None = None
) -> StreamingQuery:
    """Take the first step of everything on the request topic."""
    return _stage(
        spark,
        topics.requests,
        topics,
        work_dir,
        "init",
        lambda records: initialize(as_requests(records), runner),
        max_files,
    )


def start_step_stage(
    spark: SparkSession, topics: Topics, runner: Runner, work_dir: str, max_files: int | None = None
) -> StreamingQuery:
    """Take the next step of everything on the progress topic, which the stage itself adds to."""
    return _stage(
        spark,
        topics.progress,
        topics,
        work_dir,
        "step",
        lambda records: advance(as_progress(records), runner),
        max_files,
    )


def start_stages(
    requests: DataFrame,
    progress: DataFrame,
    runner: Runner,
    work_dir: str,
    send: Callable[[DataFrame, int], None],
    interval: str = "0 seconds",
) -> StreamingQuery:
    """Take first steps of the records of one stream and next steps of those of another, which ``send`` adds to.

    ``send`` gets the steps of a batch and its number. It must not add to the topic where no step is unfinished.
    """

    def handle(batch: DataFrame, number: int) -> None:
        first = initialize(as_requests(decode(batch.where("is_request"))), runner)
        further = advance(as_progress(decode(batch.where("NOT is_request"))), runner)
        # Later batches hold later arrivals, so that the order of results follows the order of steps.
        steps = first.unionByName(further).withColumn("arrival", F.lit(number).cast("bigint"))
        written = f"{work_dir}/steps/batch={number}"
        steps.write.mode("overwrite").parquet(written)
        send(batch.sparkSession.read.schema(STEPS_DDL).parquet(written), number)

    records = [
        stream.select("value", "arrival", F.lit(is_request).alias("is_request"))
        for stream, is_request in ((requests, True), (progress, False))
    ]
    writer = records[0].unionByName(records[1]).writeStream.foreachBatch(handle)
    return writer.option("checkpointLocation", f"{work_dir}/checkpoint").trigger(processingTime=interval).start()


def start_folder_stages(
    spark: SparkSession, topics: Topics, runner: Runner, work_dir: str, max_files: int | None = None
) -> StreamingQuery:
    """`start_stages` between topics kept in folders."""

    def send(steps: DataFrame, number: int) -> None:
        # A file without records would be new input too, and the query would never find an end.
        kinds = {row[0] for row in steps.select("is_done").distinct().collect()}
        if False in kinds:
            write_folder(encode_progress(undone(steps)), f"{topics.progress}/steps-{number}", "overwrite")
        if True in kinds:
            write_folder(encode_results(done(steps)), f"{topics.results}/steps-{number}", "overwrite")

    requests, progress = (folder_stream(spark, f"{folder}/*", max_files) for folder in (topics.requests, topics.progress))
    return start_stages(requests, progress, runner, work_dir, send)


def run_until_done(
    spark: SparkSession, topics: Topics, runner: Runner, work_dir: str, max_files: int | None = None
) -> None:
    """Run the stages in one query until no transfer is left in progress: then a trigger finds nothing new in the topics."""
    query = start_folder_stages(spark, topics, runner, work_dir, max_files)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
