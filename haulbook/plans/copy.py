"""The bulk copy: decided requests become chunk tasks spread by bytes, copied, retried, finished and reported.

Everything a run decides or achieves is written under its working folder before the next stage reads it: the plan, and
per attempt the outcome of every chunk. Running again in the same folder copies only what has not succeeded, so a lost
executor or driver costs the chunks that were in flight; a new job can take up from progress messages instead.

Chunks of a large object are written by many tasks, as part objects that one task streams together in the end. A task writes
adjoining chunks into one part; a file that has become a single part only needs its name. Only where
``shared_target`` says that all executors see one file system are they written in place, at their offset; there every chunk is
read back before the object gets its name. Copies within one store can be left to the store (``rewrite``). An object whose
content is not the expected one fails, and its target is not there.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulbook.functions.json import as_tuple
from haulbook.functions.text import failure_info
from haulbook.operators import preflight
from haulbook.operators.ranges import (
    CHUNKS_PER_BLOCK,
    DEFAULT_STEP,
    MIB,
    chunk_blocks,
    chunks_of_blocks,
    tasks_for,
)
from haulbook.sources.ledger import finished_folders
from haulbook.sources.messages import envelope, write_folder
from haulbook.sources.objects import (
    copy_bytes,
    copy_in_store,
    delete_objects,
    open_path,
    pieces,
    put_whole,
    repartition_by_bytes,
    require_md5,
    set_content_type,
    write_whole,
)

#: Retries of failed chunks and the longest pause before one, in seconds, unless configured otherwise.
MAX_RETRIES = 4
MAX_DELAY = 16

#: Objects or chunks a task handles at most, however small they are (unless that makes too many tasks).
OBJECTS_PER_TASK = 10_000

#: Chunks that a part holds at most, a power of two. Parts begin and end within a block of so many, whatever job writes them.
CHUNKS_PER_PART = 64

#: Ranges that a progress message carries at most, the longest; what it leaves out is copied again.
MAX_RANGES = 1000

#: Largest object that a store copies within itself in one call, by scheme. Others have no limit.
REWRITE_LIMITS = {"s3": 5 << 30, "s3a": 5 << 30, "s3n": 5 << 30}

PLAN_DDL = (
    "source_path string, target_path string, source_size bigint, decision string, reason string, content_type string, "
    "expected_md5 string, request_id string, transfer_id string, delete_target boolean, is_rewrite boolean"
)
TASK_COLUMNS = ["source_path", "target_path", "source_size", "start", "end", "is_whole", "is_rewrite", "content_type", "expected_md5"]
OUTCOME_DDL = (
    "source_path string, target_path string, source_size bigint, start bigint, end bigint, is_whole boolean, "
    "md5 string, moved bigint, error string, part string"
)
FINISH_DDL = "target_path string, error string"
RANGES_DDL = "array<struct<start: bigint, end: bigint>>"


@dataclass(frozen=True)
class CopyJob:
    """A copy of decided requests, resumable under ``work_dir``.

    ``bytes_per_report``: bytes copied between two progress reports, which go to the folder ``outbox`` for requests with
    request_id and transfer_id.
    """

    spark: SparkSession
    work_dir: str
    step: int = DEFAULT_STEP
    max_retries: int = MAX_RETRIES
    max_delay: int = MAX_DELAY
    bytes_per_task: int = 256 * MIB
    shared_target: bool = False
    rewrite: bool = False
    outbox: str | None = None
    bytes_per_report: int | None = None
    #: Where this job has written the last outcomes of so many attempts.
    known: dict[int, str] = field(default_factory=dict, init=False, repr=False, compare=False)

    def run(self, decided: DataFrame, resumed: DataFrame | None = None) -> DataFrame:
        """Copy, and return one report row per request. ``resumed``: (target_path, ranges) that are there already."""
        self.write_plan(decided)
        if resumed is not None and not self._attempts():
            self.take_up(resumed)
        for attempt in range(self.max_retries + 1):
            if attempt:
                time.sleep(min(2 ** (attempt - 1), self.max_delay))
            # Finishing may find that chunks have to be copied again, so it is part of what is retried.
            if self.attempt() + self.check_in_place() + self.finish() == 0:
                break
        return self.report()

    # --- stages

    def write_plan(self, decided: DataFrame) -> None:
        """Fix the decisions, as copying changes what they were based on; a resumed run keeps the first ones."""
        if not self._is_written("plan"):
            # Written before use: manifests may be made by reading every object, which is done once this way.
            names = [field.split()[0] for field in PLAN_DDL.split(", ")]
            kinds = dict(field.split() for field in PLAN_DDL.split(", "))
            rows = decided.withColumn("is_rewrite", self._is_rewrite())
            if "delete_target" in rows.columns:
                rows = rows.withColumn("delete_target", F.coalesce("delete_target", F.lit(False)))
            columns = [(F.col(name) if name in rows.columns else F.lit(None)).cast(kinds[name]).alias(name) for name in names]
            rows.select(*columns).write.mode("overwrite").parquet(f"{self.work_dir}/plan")
        if not self._is_written("deleted"):
            doomed = self.spark.read.parquet(f"{self.work_dir}/plan").where("delete_target")
            doomed = doomed.select(F.col("target_path").alias("path"))
            doomed = repartition_by_bytes(doomed, tasks_for(doomed.count(), OBJECTS_PER_TASK), "path")
            delete_objects(doomed).write.mode("overwrite").parquet(f"{self.work_dir}/deleted")

    def _is_rewrite(self) -> Column:
        """Whether source and target are in one store that can copy the object by itself."""
        if not self.rewrite:
            return F.lit(False)
        store = r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/]*"
        same = F.regexp_extract("source_path", store, 0) == F.regexp_extract("target_path", store, 0)
        limit = F.element_at(F.create_map(*[F.lit(x) for pair in REWRITE_LIMITS.items() for x in pair]), F.regexp_extract("source_path", store, 1))
        return same & (F.coalesce(limit, F.lit(2**63 - 1)) >= F.coalesce("source_size", F.lit(0)))

    def plan(self) -> DataFrame:
        return self.spark.read.schema(PLAN_DDL).parquet(f"{self.work_dir}/plan").drop("delete_target")

    def tasks(self, planned: DataFrame | None = None) -> DataFrame:
        """Chunks to copy; a small object is one chunk that is written whole, and so is one that its store copies, unless
        chunks can be written in place."""
        planned = self.plan() if planned is None else planned
        others = [name for name in planned.columns if name not in TASK_COLUMNS + ["decision"]]
        at_once = (F.col("decision") == preflight.ONESHOT) | (F.col("is_rewrite") & F.lit(not self.shared_target))
        whole = planned.where(at_once & F.col("decision").isin(preflight.ONESHOT, preflight.CHUNKED)).withColumns(
            {"start": F.lit(0).cast("bigint"), "end": F.col("source_size"), "is_whole": F.lit(True)}
        )
        large = planned.where((F.col("decision") == preflight.CHUNKED) & ~at_once)
        chunks = chunks_of_blocks(chunk_blocks(large, self.step, "source_size"), self.step, "source_size")
        columns = TASK_COLUMNS + others
        return whole.select(*columns).unionByName(chunks.withColumn("is_whole", F.lit(False)).select(*columns))

    def _attempts(self) -> list[str]:
        return [path for _, path in finished_folders(self.spark, f"{self.work_dir}/attempts")]

    def outcomes(self) -> DataFrame:
        """Outcome of every chunk tried so far, with the number of the attempt."""
        paths = self._attempts()
        schema = f"{OUTCOME_DDL}, attempt int"
        if not paths:
            return self._nothing(schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.work_dir}/attempts").parquet(*paths)

    def latest(self) -> DataFrame:
        """The last outcome of each chunk: a chunk found damaged after it was copied has an error again.

        Every stage asks for these, so they are found once for each number of attempts and written.
        """
        number = len(self._attempts())
        if not number:
            return self.outcomes().drop("attempt")
        if number not in self.known:
            names = [name for name in self.outcomes().columns if name not in ("target_path", "start", "attempt")]
            last = F.max_by(F.struct(*names), "attempt").alias("last")
            rows = self.outcomes().groupBy("target_path", "start").agg(last).select("target_path", "start", "last.*")
            # Another job in this folder may have made these attempts, or others: it does not share what it wrote.
            folder = f"{self.work_dir}/latest/{uuid.uuid4().hex}"
            rows.write.parquet(folder)
            self.known[number] = folder
        names = ", ".join(sorted(OUTCOME_DDL.split(", "), key=lambda field: field.split()[0] not in ("target_path", "start")))
        return self.spark.read.schema(names).parquet(self.known[number])

    def copied(self) -> DataFrame:
        """Chunks that are at the target, once each."""
        return self.latest().where("error IS NULL")

    def take_up(self, resumed: DataFrame) -> None:
        """Chunks that lie within the ranges of another job's progress and are found at the target count as copied."""
        known = self.plan().join(resumed.groupBy("target_path").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "target_path")
        within = F.exists("ranges", lambda one: (one["start"] <= F.col("start")) & (one["end"] >= F.col("end")))
        chunks = self.tasks(known).where(~F.col("is_whole") & within).select(*TASK_COLUMNS)
        # All chunks that may be in one part are looked for by one task, however the other job dealt them.
        self._write_attempt(chunks, Mover(self.shared_target).find_chunks, run_bytes=self.step * CHUNKS_PER_PART)

    def attempt(self) -> int:
        """Copy all chunks that have not succeeded, with a report after so many bytes; returns how many failed."""
        done = self.latest().where(F.col("error").isNull() | F.col("error").startswith(WRONG_CONTENT))
        left = self.tasks().select(*TASK_COLUMNS).join(done.select("target_path", "start"), ["target_path", "start"], "left_anti")
        total, count = left.agg(F.sum(F.col("end") - F.col("start")), F.count(F.lit(1))).first()
        if not count:
            return 0
        waves = tasks_for(total, self.bytes_per_report) if self.bytes_per_report else 1
        first = len(self._attempts())
        # What is left changes with each wave; the waves are told by the plan alone.
        wave = F.pmod(F.xxhash64("target_path", "start"), F.lit(waves))
        for number in range(waves):
            self._write_attempt(left.where(wave == number) if waves > 1 else left, Mover(self.shared_target).copy_chunks, total // waves, -(-count // waves))
            self.publish()
        tried = self.outcomes().where(F.col("attempt") >= first)
        return tried.where(F.col("error").isNotNull() & ~F.col("error").startswith(WRONG_CONTENT)).count()

    def _write_attempt(
        self, chunks: DataFrame, work, total: int | None = None, count: int | None = None, run_bytes: int | None = None
    ) -> DataFrame:
        if total is None:
            total, count = chunks.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)), F.count(F.lit(1))).first()
        partitions = self._partitions(total, count)
        run = F.floor(F.col("start") / (run_bytes or self._run_bytes(total, partitions)))
        spread = repartition_by_bytes(chunks.withColumn("run", run), partitions, "target_path", "run")
        # The chunks of a run one after the other; in the order of the paths all tasks would write to one folder at a time.
        spread = spread.sortWithinPartitions(F.xxhash64("target_path"), "target_path", "start")
        folder = f"{self.work_dir}/attempts/attempt={len(self._attempts())}"
        spread.mapInPandas(work, OUTCOME_DDL).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(OUTCOME_DDL).parquet(folder)

    def _partitions(self, total: int | None, count: int) -> int:
        """Tasks for so many bytes in so many objects or chunks: no core is left out."""
        # Small objects also cost a round trip each, so a task gets a bounded number of them.
        partitions = max(tasks_for(total or 0, self.bytes_per_task), tasks_for(count, OBJECTS_PER_TASK))
        return max(partitions, min(count, self.spark.sparkContext.defaultParallelism), 1)

    def _run_bytes(self, total: int | None, partitions: int) -> int:
        """Bytes of an object that stay in one task, which writes them as one part: little of what a task gets."""
        if self.shared_target:
            return self.step
        share = (total or 0) // partitions // (4 * self.step)
        return self.step * min(CHUNKS_PER_PART, 1 << max(share, 1).bit_length() - 1)

    def complete(self) -> DataFrame:
        """Large objects all of whose bytes are there and that do not have their name yet, with the parts they are in."""
        chunks = self.copied().where("NOT is_whole")
        # A chunk without a name for its part is one by itself.
        part = F.coalesce("part", F.concat(F.lit("/"), "start")).alias("part")
        parts = chunks.groupBy("target_path", "source_size", part).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("n_bytes")
        )
        whole = parts.groupBy("target_path", "source_size").agg(
            F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("start", "end", "part"))).alias("parts")
        )
        ended = self.finished().where(F.col("error").isNull() | F.col("error").startswith(WRONG_CONTENT))
        whole = whole.where("n_bytes = source_size").join(ended, "target_path", "left_anti")
        return whole.select("target_path", "parts").join(self.plan(), "target_path")

    def check_in_place(self) -> int:
        """Read back the chunks written in place; those that differ are to be copied again. Returns how many."""
        if not self.shared_target:
            return 0
        parts = self.copied().where("NOT is_whole").join(self.complete().select("target_path"), "target_path", "left_semi")
        damaged = self._read_back(parts, ".unfinished")
        wrong = parts.join(damaged.select("target_path", "start"), ["target_path", "start"], "left_semi")
        wrong = wrong.withColumn("error", F.lit("differs at the target from what was copied"))
        names = [field.split()[0] for field in OUTCOME_DDL.split(", ")]
        folder = f"{self.work_dir}/attempts/attempt={len(self._attempts())}"
        wrong.select(*names).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(OUTCOME_DDL).parquet(folder).count()

    def finish(self) -> int:
        """Give large objects their final name once all their bytes are there; returns how many it could not."""
        complete = self.complete()
        size = complete.agg(F.sum("source_size"), F.count(F.lit(1))).first()
        number = len(finished_folders(self.spark, f"{self.work_dir}/finished"))
        if not size[1] and number:
            return 0
        complete = repartition_by_bytes(complete, self._partitions(*size), "target_path")
        folder = f"{self.work_dir}/finished/attempt={number}"
        ends, parts = F.col("parts.end").alias("ends"), F.col("parts.part").alias("parts")
        wanted = complete.select("target_path", "source_size", ends, parts, "content_type", "expected_md5")
        wanted.mapInPandas(Mover(self.shared_target).finish_objects, FINISH_DDL).write.mode("overwrite").parquet(folder)
        failed = self.spark.read.schema(FINISH_DDL).parquet(folder).where("error IS NOT NULL")
        return failed.where(~F.col("error").startswith(WRONG_CONTENT)).count()

    def finished(self) -> DataFrame:
        """How finishing last went for each object it was tried for."""
        if not finished_folders(self.spark, f"{self.work_dir}/finished"):
            return self._nothing(FINISH_DDL)
        rows = self.spark.read.schema(f"{FINISH_DDL}, attempt int").parquet(f"{self.work_dir}/finished")
        return rows.groupBy("target_path").agg(F.max_by(F.struct("error"), "attempt").alias("last")).select("target_path", "last.error")

    # --- reports

    def report(self, final: bool = True) -> DataFrame:
        """Per request: bytes copied and in total, chunks copied, how it ended, and for unfinished ones the ranges that are
        there. Unless ``final``, what failed so far still has a chance."""
        per_target = self.latest().withColumn("n_bytes", F.when(F.col("error").isNull(), F.col("end") - F.col("start")))
        progress = per_target.groupBy("target_path").agg(
            F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes_uploaded"),
            F.count("n_bytes").alias("steps"),
            F.sum(F.when(F.col("error").isNull(), F.col("moved"))).alias("bytes_through_tasks"),
            F.max("error").alias("error"),
        )
        finished = self.finished().withColumnRenamed("error", "finish_error").withColumn("is_finished", F.lit(True))
        rows = self.plan().join(progress, "target_path", "left").join(finished, "target_path", "left")
        rows = rows.join(self.done_ranges(), "target_path", "left")
        error = F.coalesce("reason", "error", "finish_error")
        lasting = F.col("reason").isNotNull() | F.coalesce(error.startswith(WRONG_CONTENT), F.lit(False)) | F.lit(final)
        at_once = (F.col("decision") == preflight.ONESHOT) | (F.col("is_rewrite") & F.lit(not self.shared_target))
        state = (
            F.when(F.col("decision") == preflight.SKIP, "skipped")
            .when(error.isNotNull() & lasting, "failed")
            .when(error.isNotNull(), "progress")
            .when(at_once & F.col("steps").isNotNull(), "copied")
            .when(F.col("is_finished"), "copied")
            .otherwise("progress")
        )
        return rows.select(
            "source_path",
            "target_path",
            "decision",
            F.coalesce("bytes_uploaded", F.lit(0)).alias("bytes_uploaded"),
            F.col("source_size").alias("total_bytes"),
            F.coalesce("steps", F.lit(0)).alias("steps"),
            state.alias("state"),
            error.alias("error"),
            "ranges",
            F.coalesce("bytes_through_tasks", F.lit(0)).alias("bytes_through_tasks"),
            "content_type",
            "request_id",
            "transfer_id",
        )

    def done_ranges(self) -> DataFrame:
        """Per target of a chunked copy, the ranges that adjoining chunks make, the MAX_RANGES longest, in order.

        Chunks are joined up block by block, so that no window holds more than a block of an object.
        """
        block = F.floor(F.col("start") / (self.step * CHUNKS_PER_BLOCK)).alias("block")
        chunks = self.copied().where("NOT is_whole").select("target_path", "start", "end", block)
        inside = Window.partitionBy("target_path", "block").orderBy("start")
        first = F.coalesce(F.lag("end").over(inside) != F.col("start"), F.lit(True))
        runs = chunks.withColumn("is_first", first.cast("int")).withColumn("run", F.sum("is_first").over(inside))
        whole = runs.groupBy("target_path", "block", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        longest = Window.partitionBy("target_path").orderBy((F.col("start") - F.col("end")), "start")
        kept = whole.withColumn("place", F.row_number().over(longest)).where(F.col("place") <= MAX_RANGES)
        return kept.groupBy("target_path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))

    def publish(self) -> None:
        """Progress of what is under way, into the outbox."""
        if self.outbox is None:
            return
        moving = self.report(final=False).where("state = 'progress' AND transfer_id IS NOT NULL")
        number = len(self._attempts())
        records = progress_records(moving).select("value", F.lit(number).cast("bigint").alias("arrival"))
        write_folder(records, f"{self.outbox}/progress-{number}", "overwrite")

    def verify_chunks(self) -> DataFrame:
        """Chunks whose bytes at the target differ from those copied; read in parallel, also within an object."""
        return self._read_back(self.copied(), "")

    def _read_back(self, parts: DataFrame, suffix: str) -> DataFrame:
        # What a store copied by itself was never read, so there is nothing to compare with.
        parts = parts.where("md5 IS NOT NULL").select(
            F.concat("target_path", F.lit(suffix)).alias("target_path"), "start", "end", "md5"
        )
        total, count = parts.agg(F.sum(F.col("end") - F.col("start")), F.count(F.lit(1))).first()
        spread = repartition_by_bytes(parts, self._partitions(total, count), "target_path", "start")
        ddl = "target_path string, start bigint, end bigint, md5 string, found string"
        wrong = spread.mapInPandas(_hash_chunks, ddl).where("found IS NULL OR found <> md5")
        return wrong.withColumn("target_path", F.left("target_path", F.length("target_path") - len(suffix)))

    def _nothing(self, schema: str) -> DataFrame:
        """No rows, known as such to the optimiser, which leaves out joins with them."""
        fields = [field.split() for field in schema.split(", ")]
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])

    def _is_written(self, name: str) -> bool:
        return any(found == name for found, _ in finished_folders(self.spark, self.work_dir))


def progress_records(report: DataFrame) -> DataFrame:
    """Envelopes for the progress topic (unfinished) and result topic (ended), from a report with transfer ids."""
    done = F.col("state").isin("copied", "skipped")
    output = F.to_json(F.struct(F.col("target_path").alias("path")))
    failure = failure_info(F.lit("Copy failed"), F.col("error"), F.lit(None).cast("string"))
    fields = [
        F.col("source_path").alias("sourcePath"),
        F.col("target_path").alias("targetPath"),
        F.col("bytes_uploaded").alias("bytesUploaded"),
        F.col("total_bytes").alias("totalBytes"),
    ]
    if "ranges" in report.columns:
        fields.append("ranges")
    message = (
        F.when(done, as_tuple(F.lit("SUCCESS"), output))
        .when(F.col("state") == "failed", as_tuple(F.lit("FATAL_FAILURE"), failure))
        .otherwise(as_tuple(F.col("steps"), F.to_json(F.struct(*fields))))
    )
    return report.select(
        F.when(F.col("state") == "progress", "progress").otherwise("result").alias("topic"),
        envelope(F.col("request_id"), F.col("transfer_id"), message).alias("value"),
    )


def resumed_from(progress: DataFrame) -> DataFrame:
    """Ranges (target_path, ranges) to take up from decoded progress messages, of each transfer the last.

    A message without ranges says that its ``bytesUploaded`` are the first ones.
    """
    last = progress.groupBy("request_id", "transfer_id").agg(F.max_by("info", F.struct("arrival", "step")).alias("info"))
    info = F.from_json("info", f"targetPath string, bytesUploaded bigint, ranges {RANGES_DDL}").alias("info")
    first = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.coalesce("bytesUploaded", F.lit(0)).alias("end")))
    rows = last.select(info).select("info.*").where("targetPath IS NOT NULL")
    return rows.select(F.col("targetPath").alias("target_path"), F.coalesce("ranges", first).cast(RANGES_DDL).alias("ranges"))


# --- what a task does with its chunks

#: How the error of an object with other content than expected begins; trying again does not help.
WRONG_CONTENT = "WrongContent"


def _unfinished(path: str) -> str:
    return f"{path}.unfinished"


def _part(start: int) -> str:
    """What the part that begins with this byte is called, after the name of the unfinished object. Most objects have the first
    one alone, which needs no folder."""
    return f"/{start}" if start else ".0"


def _part_uri(uri: str, part: str) -> str:
    return f"{_unfinished(uri)}{part}"


def _failed(problem: Exception) -> tuple:
    return None, None, f"{type(problem).__name__}: {problem}", None


@dataclass(frozen=True)
class Mover:
    """Moves and joins chunks; in place if all tasks see one file system."""

    shared_target: bool

    def _in_place(self, uri: str) -> str | None:
        files, path = open_path(uri)
        return path if self.shared_target and isinstance(files, fs.LocalFileSystem) else None

    def copy_chunk(self, row) -> tuple[str | None, int]:
        """Copies a whole object, or a chunk in place; returns its md5, if it was read, and the bytes that passed through
        this task."""
        size = row.end - row.start
        if row.is_whole:
            if row.is_rewrite:
                return copy_in_store(row.source_path, row.target_path, row.content_type, row.expected_md5)
            content = pieces(row.source_path, row.start, row.end)
            return write_whole(row.target_path, content, row.content_type, row.expected_md5)[1], size
        path = self._in_place(row.target_path)
        try:
            handle = os.open(_unfinished(path), os.O_CREAT | os.O_RDWR)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            handle = os.open(_unfinished(path), os.O_CREAT | os.O_RDWR)
        try:
            # The first chunk to come makes the file, at full length.
            os.ftruncate(handle, row.source_size)
            if row.is_rewrite:
                return None, copy_bytes(row.source_path, handle, row.start, row.end)
            digest, at = hashlib.md5(), row.start
            for piece in pieces(row.source_path, row.start, row.end):
                os.pwrite(handle, piece, at)
                digest.update(piece)
                at += len(piece)
            return digest.hexdigest(), size
        finally:
            os.close(handle)

    def copy_part(self, rows: list) -> list[tuple]:
        """Copies adjoining chunks into one part, up to the first that cannot be read; returns the outcomes of these, and of
        that one."""
        part, found, ended = _part(rows[0].start), [], []

        def content() -> Iterator[bytes]:
            for row in rows:
                digest = hashlib.md5()
                try:
                    for piece in pieces(row.source_path, row.start, row.end):
                        digest.update(piece)
                        yield piece
                except Exception as problem:
                    if not found:
                        raise
                    # What there is of it lies behind the last chunk of the part, where nobody reads.
                    ended.append(_failed(problem))
                    return
                found.append((digest.hexdigest(), row.end - row.start, None, part))

        try:
            put_whole(_part_uri(rows[0].target_path, part), content())
        except Exception as problem:
            return [_failed(problem)] * max(len(found), 1)
        return found + ended

    def copy_run(self, rows: list) -> list[tuple]:
        """Copies the chunks of a run, which adjoin each other but for gaps; returns their outcomes."""
        if not rows[0].is_whole and not self._in_place(rows[0].target_path):
            found = []
            while len(found) < len(rows):
                last = first = len(found)
                while last + 1 < len(rows) and rows[last].end == rows[last + 1].start:
                    last += 1
                found += self.copy_part(rows[first : last + 1])
            return found
        found = []
        for row in rows:
            try:
                found.append((*self.copy_chunk(row), None, None if row.is_whole else ""))
            except Exception as problem:  # one bad object must not fail its neighbours
                found.append(_failed(problem))
        return found

    def copy_chunks(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).itertuples(index=False)
            runs = groupby(rows, lambda row: (row.target_path, row.source_path, row.is_whole, row.run))
            yield _with_outcome(batch, [one for _, run in runs for one in self.copy_run(list(run))])

    def find_chunks(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Those of the chunks whose bytes are there, by the length of their part; content is compared when the object is
        finished. A part's chunks come one after the other."""
        last = None, 0, None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if self._in_place(row.target_path):
                    found.append("" if _size(_unfinished(row.target_path)) == row.source_size else None)
                    continue
                if row.target_path != last[0] or row.end > last[1]:
                    for part in dict.fromkeys((_part(row.start), f"/{row.start}")):
                        if row.start + _size(_part_uri(row.target_path, part)) >= row.end:
                            last = row.target_path, row.start + _size(_part_uri(row.target_path, part)), part
                            break
                    else:
                        last = None, 0, None
                found.append(last[2])
            kept = batch[pd.Series([part is not None for part in found], index=batch.index, dtype=bool)]
            yield _with_outcome(kept, [(None, 0, None, part) for part in found if part is not None])

    def finish_object(
        self, uri: str, size: int, ends: list[int], parts: list[str], content_type: str | None, expected_md5: str | None
    ) -> None:
        """Gives an object its name, from the parts that have its bytes up to these ends, one after the other."""
        files, path = open_path(uri)
        local = isinstance(files, fs.LocalFileSystem)
        if local and (self.shared_target or len(parts) == 1):
            lies = _unfinished(path) if self.shared_target else _part_uri(path, parts[0])
            if not os.path.exists(lies) and os.path.exists(path):
                lies = path  # a rerun finds the file already renamed
            if _size(lies) != size:
                raise OSError(f"{lies} has {_size(lies)} bytes, expected {size}")
            if expected_md5 is not None:
                digest = hashlib.md5()
                for piece in pieces(lies, 0, size):
                    digest.update(piece)
                require_md5(uri, digest.hexdigest(), expected_md5)
            if lies != path:
                set_content_type(lies, content_type)
                os.replace(lies, path)
        else:

            def content() -> Iterator[bytes]:
                at = 0
                for end, part in zip(ends, parts):
                    # Where an object was asked for twice, parts overlap.
                    first = int(part[1:])
                    yield from pieces(_part_uri(uri, part), at - first, end - first)
                    at = max(at, end)

            write_whole(uri, content(), content_type, expected_md5)
            if _part(0) in parts:
                files.delete_file(_part_uri(path, _part(0)))
        folder = _unfinished(path)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)

    def finish_objects(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                try:
                    self.finish_object(
                        row.target_path, row.source_size, list(row.ends), list(row.parts), row.content_type, row.expected_md5
                    )
                    errors.append(None)
                except Exception as problem:
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pd.DataFrame({"target_path": batch["target_path"], "error": pd.Series(errors, dtype=object, index=batch.index)})


def _size(uri: str) -> int:
    """Bytes of an object, -1 if there is none."""
    files, path = open_path(uri)
    info = files.get_file_info(path)
    return info.size if info.type == fs.FileType.File else -1


def _with_outcome(batch: pd.DataFrame, found: list[tuple]) -> pd.DataFrame:
    names = ["source_path", "target_path", "source_size", "start", "end", "is_whole"]
    columns = list(zip(*found)) if found else ([], [], [], [])
    out = batch[names].reset_index(drop=True)
    return out.assign(
        md5=pd.Series(columns[0], dtype=object),
        moved=pd.Series(columns[1], dtype="Int64"),
        error=pd.Series(columns[2], dtype=object),
        part=pd.Series(columns[3], dtype=object),
    )


def _hash_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            digest = hashlib.md5()
            try:
                for piece in pieces(row.target_path, row.start, row.end):
                    digest.update(piece)
                found.append(digest.hexdigest())
            except OSError:
                found.append(None)
        batch["found"] = pd.Series(found, dtype=object)
        yield batch
