"""Byte ranges of objects: the chunks a copy moves one by one, and the reads within a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024
#: Chunk size of a copy unless configured otherwise.
DEFAULT_STEP = 5 * MIB
#: Bytes asked for in one read.
DEFAULT_READ = MIB

#: Most tasks of a stage; a scheduler copes with more of them worse than a task with more bytes.
MAX_TASKS = 100_000

#: Chunks listed per array, so that an object of any size is unrolled through arrays of bounded length.
CHUNKS_PER_BLOCK = 4096


def byte_ranges(objects: DataFrame, step: int = DEFAULT_STEP, size: str = "size") -> DataFrame:
    """A row per chunk [start, end) of each object; an empty object has none.

    Huge objects unroll block by block: a single one of them may hold a third of all bytes.
    """
    return chunks_of_blocks(chunk_blocks(objects, step, size), step, size)


def chunk_blocks(objects: DataFrame, step: int, size: str = "size") -> DataFrame:
    """The coarse half of `byte_ranges`, after which rows can be spread over tasks."""
    block = step * CHUNKS_PER_BLOCK
    offsets = F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1, F.lit(block).cast("bigint"))
    return objects.where(F.col(size) > 0).withColumn("block_start", F.explode(offsets))


def chunks_of_blocks(blocks: DataFrame, step: int, size: str = "size") -> DataFrame:
    block_end = F.least(F.col("block_start") + step * CHUNKS_PER_BLOCK, F.col(size))
    starts = F.sequence(F.col("block_start"), block_end - 1, F.lit(step).cast("bigint"))
    return (
        blocks.withColumn("start", F.explode(starts))
        .withColumn("end", F.least(F.col("start") + step, F.col(size)))
        .drop("block_start")
    )


def sub_ranges(chunks: DataFrame, read_size: int = DEFAULT_READ) -> DataFrame:
    """A row per read of each chunk, with inclusive ends.

    The last read takes up to one byte more than the read size, instead of leaving one byte to a read of its own.
    """
    length = F.col("end") - F.col("start")
    last = F.greatest(F.ceil((length - 1) / read_size), F.lit(1)) - 1
    read_start = F.col("start") + F.col("read") * read_size
    read_end = F.when(F.col("read") == F.col("last_read"), F.col("end")).otherwise(read_start + read_size)
    return (
        chunks.where(length > 0)
        .withColumn("last_read", last)
        .withColumn("read", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_read"))))
        .withColumns({"read_start": read_start, "read_end": read_end - 1})
        .drop("last_read")
    )


def tasks_for(total: int, per_task: int = 256 * MIB) -> int:
    """Partitions for so much work, such as bytes to copy; beyond `MAX_TASKS` each one gets more of it."""
    return min(MAX_TASKS, max(1, -(-total // per_task)))
