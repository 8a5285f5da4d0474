"""What the operators share: reading tables, settings for Python stages, and stored intermediate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulbook.session import configure, run_dir

#: The gaps between words: space and the control characters from tab to carriage return.
GAPS = r"[\x20\x09-\x0D]+"

#: Python's table for lower-casing A-Z in UTF-8 bytes; no other byte changes.
LOWER = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))

#: Rows handed to Python at once. Texts can be long, so a batch holds few of them whatever the table's size.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, with batches to Python small enough for long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again.

    The files outlive any executor, so what builds on them is never computed twice and its lineage stays short.
    """
    path = run_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, GAPS), "")


def unused(frame: DataFrame, name: str) -> str:
    """A name like this one that no column of the frame has, in any case."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
