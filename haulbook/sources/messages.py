"""Message topics: JSON envelopes ``{"ids": {request, transfer}, "message": M}`` with the order they arrived in.

A topic is read from Kafka, or from a folder of parquet files with the columns ``value`` and ``arrival``. The message M
is a payload on the request topic, ``[step, info]`` on the progress topic and ``[signal, info]`` on the result topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulbook.functions.json import as_tuple, tuple_item, tuple_json
from haulbook.schemas import ENVELOPE_DDL

RECORDS = T.StructType([T.StructField("value", T.StringType()), T.StructField("arrival", T.LongType())])

#: The trigger that bounds a batch's wait, unless configured otherwise.
MAX_WAIT = "1 second"


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_records: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A Kafka topic from its start; needs Spark's Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**(options or {}))
    )
    if max_records is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_records)
    arrival = kafka_arrival(F.col("timestamp"), F.col("partition"), F.col("offset"))
    return reader.load().select(F.col("value").cast("string").alias("value"), arrival.alias("arrival"))


def kafka_arrival(timestamp: Column, partition: Column, offset: Column) -> Column:
    """A record's place among all of its topic: by time, then partition and offset, which also tell it from any other.

    Offsets of different partitions do not compare, so alone they give neither an order nor an identity. The number has
    the milliseconds, five digits of the partition and nineteen of the offset.
    """
    millis = F.lpad(F.unix_millis(timestamp).cast("string"), 13, "0")
    digits = F.concat(millis, F.lpad(partition.cast("string"), 5, "0"), F.lpad(offset.cast("string"), 19, "0"))
    return digits.cast("decimal(38,0)")


def folder_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A topic kept in files, from its start."""
    reader = spark.readStream.schema(RECORDS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECORDS).parquet(folder)


def write_folder(records: DataFrame, folder: str, mode: str = "append") -> None:
    """Append records to a topic kept in files."""
    records.select("value", "arrival").write.mode(mode).parquet(folder)


def write_kafka(records: DataFrame, servers: str, topic: str, options: dict[str, str] | None = None) -> None:
    """Send records and wait until they are acknowledged; the connector's producer is idempotent and retries.

    A transfer's records have its id as key, so that they keep their order within one partition.
    """
    (
        records.select(F.get_json_object("value", "$.ids.transfer").alias("key"), "value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .options(**(options or {}))
        .save()
    )


def envelope(request_id: Column, transfer_id: Column, message: Column) -> Column:
    """Envelope around a message given as JSON text."""
    ids = F.to_json(F.struct(request_id.alias("request"), transfer_id.alias("transfer")))
    return F.concat(F.lit('{"ids":'), ids, F.lit(',"message":'), message, F.lit("}"))


def encode_requests(transfers: DataFrame, arrival: Column) -> DataFrame:
    """Records for the request topic from ledger rows."""
    value = envelope(F.col("request_id"), F.col("id"), F.col("body"))
    return transfers.select(value.alias("value"), arrival.alias("arrival"))


def encode_progress(progress: DataFrame) -> DataFrame:
    message = as_tuple(F.col("step"), F.col("info"))
    return progress.select(
        envelope(F.col("request_id"), F.col("transfer_id"), message).alias("value"), F.col("arrival")
    )


def encode_results(results: DataFrame) -> DataFrame:
    message = as_tuple(F.col("signal"), F.col("info"))
    return results.select(
        envelope(F.col("request_id"), F.col("transfer_id"), message).alias("value"), F.col("arrival")
    )


def decode(records: DataFrame, strict: bool = True) -> DataFrame:
    """Open envelopes: request_id, transfer_id, message, arrival.

    ``strict`` fails the job on a malformed record. Otherwise such a record keeps its text in ``corrupt`` and has nulls
    elsewhere, for `quarantined` and `sound` to tell apart.
    """
    # Lenient parsing fills in the fields it got to; the corrupt column tells that it did not get to the end.
    ddl = ENVELOPE_DDL if strict else f"{ENVELOPE_DDL}, corrupt string"
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    rows = records.select("value", "arrival", F.from_json("value", ddl, options).alias("record"))
    request, transfer, message = F.col("record.ids.request"), F.col("record.ids.transfer"), F.col("record.message")
    broken = request.isNull() | transfer.isNull() | message.isNull()
    if strict:
        # Parsed JSON may still lack a field.
        failure = F.raise_error(F.concat(F.lit("malformed envelope: "), F.col("value"))).cast("string")
        request = F.when(broken, failure).otherwise(request)
        return rows.select(
            request.alias("request_id"), transfer.alias("transfer_id"), message.alias("message"), "arrival"
        )
    broken = broken | F.col("record.corrupt").isNotNull()
    return rows.select(
        F.when(~broken, request).alias("request_id"),
        F.when(~broken, transfer).alias("transfer_id"),
        F.when(~broken, message).alias("message"),
        "arrival",
        F.when(broken, F.col("value")).alias("corrupt"),
    )


def sound(decoded: DataFrame) -> DataFrame:
    return decoded.where("corrupt IS NULL").drop("corrupt")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.where("corrupt IS NOT NULL").select("arrival", "corrupt")


def as_requests(decoded: DataFrame) -> DataFrame:
    return decoded.select("request_id", "transfer_id", F.to_json("message").alias("body"), "arrival")


def as_progress(decoded: DataFrame) -> DataFrame:
    message = F.col("message")
    return decoded.select(
        "request_id",
        "transfer_id",
        tuple_item(message, 0, "int").alias("step"),
        tuple_json(message, 1).alias("info"),
        "arrival",
    )


def as_results(decoded: DataFrame) -> DataFrame:
    message = F.col("message")
    return decoded.select(
        "request_id",
        "transfer_id",
        tuple_item(message, 0, "string").alias("signal"),
        tuple_json(message, 1).alias("info"),
        "arrival",
    )
