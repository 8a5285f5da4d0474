"""Paths, URLs, failure texts and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the region whose endpoint carries no region name.
DEFAULT_REGION = "us-east-1"
# Fixed value: content type of objects that do not report one.
DEFAULT_CONTENT_TYPE = "application/octet-stream"


def encode_segment(segment: Column) -> Column:
    """Percent-encode (UTF-8) all but ``A-Za-z0-9_-~.``."""
    encoded = F.url_encode(segment)
    # Form encoding differs from path encoding in exactly these three.
    encoded = F.replace(encoded, F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def encode_path(path: Column) -> Column:
    return F.concat_ws("/", F.transform(F.split(path, "/"), encode_segment))


def object_url(bucket: Column, region: Column, path: Column) -> Column:
    """REST endpoint of an object."""
    host = F.when(region == DEFAULT_REGION, F.lit("s3")).otherwise(F.concat(F.lit("s3-"), region))
    return F.concat(F.lit("https://"), bucket, F.lit("."), host, F.lit(".amazonaws.com/"), encode_path(path))


def child_path(target: Column, parent: Column, path: Column) -> Column:
    """Where an entry of a requested directory goes: the target plus the path below the directory."""
    return F.concat(target, F.substr(path, F.length(parent) + 1))


def content_type(reported: Column) -> Column:
    return F.coalesce(reported, F.lit(DEFAULT_CONTENT_TYPE))


def failure_info(description: Column, message: Column, cause: Column) -> Column:
    """JSON ``{message, detail}`` of a failure; both the error text and its cause may be null."""
    text = F.concat(description, F.coalesce(F.concat(F.lit(": "), message), F.lit("")))
    return F.to_json(
        F.struct(text.alias("message"), cause.alias("detail")), {"ignoreNullFields": "false"}
    )


def millis_to_timestamp(millis: Column) -> Column:
    """Epoch milliseconds as a UTC wall-clock time, whatever the session's zone."""
    return F.timestamp_add(
        "MICROSECOND", millis.cast("bigint") * 1000, F.lit("1970-01-01").cast("timestamp_ntz")
    )
