"""What to do with each copy request, decided before any byte moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.functions.text import content_type
from haulbook.operators.joins import with_manifests
from haulbook.operators.ranges import DEFAULT_STEP

FAIL_DUPLICATE = "fail_duplicate"
FAIL_MISSING = "fail_missing"
FAIL_NO_SIZE = "fail_no_size"
FAIL_SIZE = "fail_size"
SKIP = "skip"
FAIL_TAKEN = "fail_taken"
ONESHOT = "oneshot"
CHUNKED = "chunked"


def decide(copies: DataFrame, source: DataFrame, target: DataFrame, step: int = DEFAULT_STEP) -> DataFrame:
    """Add ``decision``, ``reason`` and ``delete_target`` to copies between object stores.

    ``copies`` has source_path, target_path, expected_size, expected_md5 and force; the manifests have path, size, md5
    and content_type.
    """
    # Two copies to one target would overwrite each other, so none is made.
    several = copies.groupBy("target_path").agg(F.count("*").alias("n_requests")).where(F.col("n_requests") > 1)
    rows = with_manifests(copies, source, target).join(several, "target_path", "left")
    force = F.coalesce(F.col("force"), F.lit(False))
    same_content = F.coalesce(F.col("target_md5") == F.col("expected_md5"), F.lit(False))
    wrong_size = F.coalesce(F.col("expected_size") != F.col("source_size"), F.lit(False))
    decision = (
        F.when(F.col("n_requests").isNotNull(), FAIL_DUPLICATE)
        .when(~F.col("source_exists"), FAIL_MISSING)
        .when(F.col("source_size").isNull(), FAIL_NO_SIZE)
        .when(wrong_size, FAIL_SIZE)
        .when(same_content & ~force, SKIP)
        .when(F.col("target_exists") & ~force, FAIL_TAKEN)
        .when(F.col("source_size") <= step, ONESHOT)
        .otherwise(CHUNKED)
    )
    rows = rows.withColumn("decision", decision).drop("n_requests")
    return rows.withColumns(
        {
            "reason": _reason(),
            "delete_target": F.col("target_exists") & force & F.col("decision").isin(ONESHOT, CHUNKED),
            "content_type": content_type(F.col("source_type")),
        }
    )


def _reason() -> Column:
    size = F.col("source_size").cast("string")
    taken = F.concat(F.lit("target already exists: "), F.col("target_path"))
    found = F.concat(F.lit(" with md5 "), F.col("target_md5"))
    return (
        F.when(F.col("decision") == FAIL_MISSING, F.concat(F.lit("no such object: "), F.col("source_path")))
        .when(F.col("decision") == FAIL_DUPLICATE, F.concat(F.lit("several copies to "), F.col("target_path")))
        .when(F.col("decision") == FAIL_NO_SIZE, F.concat(F.lit("no size recorded: "), F.col("source_path")))
        .when(
            F.col("decision") == FAIL_SIZE,
            F.concat(F.lit("size is "), size, F.lit(", expected "), F.col("expected_size").cast("string")),
        )
        .when(F.col("decision") == FAIL_TAKEN, F.concat(taken, F.coalesce(found, F.lit(""))))
    )


def decide_unchecked(copies: DataFrame, source: DataFrame, step: int = DEFAULT_STEP) -> DataFrame:
    """The same for sources copied without target checks, such as file servers.

    There an object of exactly one step is already copied in chunks.
    """
    manifest = source.select(F.col("path").alias("source_path"), F.lit(True).alias("found"), "size")
    rows = copies.join(manifest, "source_path", "left").withColumnRenamed("size", "source_size")
    decision = (
        F.when(F.col("found").isNull(), FAIL_MISSING)
        .when(F.col("source_size").isNull(), FAIL_NO_SIZE)
        .when(F.col("source_size") < step, ONESHOT)
        .otherwise(CHUNKED)
    )
    rows = rows.withColumn("decision", decision).drop("found")
    return rows.withColumn(
        "reason",
        F.when(F.col("decision") == FAIL_MISSING, F.concat(F.lit("no such file: "), F.col("source_path"))).when(
            F.col("decision") == FAIL_NO_SIZE, F.concat(F.lit("no size recorded: "), F.col("source_path"))
        ),
    )


def verify(copies: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Compare each target with its source and with what the request expected."""
    rows = with_manifests(copies, source, target)
    same_size = F.col("target_size") == F.coalesce(F.col("expected_size"), F.col("source_size"))
    same_md5 = F.col("target_md5") == F.coalesce(F.col("expected_md5"), F.col("source_md5"))
    verdict = (
        F.when(~F.col("target_exists"), "missing")
        .when(~F.coalesce(same_size, F.lit(False)), "wrong_size")
        .when(~F.coalesce(same_md5, F.lit(False)), "wrong_md5")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict)
