"""Directory requests unrolled over a listing (path, parent, is_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.functions.text import child_path


def _bare(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def _placed(matches: DataFrame, columns: list[str]) -> DataFrame:
    """A request per matched entry, with the request's other columns kept."""
    target = child_path(F.col("target_path"), F.col("source_path"), F.col("entry"))
    kept = [name for name in columns if name not in ("source_path", "target_path", "is_directory")]
    return matches.select(
        *kept,
        F.col("entry").alias("source_path"),
        target.alias("target_path"),
        F.col("entry_is_dir").alias("is_directory"),
    )


def expand_directory(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """One level: a request per entry of each requested directory; entries may be directories again."""
    entries = listing.select(
        F.col("path").alias("entry"),
        F.col("is_dir").alias("entry_is_dir"),
        _bare(F.col("parent")).alias("directory"),
    )
    wanted = requests.where("is_directory").withColumn("directory", _bare(F.col("source_path")))
    return _placed(entries.join(wanted, "directory"), requests.columns)


def ancestors(path: Column, depths: list[int]) -> Column:
    """The directories above a path that have one of the given numbers of parts; the root is one empty part."""
    parts = F.split(_bare(path), "/")
    prefixes = [F.when(F.size(parts) > n, F.array_join(F.slice(parts, F.lit(1), F.lit(n)), "/")) for n in depths]
    return F.array_compact(F.array(*prefixes)) if prefixes else F.array().cast("array<string>")


def expand_recursive(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """All levels at once: a request per file below each requested directory.

    Each file looks up its ancestors among the requested directories: one join whatever the depth of the tree, and the
    target path of the last level is the same as expanding level by level. Only depths that were requested are looked
    up, so a file is usually one row in the join.
    """
    wanted = requests.where("is_directory").withColumn("directory", _bare(F.col("source_path")))
    depth = F.size(F.split("directory", "/")).alias("depth")
    depths = sorted(row["depth"] for row in wanted.select(depth).distinct().collect())
    files = listing.where(~F.col("is_dir")).select(F.col("path").alias("entry"), F.col("is_dir").alias("entry_is_dir"))
    below = files.withColumn("directory", F.explode(ancestors(F.col("entry"), depths)))
    return _placed(below.join(wanted, "directory"), requests.columns)
