"""The ledger: requests and transfers as Parquet that one streaming query writes and anybody reads.

Parquet has no in-place update, so a transition appends the new images of the rows it changed. The only writer is a Structured
Streaming query (`haulbook.streaming.listen`); its checkpoint numbers the batches, keeps their order and says which of them are
committed. An append is named by its batch and by its stage within the batch, so a batch that is processed again
overwrites its own folders, and reads the state before itself while doing so. Nothing else orders, locks or removes anything.

Every ``every`` batches the state is folded into a snapshot, bucketed by id, so that joins by id need not shuffle it, and
partitioned by whether a transfer has ended, so that admission leaves the ended part unread. Appends lie in a folder of the
snapshot that they follow: readers list the folders since the last snapshot and no others. Snapshots before the last two, and
the appends after them, are read by nobody; a lifecycle rule of the store may remove them.

The current state is the snapshot without the ids changed since, plus their latest images. Both stay separate branches of a
union, so filters and column pruning reach the Parquet scan of the snapshot.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulbook.schemas import ENDED, REQUESTS, TRANSFERS

#: Batches from one snapshot to the next, so that reads stay proportional to the ledger; bytes of a snapshot's bucket.
SNAPSHOT_EVERY, BUCKET_BYTES = 32, 256 << 20

#: The stage of an append that is its batch's only one, and of what ends a batch.
LAST_STAGE = 9

#: Tables, and what their snapshots are partitioned by.
TABLES = {"requests": (REQUESTS, []), "transfers": (TRANSFERS, ["ended"])}


class Ledger:
    """Requests and transfers under one root folder.

    Without ``buckets`` their number follows the snapshot's size. ``every`` is the ledger's own and never changes.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, every: int = SNAPSHOT_EVERY):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.every = every

    @property
    def checkpoint(self) -> str:
        """Where the writing query keeps its checkpoint."""
        return f"{self.root}/checkpoint"

    # --- reading

    def transfers(self, before: int | None = None, stage: int = 0) -> DataFrame:
        """Committed transfers, or those before a batch (and a stage of it)."""
        return reduce(DataFrame.unionByName, self.parts(before, stage))

    def open_transfers(self, before: int | None = None, stage: int = 0) -> DataFrame:
        """The same without those that have ended; of a snapshot only the open part is read."""
        return reduce(DataFrame.unionByName, self._state("transfers", before, stage, open_only=True))

    def parts(self, before: int | None = None, stage: int = 0) -> list[DataFrame]:
        """All transfers as disjoint parts: first the snapshot, then what changed since.

        A union forgets how its branches are bucketed, so a join by id that is done per part spares the snapshot a shuffle.
        """
        return self._state("transfers", before, stage)

    def requests(self, before: int | None = None, stage: int = 0) -> DataFrame:
        """All requests; they are never changed."""
        return reduce(DataFrame.unionByName, self._state("requests", before, stage))

    def changes(self, batch: int, stage: int = LAST_STAGE) -> DataFrame:
        """The transfer images one append wrote."""
        return self.spark.read.schema(TRANSFERS).parquet(self._append("transfers", batch, stage))

    def next_batch(self) -> int:
        """The batch after the last that the writing query has committed."""
        names = (name for name, _ in sub_folders(self.spark, f"{self.checkpoint}/commits"))
        return max((int(name) for name in names if name.isdigit()), default=-1) + 1

    def _state(self, table: str, before: int | None, stage: int, open_only: bool = False) -> list[DataFrame]:
        if before is None:
            before = self.next_batch()
        schema, _ = TABLES[table]
        base = self._base(table, before)
        rows = self._snapshot(table, base) if base is not None else self.spark.createDataFrame([], schema)
        if open_only and base is not None:
            rows = rows.where("NOT ended")
        rows = rows.select(*schema.fieldNames())
        changed = self._latest(table, base or 0, before, stage)
        if changed is None:
            return [rows]
        if open_only:
            # Images of any state hide the snapshot's row.
            return [rows.join(changed.select("id"), "id", "left_anti"), changed.where(~F.col("status").isin(*ENDED))]
        return [rows.join(changed.select("id"), "id", "left_anti"), changed]

    def _base(self, table: str, before: int) -> int | None:
        """The last finished snapshot of the state before a batch up to this one."""
        for number in range(before - before % self.every, -1, -self.every):
            if finished_folders(self.spark, self._snapshot_path(table, number)):
                return number
        return None

    def _latest(self, table: str, base: int, before: int, stage: int) -> DataFrame | None:
        """The last image per id since a snapshot."""
        schema, _ = TABLES[table]
        folders = [self._segment(table, start) for start in range(base, before + 1, self.every)]
        kept = (F.col("batch") < before) | ((F.col("batch") == before) & (F.col("stage") < stage))
        # Named, as a folder in which nothing was finished has no partitions to tell them by.
        named = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("stage", T.IntegerType())])
        frames = [
            self.spark.read.schema(named).option("basePath", folder).parquet(folder).where(kept)
            for folder in folders
            if exists(self.spark, folder)
        ]
        if not frames:
            return None
        images = reduce(DataFrame.unionByName, frames)
        # The id stays the column that was grouped by, so that joins by it need no second shuffle.
        others = [name for name in schema.fieldNames() if name != "id"]
        image = F.max_by(F.struct(*others), F.struct("batch", "stage")).alias("image")
        return images.groupBy("id").agg(image).select("id", "image.*")

    def _snapshot(self, table: str, number: int) -> DataFrame:
        schema, keys = TABLES[table]
        # The folder's name says how many buckets it has; none if it was loaded without a number.
        (folder, path), *_ = finished_folders(self.spark, self._snapshot_path(table, number))
        buckets = int(folder.split("=")[1])
        fields = [*schema.fields, *(T.StructField(key, T.BooleanType()) for key in keys)]
        if not buckets:
            return self.spark.read.schema(T.StructType(fields)).parquet(path)
        name = self._table_name(table, number)
        if not self.spark.catalog.tableExists(name):
            # The files outlive the session that wrote them; the catalog entry may not.
            columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)
            parted = f"PARTITIONED BY ({', '.join(keys)})" if keys else ""
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet {parted} "
                f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
            if keys:
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return self.spark.table(name)

    # --- writing

    def load(self, transfers: DataFrame | None = None, requests: DataFrame | None = None) -> None:
        """What a ledger starts with, before its first batch."""
        for table, rows in (("requests", requests), ("transfers", transfers)):
            if rows is not None:
                self._fold(table, _typed(table, rows), 0, self.buckets or 0)

    def append(
        self, batch: int, stage: int = LAST_STAGE, transfers: DataFrame | None = None, requests: DataFrame | None = None
    ) -> None:
        """Write the images that a stage of a batch changed, in place of what the same stage wrote before.

        Requests come first, so that no transfer is ever without its request.
        """
        for table, rows in (("requests", requests), ("transfers", transfers)):
            if rows is not None:
                _typed(table, rows).write.mode("overwrite").parquet(self._append(table, batch, stage))

    def fold_if_due(self, batch: int) -> None:
        """At the start of a batch, fold the state before it into a snapshot if it is time for one."""
        if batch > 0 and batch % self.every == 0:
            for table in TABLES:
                if self._base(table, batch) != batch:
                    rows = reduce(DataFrame.unionByName, self._state(table, batch, 0))
                    self._fold(table, rows, batch, self.buckets or self._buckets_for(table, batch))

    def _fold(self, table: str, rows: DataFrame, number: int, buckets: int) -> None:
        _, keys = TABLES[table]
        path, name = f"{self._snapshot_path(table, number)}/buckets={buckets}", self._table_name(table, number)
        if keys:
            rows = rows.withColumn("ended", F.col("status").isin(*ENDED))
        if not buckets:
            rows.write.mode("overwrite").partitionBy(*keys).parquet(path)
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        (
            # A task then writes one bucket, not a file in each.
            rows.repartition(buckets, "id")
            .write.mode("overwrite")
            .format("parquet")
            .partitionBy(*keys)
            .bucketBy(buckets, "id")
            .sortBy("id")
            # Sorted files and a filter per row group let lookups by id skip what they do not need.
            .option("parquet.bloom.filter.enabled#id", "true")
            .option("path", path)
            .saveAsTable(name)
        )

    # --- folders

    def _segment(self, table: str, start: int) -> str:
        return f"{self.root}/{table}/after={start}"

    def _append(self, table: str, batch: int, stage: int) -> str:
        return f"{self._segment(table, batch - batch % self.every)}/batch={batch}/stage={stage}"

    def _snapshot_path(self, table: str, number: int) -> str:
        return f"{self.root}/{table}/snapshot/before={number}"

    def _table_name(self, table: str, number: int) -> str:
        key = hashlib.md5(self.root.encode()).hexdigest()[:12]
        return f"haulbook_{table}_{key}_{number}"

    def _buckets_for(self, table: str, before: int) -> int:
        base = self._base(table, before) or 0
        folders = [self._snapshot_path(table, base)] + [self._segment(table, at) for at in range(base, before, self.every)]
        sizes = (size_of(self.spark, folder) for folder in folders if exists(self.spark, folder))
        return max(1, -(-sum(sizes) // BUCKET_BYTES))


def _typed(table: str, rows: DataFrame) -> DataFrame:
    schema, _ = TABLES[table]
    return rows.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema.fields])


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    files, path = _files(spark, path)
    return files.exists(path)


def size_of(spark: SparkSession, path: str) -> int:
    files, path = _files(spark, path)
    return files.getContentSummary(path).getLength()


def sub_folders(spark: SparkSession, parent: str) -> list[tuple[str, str]]:
    """Name and path of what is in a folder."""
    files, path = _files(spark, parent)
    if not files.exists(path):
        return []
    return [(status.getPath().getName(), status.getPath().toString()) for status in files.listStatus(path)]


def finished_folders(spark: SparkSession, parent: str) -> list[tuple[str, str]]:
    """Name and path of the sub-folders that a finished Spark write left its marker in."""
    return [(name, path) for name, path in sub_folders(spark, parent) if exists(spark, f"{path}/_SUCCESS")]
