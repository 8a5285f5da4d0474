"""Stored objects: listing, metadata, range reads and writes, as map stages over frames of paths.

Each task opens the file system of the path it is given (local, S3, GCS or HDFS, as Arrow supports them), so paths are
the only thing shuffled; bytes move in pieces of at most `PIECE` through one task.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulbook.operators.ranges import MIB

#: Bytes held at once by a task that moves or hashes an object.
PIECE = MIB
#: Bytes of content after which a task hands on what it has read.
FRAME_BYTES = 8 * MIB
#: Listed entries per emitted frame.
ENTRIES = 10_000

LISTING_DDL = "path string, parent string, is_dir boolean, size bigint"
STAT_DDL = "path string, is_found boolean, size bigint, md5 string, content_type string"

STAT_COLUMNS = ["path", "is_found", "size", "md5", "content_type"]

#: What a file's attribute for its content type is called; stores call it by its header.
TYPE_ATTRIBUTE, TYPE_HEADER = "user.mime_type", "Content-Type"


class WrongContent(ValueError):
    """An object whose content is not the expected one."""


#: Hadoop's names of schemes, and Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs"}

#: Clients of a task, by scheme and authority, and the one for files.
CLIENTS: dict[tuple[str, str], tuple[fs.FileSystem, str]] = {}
LOCAL = fs.LocalFileSystem()


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    """The client for a path and the path as it wants it; a task makes one client per store."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/") and not uri.endswith("/"):
        return LOCAL, uri
    scheme, found, rest = uri.partition("://")
    if not found:
        return fs.FileSystem.from_uri(uri)
    authority, _, path = rest.partition("/")
    key = SCHEMES.get(scheme, scheme), authority
    if key not in CLIENTS:
        files, root = fs.FileSystem.from_uri(f"{key[0]}://{authority}/")
        CLIENTS[key] = files, root.rstrip("/")
    files, root = CLIENTS[key]
    return files, f"{root}/{path}"


def pieces(uri: str, start: int, end: int) -> Iterator[bytes]:
    """The bytes [start, end) of an object, piece by piece; fails if it is shorter."""
    if end <= start:
        return
    files, path = open_path(uri)
    with _Local(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path) as handle:
        while start < end:
            piece = handle.read_at(min(PIECE, end - start), start)
            if not piece:
                raise OSError(f"{uri} ends at byte {start}")
            start += len(piece)
            yield piece


class _Local:
    """A local file to read from, without the calls that a client of stores makes besides."""

    def __init__(self, path: str):
        self.handle = os.open(path, os.O_RDONLY)

    def __enter__(self) -> _Local:
        return self

    def __exit__(self, *_) -> None:
        os.close(self.handle)

    def read_at(self, count: int, start: int) -> bytes:
        return os.pread(self.handle, count, start)


def require_md5(uri: str, found: str, expected: str | None) -> None:
    if expected is not None and found != expected:
        raise WrongContent(f"md5 of {uri} is {found}, expected {expected}")


def set_content_type(path: str, content_type: str | None) -> None:
    """Note the content type of a file, where its file system has attributes."""
    if content_type is not None:
        try:
            os.setxattr(path, TYPE_ATTRIBUTE, content_type.encode())
        except OSError:
            pass


def content_type_of(files: fs.FileSystem, path: str) -> str | None:
    if isinstance(files, fs.LocalFileSystem):
        try:
            return os.getxattr(path, TYPE_ATTRIBUTE).decode()
        except OSError:
            return None
    with files.open_input_stream(path) as handle:
        found = {key.decode().lower(): value.decode() for key, value in (handle.metadata() or {}).items()}
    return found.get(TYPE_HEADER.lower())


def _opened(files: fs.FileSystem, path: str, local: bool, metadata: dict[str, str] | None):
    """A stream to write an object by. Asking for its folder each time would lock the one above; it is made when it is missing."""
    if not local:
        return files.open_output_stream(path, metadata=metadata)
    try:
        return open(path, "wb")
    except FileNotFoundError:
        files.create_dir(os.path.dirname(path), recursive=True)
        return open(path, "wb")


def write_whole(
    uri: str, content: Iterator[bytes], content_type: str | None = None, expected_md5: str | None = None
) -> tuple[int, str]:
    """Write an object so that it appears complete, with the expected content, or not at all; returns its size and md5.

    A store shows an object when it has all of it, so one with other content is there until it is deleted again.
    """
    digest, size = hashlib.md5(), 0

    def hashed() -> Iterator[bytes]:
        nonlocal size
        for piece in content:
            digest.update(piece)
            size += len(piece)
            yield piece

    put_whole(uri, hashed(), content_type, lambda: require_md5(uri, digest.hexdigest(), expected_md5))
    return size, digest.hexdigest()


def put_whole(
    uri: str, content: Iterator[bytes], content_type: str | None = None, check: Callable[[], None] = lambda: None
) -> None:
    """Write an object so that it appears complete or not at all; not if ``check`` fails after its content has passed."""
    files, path = open_path(uri)
    local = isinstance(files, fs.LocalFileSystem)
    written = f"{path}.{uuid.uuid4().hex}.tmp" if local else path
    metadata = {TYPE_HEADER: content_type} if content_type is not None and not local else None
    if local:
        # Content that cannot be read makes no file that would have to go again.
        first = next(content, None)
        content = chain(() if first is None else (first,), content)
    try:
        with _opened(files, written, local, metadata) as handle:
            for piece in content:
                handle.write(piece)
        check()
    except Exception:
        if files.get_file_info(written).type == fs.FileType.File:
            files.delete_file(written)
        raise
    if local:
        set_content_type(written, content_type)
        os.replace(written, path)


def copy_bytes(source: str, target: int, start: int, end: int) -> int:
    """Have the kernel copy the bytes [start, end) of a file into an open one, at the same place; returns the bytes that
    passed through this process instead, where the file systems cannot."""
    _, path = open_path(source)
    handle = os.open(path, os.O_RDONLY)
    moved = 0
    try:
        while start < end:
            try:
                count = os.copy_file_range(handle, target, end - start, start, start)
            except OSError:
                piece = os.pread(handle, min(PIECE, end - start), start)
                count = os.pwrite(target, piece, start)
                moved += count
            if not count:
                raise OSError(f"{source} ends at byte {start}")
            start += count
    finally:
        os.close(handle)
    return moved


def copy_in_store(
    source: str, target: str, content_type: str | None = None, expected_md5: str | None = None
) -> tuple[str | None, int]:
    """Have a store copy an object within itself; returns the md5 of what is there now, read only if one is expected, and
    the bytes that passed through this process."""
    files, path = open_path(target)
    moved, digest = 0, None
    if isinstance(files, fs.LocalFileSystem):
        files.create_dir(os.path.dirname(path), recursive=True)
        written = f"{path}.{uuid.uuid4().hex}.tmp"
        handle = os.open(written, os.O_CREAT | os.O_RDWR)
        try:
            moved = copy_bytes(source, handle, 0, os.stat(open_path(source)[1]).st_size)
        finally:
            os.close(handle)
    else:
        # Stores keep the content type of what they copy.
        files.copy_file(open_path(source)[1], path)
        written = path
    try:
        if expected_md5 is not None:
            running = hashlib.md5()
            for piece in pieces(target if written == path else written, 0, files.get_file_info(written).size):
                running.update(piece)
                moved += len(piece)
            digest = running.hexdigest()
            require_md5(target, digest, expected_md5)
    except Exception:
        files.delete_file(written)
        raise
    if written != path:
        set_content_type(written, content_type)
        files.move(written, path)
    return digest, moved


# --- listing


def list_directories(directories: DataFrame) -> DataFrame:
    """Direct entries of each directory in the column ``path``."""

    def entries(uri: str) -> Iterator[tuple[str, bool, int | None]]:
        files, path = open_path(uri)
        base = uri.rstrip("/")
        if isinstance(files, fs.LocalFileSystem):
            with os.scandir(path) as found:
                for entry in found:
                    is_dir = entry.is_dir()
                    yield f"{base}/{entry.name}", is_dir, None if is_dir else entry.stat().st_size
        else:
            for info in files.get_file_info(fs.FileSelector(path)):
                is_dir = info.type == fs.FileType.Directory
                yield f"{base}/{info.base_name}", is_dir, None if is_dir else info.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "parent", "is_dir", "size"]
        rows = []
        for batch in batches:
            for uri in batch["path"]:
                for path, is_dir, size in entries(uri):
                    rows.append((path, uri, is_dir, size))
                    if len(rows) >= ENTRIES:
                        yield pd.DataFrame(rows, columns=names).astype({"size": "Int64"})
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"size": "Int64"})

    return directories.select("path").mapInPandas(run, LISTING_DDL)


def list_tree(spark: SparkSession, root: str, work_dir: str) -> DataFrame:
    """All entries below a root, level by level: each level is a written table that the next one reads.

    The driver sees one number per level, whether there are directories left to list.
    """
    level = 0
    directories = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    while True:
        folder = f"{work_dir}/level={level}"
        list_directories(directories).write.mode("overwrite").parquet(folder)
        found = spark.read.parquet(folder).where("is_dir").select("path")
        count = found.count()
        if count == 0:
            break
        directories = found.repartition(min(count, 10_000), "path")
        level += 1
    return spark.read.parquet(work_dir).drop("level")


# --- metadata


def stat(paths: DataFrame, with_md5: bool = True, partitions: int | None = None) -> DataFrame:
    """Size, content type and, read piece by piece, md5 of each object in the column ``path``.

    A scan of paths packs millions of them into a task; ``partitions`` spreads them over that many first.
    """
    if partitions is not None:
        paths = repartition_by_bytes(paths, partitions, "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri in batch["path"]:
                files, path = open_path(uri)
                info = files.get_file_info(path)
                if info.type != fs.FileType.File:
                    rows.append((uri, False, None, None, None))
                    continue
                digest = None
                if with_md5:
                    running = hashlib.md5()
                    for piece in pieces(uri, 0, info.size):
                        running.update(piece)
                    digest = running.hexdigest()
                rows.append((uri, True, info.size, digest, content_type_of(files, path)))
            yield pd.DataFrame(rows, columns=STAT_COLUMNS).astype({"size": "Int64"})

    return paths.select("path").mapInPandas(run, STAT_DDL)


# --- bytes


def read_ranges(plan: DataFrame) -> DataFrame:
    """Bytes [start, end) of ``source_path`` as the column ``content``; empty when end is not after start."""
    schema = f"{plan._jdf.schema().toDDL()}, content binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, contents, held = 0, [], 0
            for position, row in enumerate(zip(batch["source_path"], batch["start"], batch["end"])):
                content = b"".join(pieces(*row))
                contents.append(content)
                held += len(content)
                # Frames are bounded by bytes: a batch of ranges would hold all their bytes at once.
                if held >= FRAME_BYTES or position == len(batch) - 1:
                    yield batch.iloc[first : position + 1].assign(content=contents)
                    first, contents, held = position + 1, [], 0

    return plan.mapInPandas(run, schema)


def write_objects(objects: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write each row's ``content`` whole to its ``path``, with its ``content_type`` and ``expected_md5`` if there are such
    columns; returns what was written. Other content than expected fails the job.

    A scan has a task for each row group at most, which may be a million objects; ``partitions`` spreads them first.
    """
    if partitions is not None:
        objects = repartition_by_bytes(objects, partitions, "path")
    extras = [
        F.col(name) if name in objects.columns else F.lit(None).cast("string").alias(name)
        for name in ("content_type", "expected_md5")
    ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri, content, kind, expected in batch.itertuples(index=False):
                rows.append((uri, True, *write_whole(uri, iter([bytes(content)]), kind, expected), kind))
            yield pd.DataFrame(rows, columns=STAT_COLUMNS)

    return objects.select("path", "content", *extras).mapInPandas(run, STAT_DDL)


def delete_objects(paths: DataFrame) -> DataFrame:
    """Delete each object in the column ``path``; false where there was none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri in batch["path"]:
                files, path = open_path(uri)
                is_found = files.get_file_info(path).type == fs.FileType.File
                if is_found:
                    files.delete_file(path)
                rows.append((uri, is_found))
            yield pd.DataFrame(rows, columns=["path", "is_deleted"])

    return paths.select("path").mapInPandas(run, "path string, is_deleted boolean")


def repartition_by_bytes(rows: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Spread rows of bounded bytes evenly, by a hash that a retried task derives again."""
    return rows.repartition(partitions, *[F.col(key) for key in keys])
