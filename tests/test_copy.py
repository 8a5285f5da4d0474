import hashlib
import os

import pytest
from pyspark.sql import functions as F

from haulbook.functions import text
from haulbook.operators import directories, preflight, ranges
from haulbook.plans.copy import FINISH_DDL, OUTCOME_DDL, CopyJob, Mover, progress_records, resumed_from
from haulbook.sources import messages, objects

MANIFEST = "path string, size bigint, md5 string, content_type string"
COPIES = "source_path string, target_path string, expected_size bigint, expected_md5 string, force boolean"


def decisions(spark, copies, source, target, step=10):
    rows = preflight.decide(
        spark.createDataFrame(copies, COPIES),
        spark.createDataFrame(source, MANIFEST),
        spark.createDataFrame(target, MANIFEST),
        step,
    )
    return {row.source_path: row for row in rows.collect()}


def test_decisions_in_order(spark):
    copies = [
        ("missing", "t1", None, None, False),
        ("sizeless", "t2", None, None, False),
        ("resized", "t3", 6, None, True),
        ("same", "t4", 5, "m", None),
        ("same-no-md5", "t5", None, None, None),
        ("taken", "t6", None, "other", False),
        ("forced", "t7", None, "m", True),
        ("edge", "t8", 10, "m", None),
        ("large", "t9", 11, "m", None),
    ]
    source = [(name, 5, "m", None) for name in ("resized", "same", "same-no-md5", "taken", "forced")]
    source += [("sizeless", None, None, None), ("edge", 10, "m", None), ("large", 11, "m", "text/plain")]
    target = [("t4", 5, "m", None), ("t5", 5, None, None), ("t6", 5, "m", None), ("t7", 5, "m", None)]
    found = decisions(spark, copies, source, target)
    assert {name: row.decision for name, row in found.items()} == {
        "missing": "fail_missing",
        "sizeless": "fail_no_size",
        "resized": "fail_size",
        "same": "skip",
        "same-no-md5": "fail_taken",
        "taken": "fail_taken",
        "forced": "oneshot",
        "edge": "oneshot",
        "large": "chunked",
    }
    assert found["resized"].reason == "size is 5, expected 6"
    assert found["taken"].reason == "target already exists: t6 with md5 m"
    assert found["same-no-md5"].reason == "target already exists: t5"
    assert [name for name, row in found.items() if row.delete_target] == ["forced"]
    assert (found["edge"].content_type, found["large"].content_type) == ("application/octet-stream", "text/plain")


def test_file_server_copies_one_step_in_chunks(spark):
    copies = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "source_path string, target_path string")
    source = spark.createDataFrame([("a", 9), ("b", 10)], "path string, size bigint")
    found = {row.source_path: row.decision for row in preflight.decide_unchecked(copies, source, 10).collect()}
    assert found == {"a": "oneshot", "b": "chunked", "c": "fail_missing"}


@pytest.mark.parametrize("per_block", [2, ranges.CHUNKS_PER_BLOCK])
def test_byte_ranges_cover_each_object_once(spark, monkeypatch, per_block):
    monkeypatch.setattr(ranges, "CHUNKS_PER_BLOCK", per_block)
    sizes = [0, 1, 9, 10, 11, 20, 45]
    rows = ranges.byte_ranges(spark.createDataFrame([(size,) for size in sizes], "size bigint"), 10).collect()
    for size in sizes:
        found = sorted((row.start, row.end) for row in rows if row.size == size)
        assert found == [(start, min(start + 10, size)) for start in range(0, size, 10)]


def sub_reads(start, end, read_size):
    """Read after read, as a loop."""
    while True:
        if end - start - 1 <= read_size:
            yield start, end - 1
            return
        yield start, start + read_size - 1
        start += read_size


def test_sub_ranges_against_a_loop(spark):
    chunks = [(start, start + length) for start in (0, 7003) for length in range(1, 40)]
    rows = ranges.sub_ranges(spark.createDataFrame(chunks, "start bigint, end bigint"), 8).collect()
    for start, end in chunks:
        found = sorted((row.read_start, row.read_end) for row in rows if (row.start, row.end) == (start, end))
        assert found == list(sub_reads(start, end, 8))


def test_one_level_of_a_directory(spark):
    listing = [("in/2024/may/" + name, "in/2024/may", name.endswith("/")) for name in ("a.csv", "raw/", "b c.txt")]
    requests = spark.createDataFrame(
        [("in/2024/may", "out/spring", True)],
        "source_path string, target_path string, is_directory boolean",
    )
    found = directories.expand_directory(
        requests, spark.createDataFrame(listing, "path string, parent string, is_dir boolean")
    )
    assert {tuple(row) for row in found.collect()} == {
        ("in/2024/may/a.csv", "out/spring/a.csv", False),
        ("in/2024/may/raw/", "out/spring/raw/", True),
        ("in/2024/may/b c.txt", "out/spring/b c.txt", False),
    }


def test_all_levels_equal_level_by_level(spark):
    listing = spark.createDataFrame(
        [("/r/a", "/r", True), ("/r/a/b", "/r/a", True), ("/r/a/b/f", "/r/a/b", False), ("/r/g", "/r", False)],
        "path string, parent string, is_dir boolean",
    )
    requests = spark.createDataFrame(
        [("/r", "T", True), ("/r/a", "U/", True)], "source_path string, target_path string, is_directory boolean"
    )
    files, level = set(), requests
    while level.count():
        entries = directories.expand_directory(level, listing)
        files |= {tuple(row) for row in entries.where("NOT is_directory").collect()}
        level = entries.where("is_directory")
    assert {tuple(row) for row in directories.expand_recursive(requests, listing).collect()} == files


def test_object_url(spark):
    path = "scans/page*7*/lang=nl/(draft)"
    encoded = "scans/page%2A7%2A/lang%3Dnl/%28draft%29"
    row = spark.createDataFrame([(path,)], "p string").select(
        text.object_url(F.lit("b"), F.lit("us-east-1"), F.col("p")).alias("default"),
        text.object_url(F.lit("b"), F.lit("us-west-2"), F.col("p")).alias("other"),
        text.encode_path(F.lit("a b~c_d-e.f/é")).alias("rest"),
    )
    assert row.first().default == f"https://b.s3.amazonaws.com/{encoded}"
    assert row.first().other == f"https://b.s3-us-west-2.amazonaws.com/{encoded}"
    assert row.first().rest == "a%20b~c_d-e.f/%C3%A9"


def test_two_copies_to_one_target_are_both_refused(spark):
    copies = spark.createDataFrame(
        [("/a", "/t", None, None, False), ("/b", "/t", None, None, True), ("/a", "/u", None, None, False)],
        "source_path string, target_path string, expected_size bigint, expected_md5 string, force boolean",
    )
    manifest = "path string, size bigint, md5 string, content_type string"
    source = spark.createDataFrame([("/a", 1, "x", None), ("/b", 2, "y", None)], manifest)
    found = preflight.decide(copies, source, source.limit(0)).select("source_path", "target_path", "decision", "reason")
    assert sorted(map(tuple, found.collect())) == [
        ("/a", "/t", preflight.FAIL_DUPLICATE, "several copies to /t"),
        ("/a", "/u", preflight.ONESHOT, None),
        ("/b", "/t", preflight.FAIL_DUPLICATE, "several copies to /t"),
    ]


def test_clients_are_made_once_per_store(monkeypatch):
    made = []

    class Stores:
        class FileSystem:
            @staticmethod
            def from_uri(uri):
                made.append(uri)
                return object(), uri.split("://")[1]

    monkeypatch.setattr(objects, "fs", Stores)
    monkeypatch.setattr(objects, "CLIENTS", {})
    first, path = objects.open_path("s3a://store/a/b")
    assert path == "store/a/b" and objects.open_path("s3://store/c") == (first, "store/c")
    assert made == ["s3://store/"]


# --- real files


@pytest.fixture
def files(spark, tmp_path):
    """Sources of 0 to 100,000 bytes, as (name, content), and copy requests for them."""
    contents = {f"d{n}/f{size}": os.urandom(size) for n, size in enumerate((0, 1, 31, 32, 33, 64, 1000, 100_000))}
    for name, content in contents.items():
        path = tmp_path / "from" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    rows = [(f"{tmp_path}/from/{name}", f"{tmp_path}/to/{name}") for name in contents]
    return contents, spark.createDataFrame(rows, "source_path string, target_path string")


def decided(spark, requests, step):
    source = objects.stat(requests.select(F.col("source_path").alias("path")))
    return preflight.decide_unchecked(requests, source.where("is_found").select("path", "size"), step)


@pytest.mark.parametrize("shared,rewrite", [(False, False), (True, False), (False, True), (True, True)])
def test_copies_are_equal(spark, files, tmp_path, shared, rewrite):
    contents, requests = files
    job = CopyJob(spark, f"{tmp_path}/job", step=32, shared_target=shared, rewrite=rewrite)
    report = job.run(decided(spark, requests, 32)).collect()
    assert {row.state for row in report} == {"copied"}
    for name, content in contents.items():
        assert (tmp_path / "to" / name).read_bytes() == content
    large = next(row for row in report if row.source_path.endswith("f100000"))
    steps = 1 if rewrite and not shared else 3125
    assert (large.decision, large.steps, large.bytes_uploaded, large.total_bytes) == ("chunked", steps, 100000, 100000)
    # What the store copies by itself never passes through a task.
    assert {row.bytes_through_tasks for row in report} == ({0} if rewrite else {row.total_bytes for row in report})
    assert job.verify_chunks().count() == 0
    assert not list((tmp_path / "to").rglob("*.unfinished"))


@pytest.mark.parametrize("shared,rewrite", [(False, False), (True, False), (False, True), (True, True)])
def test_wrong_content_fails_and_leaves_nothing(spark, files, tmp_path, shared, rewrite):
    contents, requests = files
    right = {name: hashlib.md5(content).hexdigest() for name, content in contents.items()}
    expected = [(f"{tmp_path}/from/{name}", "0" * 32 if name[-3:] in ("f33", "000") else right[name]) for name in contents]
    expected = spark.createDataFrame(expected, "source_path string, expected_md5 string")
    job = CopyJob(spark, f"{tmp_path}/job", step=32, shared_target=shared, rewrite=rewrite, max_delay=0)
    report = {row.source_path.rsplit("/", 1)[1]: row for row in job.run(decided(spark, requests, 32).join(expected, "source_path")).collect()}
    wrong = {"f33", "f1000", "f100000"}
    assert {name for name, row in report.items() if row.state == "failed"} == wrong
    assert all(f"is {right[row.target_path[len(str(tmp_path)) + 4:]]}, expected 000" in report[name].error for name, row in report.items() if name in wrong)
    assert {path.name for path in (tmp_path / "to").rglob("f*") if path.is_file() and "unfinished" not in str(path)} == set(report) - wrong
    # Trying again would not help.
    assert job.outcomes().groupBy("target_path", "start").count().where("count > 1").count() == 0


def test_content_types_are_kept(spark, files, tmp_path):
    _, requests = files
    probe = tmp_path / "probe"
    probe.write_bytes(b"")
    objects.set_content_type(str(probe), "text/x")
    if objects.content_type_of(*objects.open_path(str(probe))) is None:
        pytest.skip("no attributes on this file system")
    rows = decided(spark, requests, 32).withColumn("content_type", F.lit("text/csv"))
    for number, options in enumerate(({}, {"shared_target": True}, {"rewrite": True})):
        moved = rows.withColumn("target_path", F.concat("target_path", F.lit(f".{number}")))
        CopyJob(spark, f"{tmp_path}/job{number}", step=32, **options).run(moved)
        assert {row.content_type for row in objects.stat(moved.select(F.col("target_path").alias("path"))).collect()} == {"text/csv"}


def test_chunks_damaged_in_place_are_copied_again(spark, files, tmp_path):
    contents, requests = files
    job = CopyJob(spark, f"{tmp_path}/job", step=32, shared_target=True)
    job.write_plan(decided(spark, requests, 32))
    assert job.attempt() == 0
    path = tmp_path / "to/d7/f100000.unfinished"
    data = bytearray(path.read_bytes())
    data[64:96] = bytes(32)
    path.write_bytes(data)
    assert job.check_in_place() == 1
    assert job.finish() == 0 and not (tmp_path / "to/d7/f100000").exists() and (tmp_path / "to/d6/f1000").exists()
    assert {row.state for row in job.run(decided(spark, requests, 32)).collect()} == {"copied"}
    assert (tmp_path / "to/d7/f100000").read_bytes() == contents["d7/f100000"]


@pytest.mark.parametrize("shared", [False, True])
def test_resumes_from_a_progress_message_alone(spark, files, tmp_path, shared):
    contents, requests = files
    rows = decided(spark, requests, 32).withColumns({"request_id": F.lit("R"), "transfer_id": F.element_at(F.split("source_path", "/"), -1)})
    source = tmp_path / "from/d7/f100000"
    whole = source.read_bytes()
    source.write_bytes(whole[:50_000])
    plan = rows.withColumn("source_size", F.when(F.col("transfer_id") == "f100000", 100_000).otherwise(F.col("source_size")))
    first = CopyJob(spark, f"{tmp_path}/first", step=32, shared_target=shared, max_retries=0, outbox=f"{tmp_path}/topic", bytes_per_report=30_000)
    first.run(plan)
    progress = messages.as_progress(messages.decode(messages.read_folder(spark, f"{tmp_path}/topic/*")))
    assert progress.where("transfer_id = 'f100000'").count() > 1
    resumed = resumed_from(progress)
    found = {row.target_path.rsplit("/", 1)[1]: row.ranges for row in resumed.collect()}
    assert [tuple(one) for one in found["f100000"]] == [(0, 50_000 // 32 * 32)]
    source.write_bytes(whole)
    second = CopyJob(spark, f"{tmp_path}/second", step=32, shared_target=shared)
    assert {row.state for row in second.run(plan, resumed.where("target_path LIKE '%f100000'")).collect()} == {"copied"}
    assert (tmp_path / "to/d7/f100000").read_bytes() == whole
    again = second.outcomes().where("target_path LIKE '%f100000' AND moved > 0")
    assert again.agg(F.sum("moved"), F.min("start")).first() == (100_000 - 50_000 // 32 * 32, 50_000 // 32 * 32)
    # Ranges whose bytes are not there count for nothing.
    gone = CopyJob(spark, f"{tmp_path}/third", step=32, shared_target=shared)
    elsewhere = plan.withColumn("target_path", F.concat("target_path", F.lit(".b")))
    nowhere = resumed.withColumn("target_path", F.concat("target_path", F.lit(".b")))
    assert {row.state for row in gone.run(elsewhere, nowhere).collect()} == {"copied"}
    assert (tmp_path / "to/d7/f100000.b").read_bytes() == whole


def test_messages_without_ranges_say_how_far_a_copy_came(spark):
    rows = [("R", "t", 1, '{"targetPath":"d","bytesUploaded":5}', 1), ("R", "t", 2, '{"targetPath":"d","bytesUploaded":8}', 2)]
    rows += [("R", "u", 1, '{"targetPath":"e","bytesUploaded":9,"ranges":[{"start":4,"end":6},{"start":9,"end":16}]}', 1)]
    progress = spark.createDataFrame(rows, "request_id string, transfer_id string, step int, info string, arrival bigint")
    found = {row.target_path: [tuple(one) for one in row.ranges] for row in resumed_from(progress).collect()}
    assert found == {"d": [(0, 8)], "e": [(4, 6), (9, 16)]}


def test_damage_is_found(spark, files, tmp_path):
    _, requests = files
    job = CopyJob(spark, f"{tmp_path}/job", step=32)
    job.run(decided(spark, requests, 32))
    path = tmp_path / "to/d7/f100000"
    data = bytearray(path.read_bytes())
    data[70] ^= 1
    path.write_bytes(data)
    assert [(row.start, row.end) for row in job.verify_chunks().collect()] == [(64, 96)]


def test_resumes_with_what_is_left(spark, files, tmp_path):
    contents, requests = files
    rows = decided(spark, requests, 32)
    hidden = tmp_path / "from/d7/f100000"
    kept = hidden.read_bytes()
    hidden.write_bytes(kept[:40_000])  # the rest of the object cannot be read yet
    job = CopyJob(spark, f"{tmp_path}/job", step=32, max_retries=0)
    plan = rows.withColumn("source_size", F.when(F.col("source_path").endswith("f100000"), 100_000).otherwise(
        F.col("source_size")))
    states = {row.source_path[-7:]: row for row in job.run(plan).collect()}
    assert states["f100000"].state == "failed" and states["f100000"].bytes_uploaded == 40_000
    assert not (tmp_path / "to/d7/f100000").exists()
    hidden.write_bytes(kept)
    again = CopyJob(spark, f"{tmp_path}/job", step=32, max_retries=0)
    assert {row.state for row in again.run(plan).collect()} == {"copied"}
    assert (tmp_path / "to/d7/f100000").read_bytes() == kept
    second = spark.read.parquet(f"{tmp_path}/job/attempts/attempt=1")
    assert second.count() == (100_000 - 40_000) // 32
    assert len(contents) == 8


def test_failure_of_one_object_spares_the_others(spark, files, tmp_path):
    _, requests = files
    plan = decided(spark, requests, 32).persist()
    plan.count()
    (tmp_path / "from/d2/f31").unlink()
    job = CopyJob(spark, f"{tmp_path}/job", step=32, max_retries=1, max_delay=0)
    report = {row.source_path.rsplit("/", 1)[1]: row for row in job.run(plan).collect()}
    assert report["f31"].state == "failed" and "f31" in report["f31"].error
    assert {row.state for name, row in report.items() if name != "f31"} == {"copied"}
    assert job.outcomes().where("source_path LIKE '%f31'").count() == 2


def test_forced_targets_are_deleted_first(spark, tmp_path):
    for folder, content in (("from", b"new"), ("to", b"old and longer")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f").write_bytes(content)
    copies = spark.createDataFrame([(f"{tmp_path}/from/f", f"{tmp_path}/to/f", None, None, True)], COPIES)

    def manifest(column):
        found = objects.stat(copies.select(F.col(column).alias("path"))).where("is_found")
        return found.select("path", "size", "md5", F.lit(None).cast("string").alias("content_type"))

    job = CopyJob(spark, f"{tmp_path}/job")
    job.run(preflight.decide(copies, manifest("source_path"), manifest("target_path")))
    assert (tmp_path / "to/f").read_bytes() == b"new"
    assert spark.read.parquet(f"{tmp_path}/job/deleted").first().is_deleted


def test_range_reads(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(bytes(range(100)))
    plan = spark.createDataFrame(
        [(str(path), 10, 20), (str(path), 95, 100), (str(path), 5, 5), (str(path), 7, 3)],
        "source_path string, start bigint, end bigint",
    )
    found = {(row.start, row.end): bytes(row.content) for row in objects.read_ranges(plan).collect()}
    assert found == {(10, 20): bytes(range(10, 20)), (95, 100): bytes(range(95, 100)), (5, 5): b"", (7, 3): b""}


def test_stat_and_listing(spark, files, tmp_path):
    contents, _ = files
    listed = objects.list_tree(spark, f"{tmp_path}/from", f"{tmp_path}/levels")
    assert {row.path[len(f"{tmp_path}/from/"):]: row.size for row in listed.where("NOT is_dir").collect()} == {
        name: len(content) for name, content in contents.items()
    }
    assert listed.where("is_dir").count() == 8
    stats = objects.stat(listed.where("NOT is_dir").select("path"))
    assert {row.path[len(f"{tmp_path}/from/"):]: row.md5 for row in stats.collect()} == {
        name: hashlib.md5(content).hexdigest() for name, content in contents.items()
    }


def test_unfinished_copies_report_progress(spark):
    report = spark.createDataFrame(
        [("R", "t", "s", "d", 5, 9, 2, "progress", None)],
        "request_id string, transfer_id string, source_path string, target_path string, bytes_uploaded bigint, "
        "total_bytes bigint, steps bigint, state string, error string",
    )
    row = progress_records(report).first()
    assert row.topic == "progress"
    assert row.value == (
        '{"ids":{"request":"R","transfer":"t"},"message":'
        '[2,{"sourcePath":"s","targetPath":"d","bytesUploaded":5,"totalBytes":9}]}'
    )


def many_files(spark, tmp_path, count=40):
    (tmp_path / "from").mkdir()
    for number in range(count):
        (tmp_path / f"from/f{number}").write_bytes(b"%d" % number * 100)
    rows = [(f"{tmp_path}/from/f{number}", f"{tmp_path}/to/f{number}") for number in range(count)]
    return spark.createDataFrame(rows, "source_path string, target_path string")


def test_no_core_is_left_out_where_objects_are_small(spark, tmp_path):
    """Reading back and finishing take a task for each core, though all bytes together are far below what a task may have."""
    job = CopyJob(spark, f"{tmp_path}/job", step=32, shared_target=True)
    assert {row.state for row in job.run(decided(spark, many_files(spark, tmp_path), 32)).collect()} == {"copied"}
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 and len(list((tmp_path / "job/finished/attempt=0").glob("part-*.parquet"))) == cores
    assert job.verify_chunks().rdd.getNumPartitions() == cores


def test_objects_of_one_row_group_are_written_by_several_tasks(spark, tmp_path):
    rows = [(f"{tmp_path}/to/f{number}", b"%d" % number) for number in range(40)]
    frame = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    written = objects.write_objects(frame, 4).withColumn("task", F.spark_partition_id()).collect()
    assert {(row.path, row.size) for row in written} == {(path, len(content)) for path, content in rows}
    assert len({row.task for row in written}) == 4


def test_last_outcomes_are_found_once_for_an_attempt(spark, tmp_path, monkeypatch):
    plan = decided(spark, many_files(spark, tmp_path), 32).persist()
    plan.count()
    (tmp_path / "from/f7").rename(tmp_path / "away")
    asked = []
    outcomes = CopyJob.outcomes
    monkeypatch.setattr(CopyJob, "outcomes", lambda job: asked.append(1) or outcomes(job))
    job = CopyJob(spark, f"{tmp_path}/job", step=32, max_retries=0, shared_target=True)
    states = {row.target_path.rsplit("/", 1)[1]: row.state for row in job.run(plan).collect()}
    assert [name for name, state in states.items() if state != "copied"] == ["f7"]
    assert len(asked) <= 8  # 13 before
    (tmp_path / "away").rename(tmp_path / "from/f7")
    # Another job in the same folder sees what the first one did, and the first one what the other did.
    other = CopyJob(spark, f"{tmp_path}/job", step=32, max_retries=0, shared_target=True)
    assert {row.state for row in other.run(plan).collect()} == {"copied"}
    assert job.copied().count() == other.copied().count() == 40 * 4 + 30 * 3


def test_content_that_cannot_be_read_makes_no_folder(tmp_path):
    with pytest.raises(FileNotFoundError):
        objects.write_whole(f"{tmp_path}/to/f", objects.pieces(f"{tmp_path}/from/f", 0, 10))
    assert not (tmp_path / "to").exists()
    assert objects.write_whole(f"{tmp_path}/to/e", iter([]))[0] == 0 and (tmp_path / "to/e").read_bytes() == b""


def test_adjoining_chunks_are_written_as_one_part(spark, files, tmp_path):
    """Most objects are one file until they are finished, which then only needs its name."""
    contents, requests = files
    job = CopyJob(spark, f"{tmp_path}/job", step=32)
    job.write_plan(decided(spark, requests, 32))
    assert job.attempt() == 0
    part = tmp_path / "to/d6/f1000.unfinished.0"
    assert part.read_bytes() == contents["d6/f1000"] and [path.name for path in part.parent.iterdir()] == [part.name]
    assert len(list((tmp_path / "to/d7").rglob("*"))) < 100  # 3126 before
    number = part.stat().st_ino
    assert job.finish() == 0 and (tmp_path / "to/d6/f1000").stat().st_ino == number
    assert {path.relative_to(tmp_path / "to").as_posix(): path.read_bytes() for path in (tmp_path / "to").rglob("*") if path.is_file()} == contents
    assert {row.steps for row in job.report().collect() if row.source_path.endswith(("f33", "f1000", "f100000"))} == {2, 32, 3125}


def test_a_part_ends_where_its_source_does(spark, files, tmp_path):
    contents, requests = files
    rows = decided(spark, requests, 32).persist()
    rows.count()
    source = tmp_path / "from/d6/f1000"
    source.write_bytes(contents["d6/f1000"][:500])  # 15 chunks, and 20 bytes of the next
    first = CopyJob(spark, f"{tmp_path}/job", step=32, max_retries=0)
    states = {row.source_path.rsplit("/", 1)[1]: (row.state, row.bytes_uploaded) for row in first.run(rows).collect()}
    assert states.pop("f1000") == ("failed", 480) and {state for state, _ in states.values()} == {"copied"}
    source.write_bytes(contents["d6/f1000"])
    again = CopyJob(spark, f"{tmp_path}/job", step=32, max_retries=0)
    assert {row.state for row in again.run(rows).collect()} == {"copied"}
    assert (tmp_path / "to/d6/f1000").read_bytes() == contents["d6/f1000"]
    assert [path.name for path in (tmp_path / "to/d6").iterdir()] == ["f1000"]
    parts = again.outcomes().where("source_path LIKE '%f1000' AND error IS NULL").groupBy("attempt")
    parts = {row.attempt: (row.chunks, row.first) for row in parts.agg(F.count("part").alias("chunks"), F.min("part").alias("first")).collect()}
    assert parts == {0: (15, ".0"), 1: (17, "/480")}


def test_runs_of_chunks_leave_work_for_all_tasks(spark, tmp_path):
    job = CopyJob(spark, f"{tmp_path}/job")
    assert job._run_bytes(40 * job.step, 40) == job.step
    assert job._run_bytes(4000 * job.step, 40) == 16 * job.step
    assert job._run_bytes(10**15, 40) == 64 * job.step
    assert CopyJob(spark, f"{tmp_path}/job", shared_target=True)._run_bytes(10**15, 40) == job.step


def test_finishing_again_finds_the_file_renamed(tmp_path):
    wanted, md5 = (f"{tmp_path}/f", 3, [3], [".0"], "text/csv"), hashlib.md5(b"abc").hexdigest()
    (tmp_path / "f.unfinished.0").write_bytes(b"abc")
    for _ in range(2):
        Mover(False).finish_object(*wanted, md5)
        assert [path.name for path in tmp_path.iterdir()] == ["f"] and (tmp_path / "f").read_bytes() == b"abc"
    with pytest.raises(objects.WrongContent):
        Mover(False).finish_object(*wanted, "0" * 32)
    (tmp_path / "f").unlink()
    with pytest.raises(OSError):
        Mover(False).finish_object(*wanted, None)


def test_chunks_of_a_job_before_parts_had_names_are_finished(spark, tmp_path):
    (tmp_path / "from").mkdir()
    (tmp_path / "from/f").write_bytes(bytes(range(100)))
    row = (f"{tmp_path}/from/f", f"{tmp_path}/to/f")
    plan = decided(spark, spark.createDataFrame([row], "source_path string, target_path string"), 32)
    (tmp_path / "to/f.unfinished").mkdir(parents=True)
    for start in (0, 64):
        (tmp_path / f"to/f.unfinished/{start}").write_bytes(bytes(range(start, start + 32)))
    old = "source_path string, target_path string, source_size bigint, start bigint, end bigint, is_whole boolean, md5 string, moved bigint, error string"
    known = [(*row, 100, start, start + 32, False, hashlib.md5(bytes(range(start, start + 32))).hexdigest(), 32, None) for start in (0, 64)]
    spark.createDataFrame(known, old).write.parquet(f"{tmp_path}/job/attempts/attempt=0")
    job = CopyJob(spark, f"{tmp_path}/job", step=32)
    assert [row.state for row in job.run(plan).collect()] == ["copied"] and job.outcomes().count() == 4
    assert (tmp_path / "to/f").read_bytes() == bytes(range(100)) and not (tmp_path / "to/f.unfinished").exists()


def test_nothing_is_joined_before_there_are_outcomes(spark, tmp_path):
    job = CopyJob(spark, f"{tmp_path}/job")
    names = spark.createDataFrame([("a", None)], "target_path string, error string")
    for nothing, kinds in ((job.outcomes(), OUTCOME_DDL + ", attempt int"), (job.finished(), FINISH_DDL)):
        assert nothing.schema.simpleString() == spark.createDataFrame([], kinds).schema.simpleString() and nothing.count() == 0
        left = names.join(nothing.select("target_path"), "target_path", "left_anti")
        assert "Join" not in left._jdf.queryExecution().optimizedPlan().toString() and left.count() == 1


def test_parts_that_overlap_give_each_byte_once(tmp_path):
    for ends, parts in (([4, 6, 8], [".0", "/2", "/4"]), ([4, 8], [".0", "/4"]), ([2, 6, 4, 8], [".0", "/2", "/2", "/4"])):
        for part, content in ((".0", b"abcd"), ("/2", b"cdef"), ("/4", b"efgh")):
            (tmp_path / "f.unfinished").mkdir(exist_ok=True)
            (tmp_path / f"f.unfinished{part}").write_bytes(content)
        Mover(False).finish_object(f"{tmp_path}/f", 8, ends, parts, None, hashlib.md5(b"abcdefgh").hexdigest())
        assert [path.name for path in tmp_path.iterdir()] == ["f"] and (tmp_path / "f").read_bytes() == b"abcdefgh"


def test_objects_asked_for_twice_are_whole(spark, files, tmp_path):
    contents, requests = files
    rows = decided(spark, requests, 32)
    CopyJob(spark, f"{tmp_path}/job", step=32, max_retries=0).run(rows.unionByName(rows)).count()
    assert {name: (tmp_path / "to" / name).read_bytes() for name in contents} == contents


def test_chunks_of_another_jobs_part_are_found_together(spark, tmp_path):
    for folder in ("from", "to"):
        (tmp_path / folder).mkdir()
    (tmp_path / "from/f").write_bytes(bytes(range(100)))
    (tmp_path / "to/f.unfinished.0").write_bytes(bytes(range(98)))
    row = (f"{tmp_path}/from/f", f"{tmp_path}/to/f")
    plan = decided(spark, spark.createDataFrame([row], "source_path string, target_path string"), 32)
    resumed = spark.createDataFrame([(row[1], [(0, 96)])], "target_path string, ranges array<struct<start: bigint, end: bigint>>")
    job = CopyJob(spark, f"{tmp_path}/job", step=32)
    assert [row.state for row in job.run(plan, resumed).collect()] == ["copied"]
    assert [row.start for row in job.outcomes().where("moved > 0").collect()] == [96]
    assert (tmp_path / "to/f").read_bytes() == bytes(range(100))
