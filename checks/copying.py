"""Copy decisions, byte ranges, directory expansion and copies of the documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from haulbook.functions import text
from haulbook.operators import directories, joins, preflight, ranges
from haulbook.plans.copy import OBJECTS_PER_TASK, CopyJob, progress_records, resumed_from
from haulbook.session import run_dir
from haulbook.sources import messages, objects

# Fixed value of these checks: small enough that many documents take several chunks.
STEP = 4096
READ = 1000

# --- decisions

DECIDED = f"""
    SELECT c.source_path, c.target_path, c.doc_id, s.size AS source_size, s.content_type,
           CASE WHEN s.path IS NULL THEN 'fail_missing'
                WHEN c.expected_size <> s.size THEN 'fail_size'
                WHEN t.md5 = c.expected_md5 THEN 'skip'
                WHEN t.path IS NOT NULL THEN 'fail_taken'
                WHEN s.size <= {STEP} THEN 'oneshot' ELSE 'chunked' END AS decision,
           t.md5 AS target_md5, c.expected_size
    FROM copies c LEFT JOIN source_manifest s ON s.path = c.source_path
    LEFT JOIN target_manifest t ON t.path = c.target_path"""


def decided(spark, sf_dir) -> DataFrame:
    copies, source, target = (
        v.copies(spark, sf_dir),
        v.source_manifest(spark, sf_dir),
        v.target_manifest(spark, sf_dir),
    )
    return preflight.decide(copies, source, target, STEP)


@check(
    "cp_preflight",
    v.with_views(
        "copies",
        "source_manifest",
        "target_manifest",
        decided=DECIDED,
        query="""SELECT source_path, target_path, decision,
                        CASE decision WHEN 'fail_missing' THEN 'no such object: ' || source_path
                             WHEN 'fail_size' THEN 'size is ' || source_size || ', expected ' || expected_size
                             WHEN 'fail_taken' THEN 'target already exists: ' || target_path || ' with md5 '
                                                    || target_md5 END AS reason
                 FROM decided""",
    ),
)
def decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("source_path", "target_path", "decision", "reason")


@check(
    "prj_content_type",
    v.with_views(
        "source_manifest",
        query="SELECT path, coalesce(content_type, 'application/octet-stream') AS content_type FROM source_manifest",
    ),
)
def content_types(spark, sf_dir):
    return v.source_manifest(spark, sf_dir).select(
        "path", text.content_type(F.col("content_type")).alias("content_type")
    )


@check(
    "jn_manifest",
    v.with_views(
        "copies",
        "source_manifest",
        "target_manifest",
        query="""SELECT c.source_path, c.target_path, s.path IS NOT NULL AS source_exists,
                        t.path IS NOT NULL AS target_exists, s.md5 AS source_md5, t.md5 AS target_md5
                 FROM copies c LEFT JOIN source_manifest s ON s.path = c.source_path
                 LEFT JOIN target_manifest t ON t.path = c.target_path""",
    ),
)
def manifests(spark, sf_dir):
    rows = joins.with_manifests(
        v.copies(spark, sf_dir), v.source_manifest(spark, sf_dir), v.target_manifest(spark, sf_dir)
    )
    return rows.select("source_path", "target_path", "source_exists", "target_exists", "source_md5", "target_md5")


@check(
    "cp_verify",
    v.with_views(
        "copies",
        "source_manifest",
        "target_manifest",
        query="""SELECT c.source_path, CASE WHEN t.path IS NULL THEN 'missing'
                        WHEN t.size <> c.expected_size THEN 'wrong_size'
                        WHEN t.md5 <> c.expected_md5 THEN 'wrong_md5' ELSE 'ok' END AS verdict
                 FROM copies c LEFT JOIN target_manifest t ON t.path = c.target_path""",
    ),
)
def verification(spark, sf_dir):
    rows = preflight.verify(
        v.copies(spark, sf_dir), v.source_manifest(spark, sf_dir), v.target_manifest(spark, sf_dir)
    )
    return rows.select("source_path", "verdict")


@check(
    "prj_object_url",
    """SELECT page_id, 'https://bucket.' || CASE WHEN page_id % 2 = 0 THEN 's3' ELSE 's3-eu-west-1' END
              || '.amazonaws.com/'
              || array_to_string(list_transform(string_split(url, '/'), lambda s: url_encode(s)), '/') AS url
       FROM pages""",
)
def object_urls(spark, sf_dir):
    region = F.when(F.col("page_id") % 2 == 0, text.DEFAULT_REGION).otherwise("eu-west-1")
    url = text.object_url(F.lit("bucket"), region, F.col("url"))
    return v.table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


# --- byte ranges

CHUNKS = f"""
    SELECT path, size, x AS start, least(x + {STEP}, size) AS "end"
    FROM (SELECT path, size, unnest(range(0, size, {STEP})) AS x FROM objects) y"""


@check("cp_byte_ranges", v.with_views("objects", chunks=CHUNKS, query="SELECT * FROM chunks"))
def byte_ranges(spark, sf_dir):
    return ranges.byte_ranges(v.objects(spark, sf_dir).select("path", "size"), STEP)


@check(
    "cp_sub_ranges",
    v.with_views(
        "objects",
        chunks=CHUNKS,
        counted=f"""SELECT *, greatest(1, CAST(ceil(("end" - start - 1) / {READ}.0) AS BIGINT)) AS n FROM chunks""",
        query=f"""SELECT path, start, "end", i AS read, start + i * {READ} AS read_start,
                         CASE WHEN i = n - 1 THEN "end" ELSE start + (i + 1) * {READ} END - 1 AS read_end
                  FROM (SELECT *, unnest(range(0, n)) AS i FROM counted) x""",
    ),
)
def sub_ranges(spark, sf_dir):
    return ranges.sub_ranges(byte_ranges(spark, sf_dir).drop("size"), READ)


# --- directories

LISTING = """
    SELECT path, parse_dirpath(path) AS parent, FALSE AS is_dir, size FROM objects
    UNION ALL SELECT DISTINCT '/' || source || '/' || lang, '/' || source, TRUE, -1 FROM documents
    UNION ALL SELECT DISTINCT '/' || source, '', TRUE, -1 FROM documents"""


def listing(spark, sf_dir) -> DataFrame:
    """The documents as a tree: sources, languages, files."""
    documents = v.table(spark, sf_dir, "documents")
    source = F.concat(F.lit("/"), "source")
    lang = F.concat(source, F.lit("/"), "lang")
    files = v.objects(spark, sf_dir).join(documents.select("doc_id", lang.alias("parent")), "doc_id")
    return (
        files.select("path", "parent", F.lit(False).alias("is_dir"), "size")
        .unionByName(
            documents.select(
                lang.alias("path"), source.alias("parent"), F.lit(True).alias("is_dir"), F.lit(-1).alias("size")
            ).distinct()
        )
        .unionByName(
            documents.select(
                source.alias("path"), F.lit("").alias("parent"), F.lit(True).alias("is_dir"), F.lit(-1).alias("size")
            ).distinct()
        )
    )


def directory_requests(spark, sf_dir) -> DataFrame:
    """Every source directory, and some of the language directories below them, with and without a final slash."""
    documents = v.table(spark, sf_dir, "documents")
    sources = documents.select(F.concat(F.lit("/"), "source").alias("source_path")).distinct()
    langs = (
        documents.where("lang = 'en'")
        .select(F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("source_path"))
        .distinct()
    )
    rows = sources.unionByName(langs)
    target = F.concat(F.lit("bucket"), F.col("source_path"))
    return rows.select("source_path", target.alias("target_path"), F.lit(True).alias("is_directory"))


DIRECTORY_REQUESTS = """
    SELECT DISTINCT '/' || source AS source_path, 'bucket/' || source AS target_path FROM documents
    UNION ALL SELECT DISTINCT '/' || source || '/' || lang, 'bucket/' || source || '/' || lang
    FROM documents WHERE lang = 'en'"""


@check(
    "cp_expand_directory",
    v.with_views(
        "objects",
        listing=LISTING,
        requested=DIRECTORY_REQUESTS,
        query="""SELECT l.path AS source_path, 'bucket' || l.path AS target_path, l.is_dir AS is_directory
                 FROM requested r JOIN listing l ON l.parent = r.source_path""",
    ),
)
def expand_directory(spark, sf_dir):
    return directories.expand_directory(directory_requests(spark, sf_dir), listing(spark, sf_dir))


@check(
    "cp_expand_recursive",
    v.with_views(
        "objects",
        listing=LISTING,
        requested=DIRECTORY_REQUESTS,
        query="""SELECT l.path AS source_path, 'bucket' || l.path AS target_path, FALSE AS is_directory
                 FROM requested r JOIN listing l ON starts_with(l.path, r.source_path || '/') WHERE NOT l.is_dir""",
    ),
)
def expand_recursive(spark, sf_dir):
    return directories.expand_recursive(directory_requests(spark, sf_dir), listing(spark, sf_dir))


@check(
    "prj_child_path",
    v.with_views("objects", query="SELECT path, 'gs/' || doc_id || substr(path, 5) AS target_path FROM objects"),
)
def child_paths(spark, sf_dir):
    target = text.child_path(F.concat(F.lit("gs/"), "doc_id"), F.lit("/src"), F.col("path"))
    return v.objects(spark, sf_dir).select("path", target.alias("target_path"))


# --- files

TREE_SQL = "SELECT path, size, md5 FROM objects"


def tasks_of(rows: DataFrame) -> int:
    """Tasks for a row per object, however many row groups they are read from."""
    return max(ranges.tasks_for(rows.count(), OBJECTS_PER_TASK), rows.sparkSession.sparkContext.defaultParallelism)


def export(spark: SparkSession, sf_dir: str, root: str, where: str = "true") -> DataFrame:
    """Write documents as files below a root, and return their manifest."""
    contents = v.object_contents(spark, sf_dir).where(where)
    placed = contents.select(F.concat(F.lit(root), "path").alias("path"), "content")
    manifest = f"{root}-manifest-{len(where)}"
    objects.write_objects(placed, tasks_of(contents)).write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest)


def below(root: str, column: str = "path"):
    return F.substr(F.col(column), F.lit(len(root) + 1)).alias(column)


def file_copies(spark, sf_dir, root: str, where: str = "true") -> DataFrame:
    """A request per document, from files below one folder to another."""
    return (
        v.objects(spark, sf_dir)
        .where(where)
        .select(
            F.concat(F.lit(f"{root}/from"), "path").alias("source_path"),
            F.concat(F.lit(f"{root}/to"), "path").alias("target_path"),
            "doc_id",
            F.lit(None).cast("bigint").alias("expected_size"),
            F.col("md5").alias("expected_md5"),
            F.lit(False).alias("force"),
        )
    )


def manifest_of(found: DataFrame) -> DataFrame:
    return found.where("is_found").select("path", "size", "md5", F.lit(None).cast("string").alias("content_type"))


@check("snk_object_oneshot", v.with_views("objects", query=TREE_SQL))
def write_whole(spark, sf_dir):
    root = f"{run_dir(spark, 'snk_object_oneshot')}/files"
    written = export(spark, sf_dir, root)
    return objects.stat(written.select("path")).select(below(root), "size", "md5")


@check(
    "src_listing",
    v.with_views(
        "objects",
        listing=LISTING,
        query="""SELECT path, parent, is_dir, size FROM listing""",
    ),
)
def list_files(spark, sf_dir):
    work = run_dir(spark, "src_listing")
    root = f"{work}/files"
    export(spark, sf_dir, root)
    found = objects.list_tree(spark, root, f"{work}/levels")
    size = F.coalesce("size", F.lit(-1)).alias("size")
    return found.select(below(root), below(root, "parent"), "is_dir", size)


@check(
    "src_stat",
    v.with_views(
        "objects",
        query="""SELECT path, doc_id % 11 <> 0 AS is_found, CASE WHEN doc_id % 11 <> 0 THEN size ELSE -1 END AS size,
                        CASE WHEN doc_id % 11 <> 0 THEN md5 END AS md5 FROM objects""",
    ),
)
def stat_files(spark, sf_dir):
    root = f"{run_dir(spark, 'src_stat')}/files"
    export(spark, sf_dir, root, "doc_id % 11 <> 0")
    wanted = v.objects(spark, sf_dir).select(F.concat(F.lit(root), "path").alias("path"))
    size = F.coalesce("size", F.lit(-1)).alias("size")
    return objects.stat(wanted).select(below(root), "is_found", size, "md5")


@check(
    "src_range_read",
    v.with_views(
        "objects",
        chunks=f"""SELECT path, content, x AS start, least(x + {STEP}, size) AS "end"
                   FROM (SELECT *, unnest(range(0, size, {STEP})) AS x FROM objects) y""",
        query="""SELECT path, start, "end", md5(content[CAST(start AS INT) + 1:CAST("end" AS INT)]) AS md5
                 FROM chunks""",
    ),
)
def read_ranges(spark, sf_dir):
    root = f"{run_dir(spark, 'src_range_read')}/files"
    written = export(spark, sf_dir, root)
    plan = ranges.byte_ranges(written.select(F.col("path").alias("source_path"), "size"), STEP)
    read = objects.read_ranges(plan.drop("size"))
    return read.select(below(root, "source_path"), "start", "end", F.md5("content").alias("md5")).withColumnRenamed(
        "source_path", "path"
    )


@check(
    "snk_force_delete",
    v.with_views(
        "objects",
        query="""SELECT path, doc_id % 5 = 0 AS is_deleted, FALSE AS is_found FROM objects
                 WHERE doc_id % 2 = 0
                 UNION ALL SELECT path, FALSE AS is_deleted, TRUE AS is_found FROM objects
                 WHERE doc_id % 2 <> 0 AND doc_id % 5 = 0""",
    ),
)
def force_delete(spark, sf_dir):
    """One document in five exists; deleting is forced for the even ones."""
    root = f"{run_dir(spark, 'snk_force_delete')}/files"
    export(spark, sf_dir, root, "doc_id % 5 = 0")
    placed = v.objects(spark, sf_dir).select("doc_id", F.concat(F.lit(root), "path").alias("path"))
    report = f"{root}-deleted"
    objects.delete_objects(placed.where("doc_id % 2 = 0")).write.parquet(report)
    deleted = spark.read.parquet(report)
    after = objects.stat(placed.where("doc_id % 2 = 0 OR doc_id % 5 = 0"), with_md5=False)
    rows = after.join(deleted, "path", "left")
    return rows.select(below(root), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), "is_found")


def copy_files(spark, sf_dir, name: str, step: int, where: str = "true") -> tuple[CopyJob, DataFrame, str]:
    """Export, decide, copy; returns the job, its report and the folder copied to."""
    root = run_dir(spark, name)
    source = export(spark, sf_dir, f"{root}/from")
    copies = file_copies(spark, sf_dir, root, where)
    target = objects.stat(copies.select(F.col("target_path").alias("path")), partitions=tasks_of(source))
    job = CopyJob(spark, f"{root}/job", step)
    report = job.run(preflight.decide(copies, manifest_of(source), manifest_of(target), step))
    return job, report, f"{root}/to"


def copied_files(report: DataFrame, folder: str) -> DataFrame:
    """What is at the targets now, read again."""
    found = objects.stat(report.select(F.col("target_path").alias("path")))
    rows = report.withColumnRenamed("target_path", "path").join(found, "path")
    return rows.select(below(folder), "decision", "state", "size", "md5")


@check(
    "cp_copy_oneshot",
    v.with_views("objects", query="SELECT path, 'oneshot' AS decision, 'copied' AS state, size, md5 FROM objects"),
)
def copy_oneshot(spark, sf_dir):
    _, report, folder = copy_files(spark, sf_dir, "cp_copy_oneshot", step=ranges.DEFAULT_STEP)
    return copied_files(report, folder)


@check(
    "cp_copy_chunked",
    v.with_views(
        "objects",
        query=f"""SELECT path, CASE WHEN size <= {STEP} THEN 'oneshot' ELSE 'chunked' END AS decision,
                         'copied' AS state, size, md5 FROM objects""",
    ),
)
def copy_chunked(spark, sf_dir):
    _, report, folder = copy_files(spark, sf_dir, "cp_copy_chunked", STEP)
    return copied_files(report, folder)


@check(
    "snk_object_chunked",
    v.with_views(
        "objects",
        query=f"""SELECT path, size, md5, CAST(ceil(size / {STEP}.0) AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS damaged
                  FROM objects WHERE size > {STEP}""",
    ),
)
def write_chunked(spark, sf_dir):
    """Objects above one step only, with the number of chunks and of chunks that read back differently."""
    root = run_dir(spark, "snk_object_chunked")
    source = export(spark, sf_dir, f"{root}/from")
    copies = file_copies(spark, sf_dir, root)
    rows = preflight.decide_unchecked(copies, source.select("path", "size"), STEP)
    large = rows.where((F.col("decision") == preflight.CHUNKED) & (F.col("source_size") > STEP))
    job = CopyJob(spark, f"{root}/job", STEP)
    report = job.run(large)
    damaged = job.verify_chunks().groupBy("target_path").agg(F.count(F.lit(1)).alias("damaged"))
    found = objects.stat(report.select(F.col("target_path").alias("path")))
    rows = report.join(damaged, "target_path", "left").withColumnRenamed("target_path", "path").join(found, "path")
    return rows.select(
        below(f"{root}/to"),
        "size",
        "md5",
        F.col("steps").alias("chunks"),
        F.coalesce("damaged", F.lit(0)).cast("bigint").alias("damaged"),
    )


@check(
    "cp_copy_rewrite",
    v.with_views("objects", query="SELECT '/again' || path AS path, 'copied' AS state, size, md5 FROM objects"),
)
def copy_rewrite(spark, sf_dir):
    """Source and target in one store, which copies by itself; nothing checked beforehand."""
    root = run_dir(spark, "cp_copy_rewrite")
    source = export(spark, sf_dir, f"{root}/store")
    store = f"{root}/store"
    copies = source.select(
        F.col("path").alias("source_path"),
        F.concat(F.lit(f"{store}/again"), F.substr(F.col("path"), F.lit(len(store) + 1))).alias("target_path"),
    )
    job = CopyJob(spark, f"{root}/job", STEP, shared_target=True, rewrite=True)
    report = job.run(preflight.decide_unchecked(copies, source.select("path", "size"), STEP))
    return copied_files(report, store).drop("decision")


@check(
    "cp_retry_failed",
    v.with_views(
        "objects",
        query=f"""SELECT path, 'copied' AS state, size, md5,
                         CAST(CASE WHEN size = 0 THEN 1 WHEN size <= {STEP} THEN 1
                                   ELSE ceil(size / {STEP}.0) END AS BIGINT)
                         * CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS tries
                  FROM objects""",
    ),
)
def retry_failed(spark, sf_dir):
    """A third of the sources is away at first; running again copies these, and only these; chunks are written in place."""
    root = run_dir(spark, "cp_retry_failed")
    export(spark, sf_dir, f"{root}/from", "doc_id % 3 <> 0")
    copies = file_copies(spark, sf_dir, root)
    source = v.objects(spark, sf_dir).select(
        F.concat(F.lit(f"{root}/from"), "path").alias("path"), "size", "md5", F.lit(None).alias("content_type")
    )
    nothing = source.where(F.lit(False))
    job = CopyJob(spark, f"{root}/job", STEP, max_retries=0, shared_target=True)
    job.run(preflight.decide(copies, source, nothing, STEP))
    export(spark, sf_dir, f"{root}/from", "doc_id % 3 = 0")
    report = job.run(preflight.decide(copies, source, nothing, STEP))
    tries = job.outcomes().groupBy("target_path").agg(F.count(F.lit(1)).alias("tries"))
    rows = copied_files(report, f"{root}/to")
    tries = tries.select(below(f"{root}/to", "target_path"), "tries").withColumnRenamed("target_path", "path")
    return rows.drop("decision").join(tries, "path")


@check(
    "cp_wrong_content",
    v.with_views(
        "objects",
        query=f"""SELECT path, CASE WHEN doc_id % 4 = 1 THEN 'failed' ELSE 'copied' END AS state,
                         doc_id % 4 <> 1 AS is_found,
                         CASE WHEN doc_id % 4 = 1 THEN 'md5 of /to' || path || ' is ' || md5 || ', expected ' || md5(md5)
                              END AS error
                  FROM objects""",
    ),
)
def wrong_content(spark, sf_dir):
    """One source in four is not what its request expects: that copy fails, and there is nothing at its target."""
    root = run_dir(spark, "cp_wrong_content")
    source = export(spark, sf_dir, f"{root}/from")
    wrong = F.when(F.col("doc_id") % 4 == 1, F.md5("expected_md5")).otherwise(F.col("expected_md5"))
    copies = file_copies(spark, sf_dir, root).withColumn("expected_md5", wrong)
    job = CopyJob(spark, f"{root}/job", STEP)
    report = job.run(preflight.decide(copies, manifest_of(source), manifest_of(source).where("false"), STEP))
    found = objects.stat(report.select(F.col("target_path").alias("path")), with_md5=False)
    rows = report.withColumnRenamed("target_path", "path").join(found.select("path", "is_found"), "path")
    error = F.regexp_replace("error", "^WrongContent: ", "")
    return rows.select(below(f"{root}/to"), "state", "is_found", F.replace(error, F.lit(root), F.lit("")).alias("error"))


@check(
    "cp_resume_progress",
    v.with_views(
        "objects",
        query=f"""SELECT path, 'copied' AS state, size, md5, CAST(ceil(size / {STEP}.0) AS BIGINT) - 2 AS copied_now
                  FROM objects WHERE size > {2 * STEP}""",
    ),
)
def resume_from_progress(spark, sf_dir):
    """Sources have two chunks at first. A second job knows the first one's progress messages alone, and copies the rest."""
    root = run_dir(spark, "cp_resume_progress")
    large = v.object_contents(spark, sf_dir).where(F.length("content") > 2 * STEP)
    placed = large.select(F.concat(F.lit(f"{root}/from"), "path").alias("path"), "content")
    short = placed.withColumn("content", F.substring("content", 1, 2 * STEP))
    objects.write_objects(short).write.parquet(f"{root}/short")
    copies = file_copies(spark, sf_dir, root).withColumns(
        {"request_id": F.lit("r"), "transfer_id": F.col("doc_id").cast("string")}
    )
    sizes = placed.select("path", F.length("content").cast("bigint").alias("size"))
    decided = preflight.decide_unchecked(copies, sizes, STEP).where(F.col("decision") == preflight.CHUNKED)
    CopyJob(spark, f"{root}/first", STEP, max_retries=0, outbox=f"{root}/topic").run(decided)
    objects.write_objects(placed).write.parquet(f"{root}/whole")
    progress = messages.as_progress(messages.decode(messages.read_folder(spark, f"{root}/topic/*")))
    report = CopyJob(spark, f"{root}/second", STEP).run(decided, resumed_from(progress))
    rows = copied_files(report, f"{root}/to").drop("decision")
    tries = CopyJob(spark, f"{root}/second", STEP).outcomes().where("moved > 0")
    tries = tries.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("copied_now"))
    return rows.join(tries.select(below(f"{root}/to"), "copied_now"), "path")


@check(
    "cp_progress_report",
    v.with_views(
        "objects",
        ended=f"""SELECT path, doc_id, size, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'copied' END AS state
                  FROM objects""",
        query=f"""SELECT 'result' AS topic, CAST(doc_id AS VARCHAR) AS transfer_id,
                         CASE state WHEN 'failed' THEN 'FATAL_FAILURE' ELSE 'SUCCESS' END AS signal,
                         CASE state WHEN 'failed'
                              THEN '{{"detail":null,"message":"Copy failed: no such object: /from' || path || '"}}'
                              ELSE '{{"path":"/to' || path || '"}}' END AS info,
                         CASE state WHEN 'failed' THEN 0 ELSE size END AS bytes_uploaded
                  FROM ended""",
    ),
)
def progress_report(spark, sf_dir):
    """Reports as result messages: one source in eleven does not exist."""
    root = run_dir(spark, "cp_progress_report")
    source = export(spark, sf_dir, f"{root}/from", "doc_id % 11 <> 0")
    copies = file_copies(spark, sf_dir, root)
    job = CopyJob(spark, f"{root}/job", STEP)
    report = job.run(preflight.decide(copies, manifest_of(source), manifest_of(source).where("false"), STEP))
    keys = copies.select(
        "target_path", F.lit("r").alias("request_id"), F.col("doc_id").cast("string").alias("transfer_id")
    )
    report = report.drop("request_id", "transfer_id").join(keys, "target_path")
    records = progress_records(report).withColumn("arrival", F.lit(0).cast("bigint"))
    ended = messages.as_results(messages.decode(records.where("topic = 'result'")))
    moving = messages.as_progress(messages.decode(records.where("topic = 'progress'")))
    rows = ended.withColumn("topic", F.lit("result")).unionByName(
        moving.drop("step").withColumn("topic", F.lit("progress")), allowMissingColumns=True
    )
    info = F.replace(F.col("info"), F.lit(root), F.lit(""))
    return rows.join(report.select("transfer_id", "bytes_uploaded"), "transfer_id").select(
        "topic", "transfer_id", "signal", info.alias("info"), "bytes_uploaded"
    )
