"""Vector codes: product quantisation with codebooks fitted by Ball k-means in whole numbers.

Vectors are cut into equal consecutive parts, each with a codebook of its own. From the second assignment on, an entry and the
parts assigned to it form a ball. Its radius defines the neighbour entries: one further away than twice the radius is
nearest to no part of the ball. A part within half the distance of the closest neighbour lies in the stable core and keeps its
entry unseen; the others lie in annular rings between the half distances of successive neighbours, and are compared with
the neighbours up to their ring and no other. All distances are squared whole numbers, so pruning is exact, ties included.

Spark holds the vectors; a pass reads each stored row with its present code, and writes the next one. Tasks sum, or take
the maximum, per part and entry before anything is shuffled, so that what is merged is (parts x entries) rows a task, and the
driver sees the codebooks alone.

Defined results: vectors that are null or hold a null or a component that is not finite are dropped; vectors with different
numbers of components are coded apart, each number with codebooks of its own; parts of a vector whose length is no multiple of
``parts`` differ in length by one; a repeated row counts as often as it occurs, also among the first entries; rows without an id
are coded, and come last among the first entries; with fewer rows than entries, codebooks have as many entries as there are rows;
rows without a label belong together; an empty table gives an empty result; no other column is read. Components beyond
2^26 / 256 in size are an error, as their squares would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import stored
from haulbook.llm.norm_search import whole_numbers

#: Entries of a codebook, parts of a vector, and rounds of fitting.
ENTRIES, PARTS, ROUNDS = 64, 16, 2

#: Rows met at once in a task, and numbers above which squares would leave 64 bits.
CHUNK_ROWS, LARGEST = 8192, 1 << 26


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end."""
    return [(part * size // parts, (part + 1) * size // parts) for part in range(parts)]


class Balls:
    """Entries of one part with the neighbours that their radii define, closest first."""

    def __init__(self, entries: np.ndarray, radii: np.ndarray):
        """``radii``: squared distance of the farthest part assigned to each entry, -1 without any."""
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, -1)
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        distances = np.take_along_axis(apart, order, axis=1)
        counts = (distances <= 4 * radii[:, None]).sum(axis=1)
        self.neighbours = [order[entry, :count] for entry, count in enumerate(counts)]
        self.distances = [distances[entry, :count] for entry, count in enumerate(counts)]

    def nearest(self, parts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each part, its squared distance, and how many other entries were looked at."""
        best = ((parts - self.entries[own]) ** 2).sum(axis=1)
        code = own.copy()
        # Parts of one ball next to each other.
        rows = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[rows], np.arange(len(self.entries) + 1))
        left, seen = [], []
        for entry in range(len(self.entries)):
            mine = rows[starts[entry] : starts[entry + 1]]
            rings = np.searchsorted(self.distances[entry], 4 * best[mine], side="right")
            mine, rings = mine[rings > 0], rings[rings > 0]
            if len(mine):
                ends = np.cumsum(rings)
                left.append((mine, rings))
                seen.append(self.neighbours[entry][np.arange(ends[-1]) - np.repeat(ends - rings, rings)])
        if not left:
            return code, best, 0
        row, rings = (np.concatenate(column) for column in zip(*left))
        candidate = np.concatenate(seen)
        distance = ((np.repeat(parts[row], rings, axis=0) - self.entries[candidate]) ** 2).sum(axis=1)
        begins = np.cumsum(rings) - rings
        least = np.minimum(np.minimum.reduceat(distance, begins), best[row])
        tied = np.where(distance == np.repeat(least, rings), candidate, len(self.entries))
        kept = np.where(best[row] == least, own[row], len(self.entries))
        code[row] = np.minimum(np.minimum.reduceat(tied, begins), kept)
        best[row] = least
        return code, best, len(candidate)


def all_distances(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance, from all entries: the first assignment has no balls."""
    best = np.full(len(parts), np.iinfo(np.int64).max)
    code = np.zeros(len(parts), np.int64)
    for number, entry in enumerate(entries):
        distance = ((parts - entry) ** 2).sum(axis=1)
        nearer = distance < best
        best[nearer], code[nearer] = distance[nearer], number
    return code, best


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a partition in pieces of about CHUNK_ROWS rows."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, rows = [], 0
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """A column of lists of ``size`` numbers as rows."""
    return pa.concat_arrays([chunk.flatten() for chunk in column.chunks]).to_numpy(zero_copy_only=False).reshape(-1, size)


def codes_of(column: pa.ChunkedArray, parts: int) -> np.ndarray:
    """A column of codes, one byte a part, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def assign(size: int, parts: int, books: list[np.ndarray], radii: np.ndarray | None) -> Callable:
    """Codes and errors of a partition's rows; ``radii`` (parts x entries) belong to the codes the rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = None if radii is None else [Balls(books[part], radii[part]) for part in range(parts)]
        for chunk in chunks(batches):
            vectors = matrix(chunk["v"], size)
            if np.abs(vectors).max(initial=0) >= LARGEST:
                raise ValueError("a component is too large for exact squared distances")
            before = None if balls is None else codes_of(chunk["code"], parts).astype(np.int64)
            codes = np.zeros((len(vectors), parts), np.uint8)
            error = np.zeros(len(vectors), np.int64)
            for part, (start, end) in enumerate(bounds(size, parts)):
                if balls is None:
                    code, distance = all_distances(vectors[:, start:end], books[part])
                else:
                    code, distance, _ = balls[part].nearest(vectors[:, start:end], before[:, part])
                codes[:, part] = code
                error += distance
            out = {"key": chunk["key"], "label": chunk["label"], "v": chunk["v"]}
            out |= {"code": pa.array([row.tobytes() for row in codes], pa.binary()), "error": pa.array(error)}
            yield from pa.table(out).to_batches()

    return run


def totals(size: int, parts: int, entries: int) -> Callable:
    """Per part and entry the number of a partition's rows and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        sums = [np.zeros((entries, end - start), np.int64) for start, end in bounds(size, parts)]
        for chunk in chunks(batches):
            vectors, codes = matrix(chunk["v"], size), codes_of(chunk["code"], parts)
            for part, (start, end) in enumerate(bounds(size, parts)):
                count[part] += np.bincount(codes[:, part], minlength=entries)
                np.add.at(sums[part], codes[:, part], vectors[:, start:end])
        part, entry = np.nonzero(count)
        rows = {"part": part, "entry": entry, "n": count[part, entry]}
        yield from pa.table(
            {name: pa.array(values, pa.int64()) for name, values in rows.items()}
            | {"total": pa.array([sums[p][e].tolist() for p, e in zip(part, entry)], pa.list_(pa.int64()))}
        ).to_batches()

    return run


def farthest(size: int, parts: int, books: list[np.ndarray]) -> Callable:
    """Per part and entry the largest squared distance of a partition's rows to the entry that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii = np.full((parts, len(books[0])), -1, np.int64)
        for chunk in chunks(batches):
            vectors, codes = matrix(chunk["v"], size), codes_of(chunk["code"], parts)
            for part, (start, end) in enumerate(bounds(size, parts)):
                distance = ((vectors[:, start:end] - books[part][codes[:, part]]) ** 2).sum(axis=1)
                np.maximum.at(radii[part], codes[:, part], distance)
        part, entry = np.nonzero(radii >= 0)
        rows = {"part": part, "entry": entry, "radius": radii[part, entry]}
        yield from pa.table({name: pa.array(values, pa.int64()) for name, values in rows.items()}).to_batches()

    return run


def moved(rows: DataFrame, size: int, parts: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks with every used entry at the rounded-down mean of its parts."""
    entries = len(books[0])
    sent = rows.select("v", "code").mapInArrow(
        totals(size, parts, entries), "part long, entry long, n long, total array<long>"
    )
    # One number a row: sums add up under partial aggregation.
    numbers = sent.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x"))
    summed = numbers.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where("at is not null")
    found = summed.toPandas()
    books = [book.copy() for book in books]
    for part, entry, at, n, x in found[["part", "entry", "at", "n", "x"]].astype("int64").itertuples(index=False):
        books[part][entry, at] = x // n
    return books


def radii_of(rows: DataFrame, size: int, parts: int, books: list[np.ndarray]) -> np.ndarray:
    """Squared radii of all balls."""
    sent = rows.select("v", "code").mapInArrow(farthest(size, parts, books), "part long, entry long, radius long")
    found = sent.groupBy("part", "entry").agg(F.max("radius").alias("radius")).toPandas()
    radii = np.full((parts, len(books[0])), -1, np.int64)
    radii[found["part"].to_numpy(np.int64), found["entry"].to_numpy(np.int64)] = found["radius"].to_numpy(np.int64)
    return radii


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry.tolist()).encode()).hexdigest()


def coded(rows: DataFrame, size: int, entries: int, parts: int, rounds: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows of vectors of one size with code and error, and the codebooks."""
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).select("v").toPandas()["v"]
    first = np.array(first.to_list(), np.int64).reshape(-1, size)
    if np.abs(first).max(initial=0) >= LARGEST:
        raise ValueError("a component is too large for exact squared distances")
    books = [first[:, start:end].copy() for start, end in bounds(size, parts)]
    shape = "key long, label {}, v array<bigint>, code binary, error long".format(rows.schema["label"].dataType.simpleString())
    rows, radii = rows.select("key", "label", "v"), None
    for _ in range(rounds):
        rows = stored(rows.mapInArrow(assign(size, parts, books, radii), shape), "codes")
        books = moved(rows, size, parts, books)
        radii = radii_of(rows, size, parts, books)
    return stored(rows.mapInArrow(assign(size, parts, books, radii), shape), "codes"), books


def encode(
    vectors: DataFrame,
    entries: int = ENTRIES,
    parts: int = PARTS,
    rounds: int = ROUNDS,
    vector: str = "embedding",
    key: str = "vec_id",
    label: str = "label",
) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every vector that takes part."""
    if not 1 <= entries <= 256 or rounds < 0 or parts < 1:
        raise ValueError("a code has a byte a part: 1 to 256 entries")
    kept = vectors.select(
        F.col(key).cast("long").alias("key"), F.col(label).alias("label"), whole_numbers(vector).alias("v")
    ).where(F.col("v").isNotNull())
    kept = stored(kept, "vectors")
    sizes = [row[0] for row in kept.groupBy(F.size("v")).count().orderBy(F.size("v")).collect()]
    done = []
    for size in sizes:
        rows, books = coded(kept.where(F.size("v") == size), size, entries, parts, rounds)
        done.append(rows.select("key", "label", "code", "error", F.lit(digest(books)).alias("codebooks_sha256")))
    if not done:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        )
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    by_label = out.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error"))
    return out.join(by_label, F.col("label").eqNullSafe(F.col("its_label"))).select(
        F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256"
    )
