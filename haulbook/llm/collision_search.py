"""Approximate nearest neighbours by cosine through collision counting over single projections.

Vectors are brought to length one, where the order of cosines is the order of distances, and projected on M seeded Gaussian
directions. Each direction keeps its values as a sorted array. A query opens a window around its own value in every array; a
vector collides with it in an array if it lies in the window. At radius R windows are ``2 * WIDTH * R`` wide, so that a vector
at distance R collides in each array with one and the same probability, whatever R: radii grow step by step (virtual
rehashing) by moving the windows' ends outwards, and counts go on from where they were. A vector whose count reaches the
threshold is verified by its cosine. The threshold is the largest that a vector at distance R misses with probability
MISS at most, and a query is settled once its k-th best distance is no larger than R.

On Spark, vectors and queries are dealt into blocks of bounded size by hash, and every pair of blocks is a unit of work of its
own with arrays of its own; results of a query are merged by a window with partial limits. Every vector is in the index.
A first pass over one block of vectors, of bounded size, gives each query a distance that its k-th best can't exceed, so that
blocks without a near vector stop early. Equal vectors are searched for once, and represented by their k + 1 smallest ids,
which loses no result as their cosines are equal and ties go to smaller ids.

Defined results: vectors that are null, of length zero, or hold a null or a component that is not finite take no part, nor do rows
without an id; vectors are compared with those of equally many components; a query is never compared with rows of its own
id; each repeated query row gets its own results; a vector stored twice under one id is one candidate for each row; ties go
to the smaller id; a query with fewer than k others gets them all; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulbook.llm.common import stored

#: Directions, half a window's width at radius 1, and the share of vectors within the radius that the threshold may miss.
DIRECTIONS, WIDTH, MISS = 24, 1.0, 0.01

#: The first radius and the factor from one to the next; distances of unit vectors end at 2.
FIRST_RADIUS, GROWTH = 0.125, 1.5

#: Vectors and queries of a block, on average.
BLOCK_ROWS = 8192

SEED = 42


def threshold(directions: int = DIRECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Collisions that a vector at the radius reaches with probability 1 - miss or more, as many as possible."""
    hit = erf(width / sqrt(2))
    below, least = 0.0, 0
    while least < directions:
        below += comb(directions, least) * hit**least * (1 - hit) ** (directions - least)
        if below > miss:
            break
        least += 1
    return max(least, 1)


def directions_of(size: int, directions: int) -> np.ndarray:
    """The seeded directions for vectors of this size, as columns."""
    return np.random.default_rng([SEED, size]).standard_normal((size, directions))


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors as they are, but divided by their largest component where squares could leave the doubles."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.where((largest < 1e-100) | (largest > 1e100), largest, 1.0)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / lengths_of(vectors)[:, None]


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of one vector with others; the same two vectors give the same number whatever else is asked."""
    products = np.einsum("ij,j->i", vectors, query)
    return products / (lengths_of(vectors) * np.sqrt(np.einsum("i,i->", query, query)))


class SortedProjections:
    """The arrays of a block of vectors: for every direction the rows in the order of their values."""

    def __init__(self, vectors: np.ndarray, directions: int = DIRECTIONS):
        self.vectors = scaled(vectors)
        self.lengths = lengths_of(self.vectors)
        self.axes = directions_of(vectors.shape[1], directions)
        values = (unit(vectors) @ self.axes).T
        self.rows = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.rows, axis=1)
        self.least = threshold(directions)

    def cosines(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines of a query with some rows; where these are many, multiplying all is quicker than taking them out."""
        if 4 * len(rows) > len(self.vectors):
            products = np.einsum("ij,j->i", self.vectors, query)[rows]
        else:
            products = np.einsum("ij,j->i", self.vectors[rows], query)
        return products / (self.lengths[rows] * np.sqrt(np.einsum("i,i->", query, query)))

    def search(self, query: np.ndarray, k: int, within: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and cosines of those found, some k best among them, and the number of collisions counted.

        ``within``: a distance that the k-th best of all blocks can't exceed.
        """
        query = scaled(query[None])[0]
        own = (unit(query[None]) @ self.axes)[0]
        centres = np.array([np.searchsorted(values, value) for values, value in zip(self.values, own)])
        low, high = centres.copy(), centres.copy()
        counts = np.zeros(len(self.vectors), np.int64)
        waiting = np.ones(len(self.vectors), bool)
        found, scores, counted = np.zeros(0, np.int64), np.zeros(0), 0
        radius = min(FIRST_RADIUS, within)
        while True:
            met = []
            for number, values in enumerate(self.values):
                below = np.searchsorted(values, own[number] - WIDTH * radius)
                above = np.searchsorted(values, own[number] + WIDTH * radius, side="right")
                met += [self.rows[number, below : low[number]], self.rows[number, high[number] : above]]
                counted += max(low[number] - below, 0) + max(above - high[number], 0)
                low[number], high[number] = min(below, low[number]), max(above, high[number])
            counts += np.bincount(np.concatenate(met), minlength=len(counts))
            new = np.flatnonzero(waiting & (counts >= self.least))
            waiting[new] = False
            if len(new):
                found = np.concatenate((found, new))
                scores = np.concatenate((scores, self.cosines(query, new)))
            if len(scores) >= k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                # A little is left for rounding.
                within = min(within, sqrt(max(2 - 2 * worst, 0.0)) + 1e-9)
            if radius >= within:
                break
            radius = min(radius * GROWTH, within)
        if len(scores) < k and within >= 2:
            # So few vectors that all of them are results.
            new = np.flatnonzero(waiting)
            found = np.concatenate((found, new))
            scores = np.concatenate((scores, self.cosines(query, new)))
        return found, scores, counted


def best_of_unit(size: int, k: int) -> Callable[[pa.Table], pa.Table]:
    """The best k of a block of vectors for every query of a unit; ``asked`` tells the queries."""

    def numbers(rows: pa.Table) -> np.ndarray:
        flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in rows["v"].chunks]
        return np.concatenate(flat or [np.zeros(0)]).astype(np.float64).reshape(-1, size)

    def run(rows: pa.Table) -> pa.Table:
        asked, block = rows.filter(rows["asked"]), rows.filter(pc.invert(rows["asked"]))
        names, ids = block["number"].to_numpy(), block["first_id"].to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        if len(names) and len(asked):
            arrays = SortedProjections(numbers(block))
            limits = zip(asked["number"].to_pylist(), numbers(asked), asked["within"].to_pylist())
            for query, vector, within in limits:
                found, scores, _ = arrays.search(vector, k, within)
                best = np.lexsort((ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
                out.append((np.full(len(found), query), names[found], ids[found], scores))
        columns = [np.concatenate(column) for column in zip(*out)] if out else [np.zeros(0)] * 4
        return pa.table({
            name: pa.array(column, pa.float64() if name == "score" else pa.int64())
            for name, column in zip(("query", "number", "first_id", "score"), columns)
        })

    return run


def met(queries: DataFrame, vectors: DataFrame, parts: int, blocks: range, size: int, k: int) -> DataFrame:
    """``query``, ``number``, ``first_id`` and ``score`` of what the units of work find.

    Each of the ``parts`` of the queries meets each of the ``blocks`` of vectors: a row is repeated for the blocks of the other
    side, not for its rows.
    """
    def spread(count: range) -> Column:
        return F.explode(F.sequence(F.lit(count[0]), F.lit(count[-1])))

    left = queries.select("part", spread(blocks).alias("block"), F.lit(True).alias("asked"), "number", "first_id", "v", "within")
    right = vectors.where(F.col("block").between(blocks[0], blocks[-1])).select(
        spread(range(parts)).alias("part"), "block", F.lit(False).alias("asked"), "number", "first_id", "v", F.lit(0.0).alias("within")
    )
    # With a number given, small units stay tasks of their own.
    dealt = left.unionByName(right).repartition(parts * len(blocks), "part", "block")
    return dealt.groupBy("part", "block").applyInArrow(
        best_of_unit(size, k), "query long, number long, first_id long, score double"
    )


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k of every query by score, equal ones by their smallest id."""
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), "first_id")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def nearest_of_size(distinct: DataFrame, size: int, k: int) -> DataFrame:
    """The best k distinct vectors of one size, its own among them, for each that is asked for."""
    asking = distinct.where("asked")
    blocks, parts = (max(-(-frame.count() // BLOCK_ROWS), 1) for frame in (distinct, asking))
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("number", F.lit(1)), F.lit(parts)).cast("int")
    vectors = distinct.select("number", "first_id", "v", block.alias("block"))
    queries = asking.select("number", "first_id", "v", F.lit(2.0).alias("within"), part.alias("part"))
    first = stored(met(queries, vectors, parts, range(1), size, k), "first")
    if blocks == 1:
        return first
    # The k-th best cosine so far, as a distance; a little is added for rounding.
    last = best(first, k).where(F.col("place") == k).select(
        F.col("query").alias("number"),
        (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) + 1e-9).alias("known"),
    )
    bounded = queries.join(last, "number", "left").withColumn("within", F.coalesce("known", "within")).drop("known")
    return first.union(met(stored(bounded, "bounded"), vectors, parts, range(1, blocks), size, k))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest found for every row that ``is_query`` says is a query."""
    spark = vectors.sparkSession
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # Adding zero turns minus zero into zero, so that equal vectors look equal.
    double = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    taking_part = sound & F.exists(vector, lambda x: x != 0) & F.col(key).isNotNull()
    rows = vectors.where(taking_part).select(
        F.col(key).cast("long").alias("vec_id"), double.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = stored(rows.withColumn("digest", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)), "vectors")
    whole = rows.groupBy("digest").agg(
        F.min("vec_id").alias("first_id"), F.max("asks").alias("asked"), F.first("v").alias("v")
    )
    distinct = stored(whole.withColumn("number", F.monotonically_increasing_id()), "distinct")
    sizes = [row[0] for row in distinct.groupBy(F.size("v")).count().orderBy(F.size("v")).collect()]
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = None
    for size in sizes:
        # A query's own vector may be among the best without giving a result.
        part = nearest_of_size(distinct.where(F.size("v") == size), size, k + 1)
        found = part if found is None else found.union(part)
    # Of equal vectors the k + 1 smallest ids, each k times at most, are all that can be results.
    smallest = Window.partitionBy("digest").orderBy("vec_id")
    members = rows.groupBy("digest", "vec_id").count().withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1)
    names = distinct.select("number", "digest")
    named = best(found, k + 1).join(names, "number").join(members, "digest")
    result = F.struct((-F.col("score")).alias("score"), F.col("vec_id"), F.least("count", F.lit(k)).alias("times"))
    lists = named.groupBy(F.col("query").alias("number")).agg(F.array_sort(F.collect_list(result)).alias("results"))
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "digest")
    answers = asked.join(lists.join(names, "number").select("digest", "results"), "digest")
    others = F.filter("results", lambda x: x["vec_id"] != F.col("query_id"))
    repeated = F.flatten(F.transform(others, lambda x: F.array_repeat(x, x["times"].cast("int"))))
    return answers.select("query_id", F.posexplode(F.slice(repeated, 1, k)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.score")).alias("score")
    )
