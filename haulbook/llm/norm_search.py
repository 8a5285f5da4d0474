"""Exact top-k by inner product with vectors bucketed by length.

Vectors are stored in the order of their length and met bucket by bucket (a bucket's lengths differ by a few per cent). For
a query with a k-th best score so far, a bucket asks for a local cosine: that score over the query's length and the bucket's
largest length. Above 1, the bucket is passed over whole. Where the cosine is high, few vectors can reach it, and those that
cannot are told by the coordinate in which the query is largest (coordinate pruning); where it is low, vectors shorter
than the score demands are left out (length pruning). What remains is verified by exact products.

Queries are taken in blocks of bounded size. A block goes to all tasks, which each return their best k per query; no
vector is shuffled or repeated for a query. The first scores to beat come from the longest vectors, a bounded number.

Defined results: vectors that are null or hold a null or a component that is not finite take no part, nor do rows
without an id; vectors are compared with those of equally many components; a query is never compared with rows of its own
id; each repeated query row gets its own results; ties go to the smaller id; a query with fewer than k others gets them
all; components and scores beyond 64 bits stop at the largest number; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulbook.llm.common import stored

#: Numbers that a block of queries and the first vectors hold at most, and vectors met at once in a task.
BLOCK_VALUES, FIRST_VALUES, TILE = 1 << 17, 1 << 17, 2048

#: Lengths in a bucket differ by this factor at most; from this local cosine on, coordinates are looked at.
BUCKET_RATIO, HIGH_COSINE = 1.05, 0.9

#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)


def whole_numbers(vector: str) -> Column:
    """Components as floor(256 * x); null if the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint")))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products, as integers."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if largest < EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


class Best:
    """The best k per query so far, with the score to beat."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.vectors, self.floors, self.k = ids, vectors, floors.astype(np.float64), k
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.found = np.zeros((0, 3), np.int64)  # query, score, id

    def take(self, query: np.ndarray, score: np.ndarray, vector_id: np.ndarray) -> None:
        rows = np.concatenate((self.found, np.stack((query, score, vector_id), axis=1)))
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))) if len(rows) else np.zeros(0, int)
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        self.found = rows[rank < self.k]
        last = rows[rank == self.k - 1]
        self.floors[last[:, 0]] = np.maximum(self.floors[last[:, 0]], last[:, 1])

    def meet(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
        """Verifies what a bucket's part cannot rule out."""
        longest = lengths.max(initial=0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.floors > 0, self.floors / (self.lengths * longest), -1.0)
        # Lengths are rounded: a little is left to the exact products.
        asked = np.flatnonzero(~(cosine > 1 + 1e-9))
        high = asked[cosine[asked] >= HIGH_COSINE]
        low = asked[cosine[asked] < HIGH_COSINE]
        for query in high.tolist():
            self.verify(np.array([query]), ids, vectors, self.by_coordinate(query, cosine[query], vectors, lengths))
        if len(low):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.floors[low] > 0, self.floors[low] / self.lengths[low], 0.0).min()
            self.verify(low, ids, vectors, np.flatnonzero(lengths >= least * (1 - 1e-9)))

    def by_coordinate(self, query: int, cosine: float, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Vectors whose share in the query's largest coordinate permits the cosine."""
        cosine = min(cosine, 1.0)
        own = self.vectors[query] / self.lengths[query]
        at = int(np.abs(own).argmax())
        spread = np.sqrt((1 - cosine**2) * (1 - min(own[at] ** 2, 1.0))) + 1e-9
        share = vectors[:, at] / np.maximum(lengths, 1e-300)
        return np.flatnonzero(np.abs(share - own[at] * cosine) <= spread + (1 - cosine) * abs(own[at]))

    def verify(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        scores = products(self.vectors[queries], vectors[rows])
        good = (scores >= self.floors[queries][:, None]) & (ids[rows][None, :] != self.ids[queries][:, None])
        query, row = np.nonzero(good)
        if len(query):
            self.take(queries[query], scores[query, row], ids[rows][row])


def best_of_partition(block: list[Best]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a partition, sorted by length, has to offer to a block of queries (one Best for each vector size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pools = {pool.vectors.shape[1]: Best(pool.ids, pool.vectors, pool.floors.copy(), pool.k) for pool in block}
        kept: list[pd.DataFrame] = []

        def meet() -> None:
            whole = pd.concat(kept, ignore_index=True)
            kept.clear()
            sizes = whole["v"].map(len).to_numpy()
            for size, pool in pools.items():
                mine = whole[sizes == size]
                if not len(mine):
                    continue
                ids, vectors = mine["vec_id"].to_numpy(np.int64), np.stack(mine["v"].to_list()).astype(np.int64)
                lengths = mine["length"].to_numpy(np.float64)
                bucket = np.floor(np.log(np.maximum(lengths, 1e-300)) / np.log(BUCKET_RATIO)).astype(np.int64)
                for number in np.unique(bucket)[::-1].tolist():
                    rows = np.flatnonzero(bucket == number)
                    pool.meet(ids[rows], vectors[rows], lengths[rows])

        rows = 0
        for batch in batches:
            kept.append(batch)
            rows += len(batch)
            if rows >= TILE:
                meet()
                rows = 0
        if kept:
            meet()
        for (size, pool) in pools.items():
            query, score, found = pool.found.T
            yield pd.DataFrame({"size": size, "query": query, "score": score, "vec_id": found})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the best k of every row that ``is_query`` says is a query."""
    spark = vectors.sparkSession
    whole = vectors.select(
        F.col(key).cast("long").alias("vec_id"), whole_numbers(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    whole = whole.withColumn("length", F.sqrt(squares))
    # In order of length, longest first; equal vectors are spread by their ids.
    whole = stored(
        whole.repartitionByRange(F.col("length").desc(), F.col("vec_id")).sortWithinPartitions(F.col("length").desc()),
        "vectors",
    )
    size = whole.agg(F.max(F.size("v"))).first()[0] or 1
    first = whole.orderBy(F.col("length").desc(), "vec_id").limit(max(FIRST_VALUES // size, k + 1)).toPandas()
    asking = whole.where("asks").select("vec_id", "v").withColumn("row", F.monotonically_increasing_id())
    asking = stored(asking, "queries")
    per_block = max(BLOCK_VALUES // size, 1)
    blocks = -(-asking.count() // per_block)
    numbered = asking.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1))))
    parts = []
    for number in range(blocks):
        queries = numbered.where(F.col("block") == number).select("vec_id", "v", "row").toPandas()
        found = whole.select("vec_id", "v", "length").mapInPandas(
            best_of_partition(pools_of(queries, first, k)), "size int, query long, score long, vec_id long"
        )
        best = Window.partitionBy("size", "query").orderBy(F.col("score").desc(), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        parts.append(named(ranked, queries))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if len(parts) > 1:
        parts = [stored(part, "best") for part in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def pools_of(queries: pd.DataFrame, first: pd.DataFrame, k: int) -> list[Best]:
    """A pool for each vector size of a block, with scores to beat from the first vectors."""
    pools = []
    sizes = queries["v"].map(len)
    for size in sorted(set(sizes)):
        mine = queries[sizes == size]
        ids, vectors = mine["vec_id"].to_numpy(np.int64), np.array(mine["v"].to_list(), np.int64).reshape(-1, size)
        pool = Best(ids, vectors, np.full(len(mine), -np.inf), k)
        known = first[first["v"].map(len) == size]
        for at in range(0, len(known), TILE):
            part = known.iloc[at : at + TILE]
            rows = np.array(part["v"].to_list(), np.int64).reshape(-1, size)
            pool.meet(part["vec_id"].to_numpy(np.int64), rows, part["length"].to_numpy(np.float64))
        pools.append(Best(ids, vectors, pool.floors, k))
    return pools


def named(ranked: DataFrame, queries: pd.DataFrame) -> DataFrame:
    """Ranked results with the ids of their queries, which a block's own order stands for."""
    sizes = queries["v"].map(len)
    ids = {int(size): queries[sizes == size]["vec_id"].to_numpy(np.int64) for size in sorted(set(sizes))}

    @F.pandas_udf("long")
    def query_id(size: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([int(ids[s][q]) for s, q in zip(size, query)], dtype="int64")

    return ranked.select(query_id("size", "query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
