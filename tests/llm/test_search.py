import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulbook.llm import norm_search

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def rows():
    random = np.random.default_rng(5)
    out = []
    for at in range(400):
        length = [1.0, 0.1, 5.0][at % 3]
        vector = random.normal(size=6)
        out.append((at, (vector / np.linalg.norm(vector) * length).tolist()))
    same = [0.5, 0.25, 0.0, 0.0, -1.0, 0.125]
    out += [(at, same) for at in range(500, 560)] + [(600, [0.0] * 6), (650, [0.0] * 6)]
    out += [(700, [1.0, 2.0]), (750, [2.0, -1.0]), (800, [1.0, 2.0, 3.0])]
    out += [(850, None), (900, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (950, [math.nan] * 6), (1000, [math.inf] * 6), (None, same)]
    return out + [(1050, same), (1050, same), (1100, [1e30, 0.0, 0.0, 0.0, 0.0, 1e20])]


def brute(k):
    sound = [
        (vec_id, [min(max(math.floor(256 * float(np.float32(x))), -(2**63)), 2**63 - 1) for x in vector])
        for vec_id, vector in rows()
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    out = []
    for query_id, query in sound:
        if query_id % 50:
            continue
        scores = sorted(
            (-min(max(sum(a * b for a, b in zip(query, vector)), 1 - 2**63), 2**63 - 1), vec_id)
            for vec_id, vector in sound
            if vec_id != query_id and len(vector) == len(query)
        )
        out += [(query_id, rank, vec_id, -score) for rank, (score, vec_id) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,cosine", [(1 << 18, 0.9), (30, 0.9), (1 << 18, 0.2)])
def test_results_equal_brute_force(spark, monkeypatch, block, cosine):
    monkeypatch.setattr(norm_search, "BLOCK_VALUES", block)
    monkeypatch.setattr(norm_search, "FIRST_VALUES", 60)
    monkeypatch.setattr(norm_search, "TILE", 64)
    monkeypatch.setattr(norm_search, "HIGH_COSINE", cosine)
    frame = spark.createDataFrame([(*row, 0, "theirs") for row in rows()], VECTORS)
    found = norm_search.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute(5)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0], 0, "x"), (1, [2.0], 0, "x")], VECTORS)
    assert list(map(tuple, norm_search.top_k(few, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 256 * 512)]
    assert norm_search.top_k(few, F.col("vec_id") == 9).count() == 0
    assert norm_search.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0
