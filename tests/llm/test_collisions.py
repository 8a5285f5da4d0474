import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulbook.llm import collision_search

VECTORS = "vec_id long, embedding array<float>, label int, score string, number string, digest string"


def clustered(count, size=24, groups=12, spread=0.1):
    random = np.random.default_rng(11)
    centres = random.normal(size=(groups, size))
    return [(at, (centres[at % groups] + spread * random.normal(size=size)).tolist()) for at in range(count)]


def scattered(count, size=24):
    random = np.random.default_rng(12)
    return [(at, (random.normal(size=size) * 10.0 ** (at % 5)).tolist()) for at in range(count)]


def frame(spark, rows):
    return spark.createDataFrame([(*row, 0, "theirs", "theirs", "theirs") for row in rows], VECTORS)


def brute(rows, k=5):
    """Results of every row with an id divisible by 50, from all cosines."""
    sound = [
        (vec_id, np.array([float(np.float32(x)) for x in vector]))
        for vec_id, vector in rows
        if vec_id is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
    ]
    out = []
    for query_id, query in sound:
        if query_id % 50 == 0:
            scores = sorted(
                (-float(query @ v) / math.sqrt(query @ query) / math.sqrt(v @ v), vec_id)
                for vec_id, v in sound
                if vec_id != query_id and len(v) == len(query)
            )
            out += [(query_id, rank, vec_id, -score) for rank, (score, vec_id) in enumerate(scores[:k], 1)]
    return out


def found_by(spark, rows, **options):
    found = collision_search.nearest(frame(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return [tuple(row) for row in found.collect()]


@pytest.mark.parametrize("rows", [clustered(2000), scattered(2000)])
def test_recall_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(collision_search, "BLOCK_ROWS", 300)
    found, expected = found_by(spark, rows), brute(rows)
    ranks = {(query, rank) for query, rank, _, _ in found}
    assert ranks == {(query, rank) for query, rank, _, _ in expected}
    hits = len({row[0::2] for row in found} & {row[0::2] for row in expected})
    assert hits >= 0.9 * len(expected)
    # Scores are the measure itself.
    vectors = {vec_id: np.array(vector, np.float32).astype(float) for vec_id, vector in rows}
    for query, _, vec_id, score in found:
        a, b = vectors[query], vectors[vec_id]
        assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_hot_vector_ties_and_unfit_rows(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "BLOCK_ROWS", 64)
    same = [0.5, -0.25, 1.0, 0.125]
    rows = [(at, same) for at in range(0, 300, 2)] + [(7, same), (7, same), (50, same)]
    rows += [(at, (np.random.default_rng(at).normal(size=4)).tolist()) for at in range(301, 420)]
    rows += [(1000, [-x for x in same]), (1050, [0.0] * 4), (1100, None), (1150, []), (1200, [1.0, None, 1.0, 1.0])]
    rows += [(1250, [math.nan] * 4), (1300, [math.inf] * 4), (None, same), (1350, [1.0, 2.0]), (1400, [-0.0, 3.0]), (1450, [0.0, 3.0])]
    expected, found = sorted(brute(rows)), sorted(found_by(spark, rows))
    key = [row[:2] for row in expected]
    assert [row[:2] for row in found] == key
    assert [row[3] for row in found] == pytest.approx([row[3] for row in expected], abs=1e-9)
    # The copies' own results are certain: cosine one, smallest ids first, both rows of an id.
    copies = [row[:3] for row in found if row[0] <= 250]
    assert copies == [row[:3] for row in expected if row[0] <= 250]
    assert [row[2] for row in found if row[0] == 100] == [0, 2, 4, 6, 7]
    assert sorted(row[2] for row in found if row[0] == 50) == sorted([0, 2, 4, 6, 7] * 2)


def test_few_and_none(spark):
    few = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [1e-200, 1e-200]), (3, [1e30, 1e30])]
    found = collision_search.nearest(
        spark.createDataFrame([(a, b) for a, b in few], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0
    )
    assert [(row["rank"], row["vec_id"]) for row in sorted(found.collect())] == [(1, 2), (2, 3), (3, 1)]
    assert [row["score"] for row in sorted(found.collect())] == pytest.approx([0.5**0.5, 0.5**0.5, -1.0])
    assert found_by(spark, few[:1]) == [] and found_by(spark, []) == [] and found_by(spark, [(7, [1.0]), (8, [1.0])]) == []


def test_windows_follow_the_threshold():
    """A vector is found once its collisions within the final radius reach the threshold; most far ones are never verified."""
    rows = np.array([vector for _, vector in clustered(3000)])
    arrays = collision_search.SortedProjections(rows)
    verified = counted = 0
    for query in rows[:40]:
        found, scores, collisions = arrays.search(query, 6, 2.0)
        verified, counted = verified + len(found), counted + collisions
        radius = math.sqrt(max(2 - 2 * np.sort(scores)[-6], 0)) + 1e-9
        values = collision_search.unit(rows) @ arrays.axes
        own = (collision_search.unit(query[None]) @ arrays.axes)[0]
        collided = (np.abs(values - own) <= collision_search.WIDTH * radius * (1 - 1e-9)).sum(axis=1)
        assert set(np.flatnonzero(collided >= arrays.least)) <= set(found.tolist())
    assert verified < 0.25 * 40 * len(rows) and counted < 0.5 * 40 * len(rows) * collision_search.DIRECTIONS


def test_threshold_misses_at_most_its_share():
    least = collision_search.threshold()
    random = np.random.default_rng(1)
    counts = (np.abs(random.normal(size=(200_000, collision_search.DIRECTIONS))) <= collision_search.WIDTH).sum(axis=1)
    assert (counts < least).mean() <= 0.012 < (counts < least + 1).mean()


def test_cosines_do_not_depend_on_how_many_are_asked():
    random = np.random.default_rng(5)
    vectors = random.standard_normal((400, 64))
    arrays = collision_search.SortedProjections(vectors)
    for query in vectors[:5]:
        whole = collision_search.cosines(query, vectors)
        for count in (1, 7, 99, 101, 400):
            rows = np.sort(random.choice(400, count, replace=False))
            assert np.array_equal(arrays.cosines(query, rows), whole[rows])
