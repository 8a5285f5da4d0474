import hashlib
import math

import numpy as np
import pytest

from haulbook.llm import ball_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, key string, v string"


def rows(count=300, size=34):
    random = np.random.default_rng(7)
    # Few different values, so that ties are common.
    out = [(at, (random.integers(-6, 7, size) / 64).tolist(), at % 3 if at % 7 else None) for at in range(count)]
    out += [(900, out[5][1], 1)] * 150 + [(3, out[5][1], 0)] * 2
    out += [(901, None, 1), (902, [1.0, None] * (size // 2), 1), (903, [math.nan] * size, 1), (904, [math.inf] * size, 1)]
    return out + [(None, out[1][1], None)]


def brute(rows, entries, parts=16, rounds=2):
    """Every part compared with every entry, in Python's own whole numbers."""
    kept = [
        (vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector])
        for vec_id, vector, label in rows
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    kept.sort(key=lambda row: (row[0] is None, row[0] or 0, row[2]))
    size = len(kept[0][2])
    cuts = [(part * size // parts, (part + 1) * size // parts) for part in range(parts)]
    books = [[row[2][start:end] for row in kept[:entries]] for start, end in cuts]

    def assigned():
        out = []
        for _, _, vector in kept:
            found = []
            for (start, end), book in zip(cuts, books):
                squares = [sum((a - b) ** 2 for a, b in zip(vector[start:end], entry)) for entry in book]
                found.append((squares.index(min(squares)), min(squares)))
            out.append(found)
        return out

    for _ in range(rounds):
        codes = assigned()
        for part, (start, end) in enumerate(cuts):
            for entry in range(len(books[part])):
                mine = [row[2][start:end] for row, code in zip(kept, codes) if code[part][0] == entry]
                if mine:
                    books[part][entry] = [sum(column) // len(mine) for column in zip(*mine)]
    codes = assigned()
    errors = [sum(distance for _, distance in code) for code in codes]
    by_label = {}
    for (_, label, _), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(
        (
            (vec_id, "".join(f"{entry:02x}" for entry, _ in code), error, by_label[label], sha)
            for (vec_id, label, _), code, error in zip(kept, codes, errors)
        ),
        key=repr,
    )


def frame(spark, rows):
    return spark.createDataFrame([(*row, "theirs", "theirs", "theirs") for row in rows], VECTORS)


@pytest.mark.parametrize("chunk,entries,rounds", [(8192, 64, 2), (40, 9, 3), (64, 64, 0)])
def test_codes_equal_brute_force(spark, monkeypatch, chunk, entries, rounds):
    monkeypatch.setattr(ball_codes, "CHUNK_ROWS", chunk)
    found = ball_codes.encode(frame(spark, rows()).repartition(3), entries=entries, rounds=rounds)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows(), entries, rounds=rounds)


def test_balls_skip_most_work_and_lose_nothing():
    random = np.random.default_rng(3)
    centres = random.integers(-4000, 4000, (64, 4))
    parts = centres[random.integers(0, 64, 5000)] + random.integers(-60, 60, (5000, 4))
    own, distance = ball_codes.all_distances(parts, centres)
    radii = np.full(64, -1)
    np.maximum.at(radii, own, distance)
    code, best, looked_at = ball_codes.Balls(centres, radii).nearest(parts, own)
    assert (code == own).all() and (best == distance).all()
    assert looked_at < len(parts)  # of 63 others each
    # Entries moved since: still the same as looking at all of them.
    moved = centres + random.integers(-2000, 2000, centres.shape)
    distance = ((parts - moved[own]) ** 2).sum(axis=1)
    radii = np.full(64, -1)
    np.maximum.at(radii, own, distance)
    code, best, looked_at = ball_codes.Balls(moved, radii).nearest(parts, own)
    expected, least = ball_codes.all_distances(parts, moved)
    assert (code == expected).all() and (best == least).all() and 0 < looked_at < 63 * len(parts) / 2


def test_few_none_and_other_sizes(spark):
    few = [(1, [0.5] * 5, None), (2, [0.25] * 5, None), (3, [1.0] * 16, 4)]
    found = ball_codes.encode(frame(spark, few))
    expected = brute(few[:2], 64) + brute(few[2:], 64)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert ball_codes.encode(frame(spark, [])).count() == 0
    assert ball_codes.encode(frame(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        ball_codes.encode(frame(spark, [(1, [1e30] * 16, 1)])).count()
