import numpy as np
import xxhash
from fixtures import WORD, empty, messy, messy_rows

from haulbook.llm import simhash


def brute(text):
    lowered = "".join(chr(ord(mark) + 32) if "A" <= mark <= "Z" else mark for mark in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[at : at + 4]) for at in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def roots_of(prints):
    """Smallest member of every print's component, comparing all pairs."""
    prints = sorted(set(prints))
    parent = {value: value for value in prints}

    def find(value):
        while parent[value] != value:
            value = parent[value]
        return value

    for one in prints:
        for other in prints:
            if (one ^ other).bit_count() <= 4:
                low, high = sorted((find(one), find(other)))
                parent[high] = low
    return {value: find(value) for value in prints}


def test_near_duplicates_equal_brute_force(spark):
    found = simhash.near_duplicates(messy(spark)).collect()
    rows = messy_rows()
    prints = [brute(row[1]) for row in rows]
    roots = roots_of(prints)
    first = {}
    for row, value in zip(rows, prints):
        if row[0] is not None:
            first[roots[value]] = min(row[0], first.get(roots[value], row[0]))
    expected = [(row[0], f"{value:016x}", first.get(roots[value])) for row, value in zip(rows, prints)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_links_lose_nothing(spark):
    """Chains and dense groups, with signs of both kinds, in lists longer than a tile."""
    random = np.random.default_rng(1)
    values = [int(value) for value in random.integers(0, 2**64, 300, dtype=np.uint64)]
    for start in (0xF99105263924CC8B, 0x799105063924CC8B, 0):
        value = start
        for _ in range(60):
            for _ in range(4):
                value ^= 1 << int(random.integers(64))
            values.append(value)
    values = sorted(set(values))
    tile, simhash.TILE = simhash.TILE, 8
    try:
        frame = spark.createDataFrame([(value - (1 << 64) * (value >> 63),) for value in values], "bits long")
        found = simhash.components(simhash.links(frame)).collect()
    finally:
        simhash.TILE = tile
    joined = {row["node"] % 2**64: row["root"] % 2**64 for row in found}
    roots = roots_of(values)
    mine = {value: joined.get(value, value) for value in values}
    groups = lambda named: {frozenset(v for v in named if named[v] == root) for root in named.values()}
    assert groups(mine) == groups(roots)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(at + 1, at) for at in range(100)], "a long, b long")
    found = simhash.components(edges).collect()
    assert len(found) == 100 and {row["root"] for row in found} == {0}


def test_components_keep_about_one_edge_of_a_node(spark, monkeypatch):
    """Near copies meet in many lists: each of 200 nodes is linked with each of 50, which makes 10,000 edges."""
    counts = []
    stored = simhash.stored

    def counted(frame, name):
        out = stored(frame, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    monkeypatch.setattr(simhash, "EDGES", 1000, raising=False)
    edges = spark.createDataFrame([(100 + at, by) for at in range(200) for by in range(50)], "a long, b long")
    found = simhash.components(edges).collect()
    assert {row["node"] for row in found} == {*range(1, 50), *range(100, 300)} and {row["root"] for row in found} == {0}
    assert max(counts) <= 500


def test_one_of_each_stays(spark):
    kept = simhash.one_of_each(messy(spark))
    assert kept.columns == messy(spark).columns
    ids = [row["doc_id"] for row in kept.collect()]
    assert len(ids) == len(set(ids)) and set(range(12)) <= set(ids) and 23 not in ids and None not in ids


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_one_of_each_equals_brute_force_jaccard(spark):
    """Copies with words replaced, chains of them, and a line that all texts share."""
    random = np.random.default_rng(7)
    line = "this very line stands in each and all of them".split()
    texts = []
    for length in (60, 120, 400, 900):
        base = [f"w{n}" for n in random.integers(0, 3000, length)] + line
        texts.append(base)
        for changes in (1, 2, 3, 5, 8, 13):
            other = list(base)
            for at in random.integers(0, length, max(1, length * changes // 200)):
                other[at] = "changed"
            texts += [other, other[: -changes * 3] + line]
    rows = [(n, " ".join(words)) for n, words in enumerate(texts)]
    order = random.permutation(len(rows)).tolist()
    rows = [(at, rows[n][1]) for at, n in enumerate(order)]
    sets = [{tuple(text.split()[at : at + 5]) for at in range(len(text.split()) - 4)} for _, text in rows]
    root = list(range(len(rows)))
    apart = 0
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                apart += (brute(rows[a][1]) ^ brute(rows[b][1])).bit_count() > 4
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if value == old else value for value in root]
    expected = {n for n, value in enumerate(root) if value == n}
    assert apart > 10
    found = {row["doc_id"] for row in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == expected


def rows_stored(monkeypatch, texts, spark):
    """Ids that stay of these texts, and the number of rows of every intermediate result by its name."""
    counts = {}
    stored = simhash.stored

    def counted(frame, name):
        out = stored(frame, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {row["doc_id"] for row in simhash.one_of_each(frame).collect()}, counts


def test_almost_similar_texts_make_no_row_for_a_pair(spark, monkeypatch):
    random = np.random.default_rng(3)
    base = [f"w{n}" for n in range(120)]
    texts = []
    for number in range(300):
        words = list(base)
        for at in random.choice(np.arange(8, 112), 3, replace=False):
            words[at] = f"own{number}"
        texts.append(words)
    sets = [{tuple(words[at : at + 5]) for at in range(len(words) - 4)} for words in texts]
    alone = set()
    for a in range(len(texts)):
        if not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for b in range(len(texts)) if b != a):
            alone.add(a)
    assert len(alone) > 100
    found, counts = rows_stored(monkeypatch, [" ".join(words) for words in texts], spark)
    assert alone <= found
    # All texts share most of their shingles: there are 44,850 pairs, and 35 lists of the index for a text.
    assert max(number for numbers in counts.values() for number in numbers) <= 35 * len(texts)


def test_the_index_of_fingerprints_finds_near_copies(spark, monkeypatch):
    texts = []
    for number in range(20):
        words = [f"w{number}x{at}" for at in range(400)]
        texts += [" ".join(words), " ".join(words[:200] + ["other"] + words[201:])]
    found, counts = rows_stored(monkeypatch, texts, spark)
    assert found == set(range(0, 40, 2))
    # What the index connects is not compared again.
    assert counts["index"][0] > 0 and counts["open"][0] < counts["lists"][0] / 4
