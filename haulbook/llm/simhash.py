"""Near-duplicates by SimHash: fingerprints, a byte-position index with count filtering, and connected components.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 bytes, position by position, and so
in at least 3 of any 7 positions. The inverted index therefore lists every distinct fingerprint under each choice of
three of the first seven positions, with the bytes found there. Fingerprints listed together are tallied: pairs that share
fewer than four positional bytes are dropped, the rest are verified by counting differing bits.

Links within a list are reduced to a tree where they are found, so that a list of g fingerprints yields fewer than g rows;
long lists are cut into tiles and each pair of tiles is a unit of work of bounded size. Copies of a text share a fingerprint
and take part once.

``one_of_each`` keeps one of each group of texts that are similar by the Jaccard measure of their five-word shingles. Its
fingerprints have 256 bits; at 0.8 they differ in 39 bits, in 68 or more by less than one pair of a million. The byte-position
index over the first 64 bits finds most similar texts: fingerprints listed together are tallied by their shared bytes and
verified by counting differing bits, and what passes is compared exactly. At 0.8 two texts share three of seven positions in 29
of 100 cases only, so a prefix filter over the shingles, which loses no pair, lists together what the index left apart; there,
too, fingerprints decide what is compared. Neither step makes a row for a pair: lists give trees that join fingerprints into
neighbourhoods, and texts are dealt by tiles of these and give trees of links.

Defined results: null and empty texts, and those without words, have fingerprint zero and are linked like others; texts of
one to three words have a single shingle; rows with a null id keep it and never lend their id to a component (a component
of such rows alone has a null id); repeated rows come out as often as they went in; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulbook.llm.common import LOWER, stored, text_of, unused

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42

#: Bytes that a linked pair shares at least, and positions looked up together: three of seven, as four of eight are shared.
MIN_SHARED = 8 - MAX_BITS
PROBES = tuple(combinations(range(7), MIN_SHARED - 1))

#: What ``one_of_each`` calls near copies: words of a shingle, and the least Jaccard similarity as a fraction.
SIMILAR_WORDS, SIMILARITY = 5, (4, 5)
#: Numbers of 64 bits that make a fingerprint for this, and the bits that near copies differ in at most. At 0.8 a bit differs
#: with probability 0.15, so 39 of 256 do, and more than 67 in less than one pair of a million. Texts that have a third of their
#: shingles in common differ in 85, others in 128.
PARTS, ALL_BITS = 4, 67
#: Bytes of 32 that two fingerprints listed together by the index share at least; what has fewer is left to the prefix filter.
#: At 0.8 this is less than one pair of a hundred of those listed together.
TALLY = 5
#: Lists up to this length are compared all together, longer ones one by one.
SHORT_LIST = 16
#: Texts of a tile, on average; a unit of work has two tiles at most.
UNIT_TEXTS = 128
#: Documents sampled, and shingles kept, to know the common ones by; no result depends on them.
SAMPLE, MOST_COMMON = 10_000, 500_000

#: Fingerprints of a list that one unit of work holds, twice at most.
TILE = 2048
#: Edges that are made into stars at once.
EDGES = 100_000


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    return majority(
        np.array([digest(joined[start:end], SEED) for start, end in zip(starts, ends[shingle_words - 1 :].tolist())], np.uint64)
    )


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of some hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def remixed(hashes: np.ndarray, count: int) -> list[np.ndarray]:
    """The hashes, and further ones derived from each."""
    out = [hashes]
    for _ in range(count - 1):
        mixed = (out[-1] ^ (out[-1] >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(mixed ^ (mixed >> np.uint64(29)))
    return out


def fingerprints(text: Column) -> Column:
    """Fingerprints as signed 64-bit numbers."""

    @F.pandas_udf("bigint")
    def over(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(text) for text in texts], np.uint64).view(np.int64))

    return over(text_of(text))


def hexadecimal(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def links_within(fingerprints: np.ndarray) -> list[tuple[int, int]]:
    """Links of one list as pairs (fingerprint, smallest of those it is connected with), a tree for each component.

    A fingerprint that is reached is not compared with others of its component again.
    """
    found: list[tuple[int, int]] = []
    rest = fingerprints
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            differing = rest ^ frontier.pop()
            shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = (shared >= MIN_SHARED) & (np.bitwise_count(differing.view(np.uint64)) <= MAX_BITS)
            if near.any():
                reached = rest[near]
                found += [(other, int(root)) for other in reached.tolist()]
                frontier.extend(reached)
                rest = rest[~near]
    return found


def links_of_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of all lists of a partition, whose rows come sorted by list."""

    def linked(lists: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        bounds = np.concatenate(([0], np.flatnonzero((lists[1:] != lists[:-1]).any(axis=1)) + 1, [len(lists)]))
        found: list[tuple[int, int]] = []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - start > 1:
                found += links_within(values[start:end])
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")

    kept: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += len(batch)
        if rows < 50_000:
            continue
        whole = pd.concat(kept, ignore_index=True)
        lists = whole[["key", "low", "high"]].to_numpy(np.int64)
        # The last list may go on in the next batch.
        cut = int(np.argmax((lists == lists[-1]).all(axis=1)))
        if cut:
            yield linked(lists[:cut], whole["bits"].to_numpy(np.int64)[:cut])
        kept, rows = [whole.iloc[cut:]], len(whole) - cut
    if rows:
        whole = pd.concat(kept, ignore_index=True)
        yield linked(whole[["key", "low", "high"]].to_numpy(np.int64), whole["bits"].to_numpy(np.int64))


def index_keys(bits: Column) -> Column:
    """What the index lists a fingerprint under: each choice of positions with the bytes found there."""
    keys = []
    for number, positions in enumerate(PROBES):
        mask = sum(0xFF << (8 * position) for position in positions)
        # The last position is never looked up, so its byte is free for the number of the choice.
        keys.append(bits.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(number << 56)))
    return F.array(*keys)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a > b, among distinct fingerprints ``bits``: all links, or fewer that connect the same ones."""
    lists = distinct.select("bits", F.explode(index_keys(F.col("bits"))).alias("key"))
    listed = Window.partitionBy("key")
    lists = lists.withColumns(
        {
            "tiles": F.ceil(F.count("*").over(listed) / TILE).cast("long"),
            "several": F.count("*").over(listed) > 1,
            "tile": ((F.row_number().over(listed.orderBy("bits")) - 1) / TILE).cast("long"),
        }
    ).where("several")
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), F.col("tile"))
    )
    units = lists.select("bits", "key", "tile", F.explode(others).alias("other")).select(
        "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "bits"
    )
    dealt = units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "bits")
    return dealt.mapInPandas(links_of_lists, "a bigint, b bigint").distinct()


def stars(edges: np.ndarray) -> np.ndarray:
    """Edges (a, b) that connect the same ones as some edges: each node but the smallest of its component with that one."""
    parent: dict[int, int] = {}

    def find(node: int) -> int:
        while (above := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[above]
        return node

    for a, b in np.unique(edges, axis=0).tolist():
        one, other = find(a), find(b)
        parent[max(one, other)] = min(one, other)
    return np.array([(node, root) for node in list(parent) if (root := find(node)) != node], np.int64).reshape(-1, 2)


def stars_of_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of the edges of a partition, so many at a time."""
    kept, held = [np.zeros((0, 2), np.int64)], 0
    for batch in batches:
        kept.append(batch[["a", "b"]].to_numpy(np.int64))
        held += len(batch)
        if held >= EDGES:
            yield pd.DataFrame(stars(np.concatenate(kept)), columns=["a", "b"])
            kept, held = kept[:1], 0
    yield pd.DataFrame(stars(np.concatenate(kept)), columns=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node connected with it, for every node of the edges (a, b), a > b.

    A node that many lists connect with others comes with an edge from each of them. Edges are dealt by their larger ends
    first, where stars replace what meets: then there is about one edge for a node, however many lists it was in.
    Then rounds of two steps: every node hands its larger neighbours its smallest one, then its smaller ones. The number
    of rounds grows with the logarithm of a component's size. Each round is stored and read by the next.
    """
    dealt = edges.repartition("a").sortWithinPartitions("a")
    edges = stored(dealt.mapInPandas(stars_of_edges, "a bigint, b bigint").distinct(), "links")

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
        large = edges.join(both, "b").select("a", F.least("b", "least").alias("b"))
        smallest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(smallest, "a")
        own, other = (F.struct(F.col(node).alias("a"), F.col("least").alias("b")) for node in "ab")
        ends = F.when(F.col("b") == F.col("least"), F.array(own)).otherwise(F.array(own, other))
        edges = stored(small.select(F.inline(ends)).distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(prints: DataFrame) -> DataFrame:
    """``bits`` and ``component_id`` of every distinct fingerprint of ``prints`` (doc_id, bits), stored."""
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(links(distinct.select("bits")))
    rooted = distinct.join(roots, distinct["bits"] == roots["node"], "left").select(
        "bits", "first_id", F.coalesce("root", "bits").alias("root")
    )
    rooted = stored(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return stored(rooted.join(named, "root").select("bits", "component_id"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex digits) and ``component_id`` of every row."""
    prints = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("bits")), "prints")
    return prints.join(grouped(prints), "bits").select(
        "doc_id", hexadecimal(F.col("bits")).alias("fingerprint"), "component_id"
    )


def shingles(text: str, shingle_words: int = SIMILAR_WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles in ascending order; a shorter text is one shingle, one without words has none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    return np.unique(
        np.array([digest(joined[at:end], SEED) for at, end in zip(starts, ends[shingle_words - 1 :].tolist())], np.uint64)
    )


def common_shingles(numbered: DataFrame, row: str) -> np.ndarray:
    """Shingles that several of a bounded sample of documents have. They only set an order: no link depends on them."""

    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: shingles(text).view(np.int64))

    every = max(1, numbered.count() // SAMPLE)
    sample = numbered.where(F.pmod(F.xxhash64(row), F.lit(every)) == 0).select(hashes(text_of("text")).alias("h"))
    counts = sample.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 1")
    most = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toPandas()
    return np.sort(most["h"].to_numpy(np.int64).view(np.uint64))


def runs(batches: Iterator[pd.DataFrame], keys: list[str], least: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that come sorted by the keys, some ``least`` at a time and never a part of a group, with the starts of the groups."""

    def whole(kept: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        rows = pd.concat(kept, ignore_index=True)
        of = rows[keys].to_numpy(np.int64)
        return rows, np.concatenate(([0], np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1))

    kept, held = [], 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append(batch)
        held += len(batch)
        if held >= least:
            rows, starts = whole(kept)
            # The last group may go on in the next batch.
            if len(starts) > 1:
                yield rows.iloc[: starts[-1]], starts[:-1]
            kept, held = [rows.iloc[starts[-1] :]], len(rows) - int(starts[-1])
    if held:
        yield whole(kept)


def bits_of(rows: pd.DataFrame) -> np.ndarray:
    return rows[[f"bits{part}" for part in range(PARTS)]].to_numpy(np.int64)


def near(rows: dict[str, np.ndarray], x, y, tally: int) -> np.ndarray:
    """Whether rows x and y, listed together, can be similar by sizes, positions and fingerprints, and are not yet connected."""
    up, down = SIMILARITY
    n, m, i, j = rows["n"][x], rows["n"][y], rows["at"][x], rows["at"][y]
    most = np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1)
    differing = rows["bits"][x] ^ rows["bits"][y]
    can = (rows["root"][x] != rows["root"][y]) & (down * np.minimum(n, m) >= up * np.maximum(n, m))
    can &= (up + down) * most >= up * (n + m)
    can &= np.bitwise_count(differing.view(np.uint64)).sum(axis=-1, dtype=np.int64) <= ALL_BITS
    if tally:
        can &= (differing.view(np.uint8) == 0).sum(axis=-1) >= tally
    return can


def near_of_lists(tally: int):
    """Trees that connect what is near in the lists of a partition, whose rows come sorted by list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in runs(batches, ["key", "low", "high"], 50_000):
            rows = {name: frame[name].to_numpy(np.int64) for name in ("row", "n", "at", "root")} | {"bits": bits_of(frame)}
            lengths = np.diff(np.append(starts, len(frame)))
            edges = [np.zeros((0, 2), np.int64)]
            # All short lists at once: each row with the next, with the one after that, and so on.
            left = np.repeat(starts + lengths, lengths) - np.arange(len(frame))
            short = np.repeat(lengths <= SHORT_LIST, lengths)
            for step in range(1, SHORT_LIST):
                x = np.flatnonzero(short & (left > step))
                x = x[near(rows, x, x + step, tally)]
                edges.append(np.stack((rows["row"][x], rows["row"][x + step]), axis=1))
            for start, length in zip(starts[lengths > SHORT_LIST].tolist(), lengths[lengths > SHORT_LIST].tolist()):
                rest = np.arange(start, start + length)
                while len(rest) > 1:
                    frontier, rest = [rest[0]], rest[1:]
                    while frontier and len(rest):
                        at = frontier.pop()
                        found = near(rows, rest, at, tally)
                        reached, rest = rest[found], rest[~found]
                        frontier.extend(reached.tolist())
                        edges.append(np.stack((rows["row"][reached], np.full(len(reached), rows["row"][at])), axis=1))
            yield pd.DataFrame(stars(np.concatenate(edges)), columns=["a", "b"])

    return run


def similar_of_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trees that connect the similar texts of each unit of a partition, whose rows come sorted by unit."""
    up, down = SIMILARITY
    for frame, starts in runs(batches, ["place", "low", "high"], 1):
        found = [np.zeros((0, 2), np.int64)]
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)]):
            unit = frame.iloc[start:end]
            row, root, bits = unit["row"].to_numpy(np.int64), unit["root"].to_numpy(np.int64), bits_of(unit)
            sets = [shingles(text) for text in unit["text"]]
            n = np.array([len(one) for one in sets], np.int64)
            names, codes = np.unique(np.concatenate(sets), return_inverse=True)
            codes = np.split(codes, np.cumsum(n)[:-1])
            rest = np.arange(len(unit))
            while len(rest) > 1:
                frontier, rest = [rest[0]], rest[1:]
                while frontier and len(rest):
                    at = frontier.pop()
                    known = root[rest] == root[at]
                    least, most = np.minimum(n[rest], n[at]), np.maximum(n[rest], n[at])
                    differing = np.bitwise_count((bits[rest] ^ bits[at]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                    asked = np.flatnonzero(~known & (down * least >= up * most) & (differing <= ALL_BITS))
                    similar = known.copy()
                    if len(asked):
                        own = np.zeros(len(names), bool)
                        own[codes[at]] = True
                        others = [codes[other] for other in rest[asked]]
                        at_starts = np.cumsum([0, *map(len, others[:-1])])
                        shared = np.add.reduceat(own[np.concatenate(others)], at_starts, dtype=np.int64)
                        similar[asked] = down * shared >= up * (n[rest[asked]] + n[at] - shared)
                    reached, rest = rest[similar], rest[~similar]
                    frontier.extend(reached.tolist())
                    found.append(np.stack((row[reached], np.full(len(reached), row[at])), axis=1))
        yield pd.DataFrame(stars(np.concatenate(found)), columns=["a", "b"])


def in_units(rows: DataFrame, key: str, count: Column, size: int) -> DataFrame:
    """Rows of each key cut into tiles by a hash of ``row``, and dealt to the pairs of tiles: ``low``, ``high``. ``count``: of the key."""
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("tiles", F.ceil(count / size).cast("long"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")))
    others = F.when(F.col("tiles") == 1, F.array(zero)).otherwise(F.array_remove(F.sequence(zero, F.col("tiles") - 1), F.col("tile")))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("tiles", "tile", "other")
    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def similar_links(numbered: DataFrame, row: str, once: DataFrame) -> DataFrame:
    """Links (a, b), a > b, among the rows in ``once`` whose texts have a Jaccard similarity of SIMILARITY or more, enough to connect all of them.

    The index of fingerprints comes first. Of n shingles in any order that all texts share, two so similar texts have one in
    common among their first n - ceil(4 n / 5) + 1; rows are listed under these, in an order in which common shingles come
    last, and lists whose rows the index did not connect are compared as well.
    """
    common = common_shingles(numbered, row)
    up, down = SIMILARITY

    @F.pandas_udf("array<bigint>")
    def first(texts: pd.Series) -> pd.Series:
        def of(text: str) -> np.ndarray:
            found = shingles(text)
            if len(common):
                last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
                found = np.concatenate((found[~last], found[last]))
            # First come the size and the fingerprint.
            about = [np.uint64(len(found)), *(np.uint64(majority(hashes)) for hashes in remixed(found, PARTS))]
            return np.concatenate((about, found[: len(found) - -(-up * len(found) // down) + 1])).view(np.int64)

        return texts.map(of)

    listed = numbered.select(F.col(row).alias("row"), first(text_of("text")).alias("keys")).join(once, "row", "left_semi")
    listed = stored(listed.where(F.element_at("keys", 1) > 0), "listed")
    parts = {f"bits{part}": F.element_at("keys", part + 2) for part in range(PARTS)}
    prints = stored(
        listed.select("row", F.element_at("keys", 1).alias("n"), *(bits.alias(name) for name, bits in parts.items())), "similar-prints"
    )
    texts = numbered.select(F.col(row).alias("row"), text_of("text").alias("text"))

    def several(rows: DataFrame) -> DataFrame:
        return rows.withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1")

    def linked(lists: DataFrame, tally: int, name: str) -> DataFrame:
        # Fingerprints decide first: texts are dealt out for what they let through alone. Whatever pair of a list they let
        # through is in one neighbourhood, and all pairs of a neighbourhood that they let through are compared.
        units = in_units(lists, "key", F.col("members"), TILE)
        close = components(units.mapInPandas(near_of_lists(tally), "a bigint, b bigint"))
        close = close.select(F.col("node").alias("row"), F.col("root").alias("place"))
        close = stored(close.union(close.select(F.col("place").alias("row"), "place")).distinct(), "places")
        sizes = close.groupBy("place").agg(F.count("*").alias("members"))
        known = lists.select("row", "root").distinct()
        placed = close.join(sizes, "place").join(prints.drop("n"), "row").join(known, "row")
        dealt = in_units(placed.join(texts, "row"), "place", F.col("members"), UNIT_TEXTS)
        return stored(dealt.mapInPandas(similar_of_units, "a bigint, b bigint").distinct(), name)

    index = several(prints.select("row", F.explode(index_keys(F.col("bits0"))).alias("key")))
    index = stored(index.join(prints, "row").withColumns({"at": F.lit(0).cast("long"), "root": F.col("row")}), "index")
    links = linked(index, TALLY, "similar")
    roots = stored(components(links), "connected").withColumnRenamed("node", "row")
    lists = listed.select("row", F.posexplode(F.slice("keys", PARTS + 2, 1 << 30)).alias("at", "key"))
    named = stored(several(lists).join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "lists")
    apart = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    open_lists = stored(named.join(apart.select("key"), "key", "left_semi").join(prints, "row"), "open")
    return links.union(linked(open_lists, 0, "similar"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every group that links of similar texts connect, with its own columns: the one with the smallest id, of
    equal ids the first stored. Texts without words are copies of each other."""
    row, copy = unused(docs, "__row"), unused(docs, "__copy")

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        import xxhash

        return texts.map(lambda text: xxhash.xxh3_128_digest(shingles(text).tobytes(), SEED))

    numbered = stored(
        docs.withColumns({row: F.monotonically_increasing_id(), copy: digest(text_of("text"))}), "numbered"
    )
    # Nulls come last among ids.
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    # Copies take part once.
    copies = stored(numbered.groupBy(copy).agg(F.min(row).alias("node"), F.min(place).alias("place")), "copies")
    roots = components(similar_links(numbered, row, copies.select(F.col("node").alias("row"))))
    chosen = (
        copies.join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("place").alias("place"))
        .select(F.col("place.row").alias(row))
    )
    # The list grows with the documents, so it is merged with them at every size and never sent to them whole.
    return numbered.join(stored(chosen, "chosen").hint("merge"), row, "left_semi").select(*docs.columns)
