"""Language model by context-tree weighting over bytes.

A text is read as its lower-cased words, one space apart, and an end mark. Each byte is eight binary decisions, each made
by the node of the byte's leading bits in the tree of one context; contexts are the last 0 to 5 bytes. A node's own
estimate is Krichevsky and Trofimov's from its counts of zeros and ones; weighting mixes it half and half with the product
of its children's, all the way from the longest context to none. With fixed counts the weights of all depths are fixed
too, so a byte in its context has one probability, and a text's score is the sum of their logarithms. A node that
training never met has no say: the mixture starts at the deepest one met.

Nothing that grows with the corpus is held in one place. Documents form runs of a few megabytes. A run is asked for its
distinct strings of six bytes and its distinct words, with their counts; these go to buckets (strings by their two
nearest context bytes, so that a bucket holds whole subtrees; words by hash), which add them up and answer every run with the
probabilities and counts it asked for, and the run scores its own documents. Only the contexts of one byte and of none
reach the driver, 65,536 nodes at most.

Defined results: a null or empty text has the end mark alone; a null id is held out; texts of any length are read whole;
repeated rows are scored, and learned from, each; an empty table gives an empty result, a table without training rows
the probability 1/2 for every bit; other columns are not read. Words are told apart by 63 bits of XXH64.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import LOWER, stored, text_of

DEPTH = 5
END = b"\xff"

#: Bytes of a run, and distinct keys of all runs that a bucket receives on average.
RUN_BYTES, BUCKET_KEYS = 10 << 20, 1 << 20

LOG_HALF = float(np.log(0.5))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive numbers: Stirling's series after eight steps up."""
    product = np.ones_like(x)
    for step in range(8):
        product *= np.minimum(x, 1e30) + step
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(product)


#: Small counts, which are nearly all, find their logarithms in tables: of the gamma function at n + 1/2 and at n + 1.
SMALL = 1 << 14
AT_HALF, AT_ONE = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the probability that Krichevsky and Trofimov give to a sequence with these counts."""
    both = zeros + ones
    small = np.minimum(both, SMALL - 1).astype(np.int64)
    whole = AT_HALF[np.minimum(zeros, small).astype(np.int64)] + AT_HALF[np.minimum(ones, small).astype(np.int64)]
    whole -= AT_ONE[small] + np.log(np.pi)
    large = np.nonzero(both >= SMALL)
    if len(large[0]):
        zeros, ones = zeros[large], ones[large]
        whole[large] = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)
    return np.where(both > 0, whole, 0.0)


def mixed(estimate: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability, and the weight that a node's own estimate has after all it has seen."""
    weighted = LOG_HALF + np.logaddexp(estimate, below)
    return weighted, np.exp(LOG_HALF + estimate - weighted)


class Run:
    """The texts of a run as one array of bytes, with the strings of six bytes that end at each."""

    def __init__(self, texts: list[str]):
        words = [(text or "").encode("utf-8", "surrogatepass").translate(LOWER).split() for text in texts]
        self.words = words
        lines = [b" ".join(line) + END for line in words]
        pad = END * DEPTH
        data = np.frombuffer(pad + pad.join(lines), np.uint8)
        sizes = np.array([len(line) for line in lines], np.int64)
        self.sizes = sizes
        keys = data[DEPTH:].astype(np.int64)
        # Nearest context byte first, so that equal near contexts stand together.
        for back in range(1, DEPTH + 1):
            keys += data[DEPTH - back : len(data) - back].astype(np.int64) << (8 * (DEPTH + 1 - back))
        starts = np.concatenate(([0], np.cumsum(sizes + DEPTH)[:-1])).astype(np.int64)
        inside = np.zeros(len(keys) + 1, np.int8)
        inside[starts] += 1
        np.add.at(inside, starts + sizes, -1)
        self.keys = keys[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)

    def strings(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, and how often each occurs in the documents to learn from."""
        # One sort does for both: the last bit says whether a key is only asked for.
        keys = np.sort(self.keys << 1 | np.repeat(~train, self.sizes))
        learned = 1 - (keys & 1)
        keys >>= 1
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(learned, first)

    def vocabulary(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Distinct words' keys, ascending, their counts in the documents to learn from, and the words in that order."""
        words = Counter(chain.from_iterable(line for line, learns in zip(self.words, train) if learns))
        for word in set(chain.from_iterable(line for line, learns in zip(self.words, train) if not learns)):
            if word not in words:
                words[word] = 0
        names = list(words)
        keys = word_keys(names)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.fromiter(words.values(), np.int64, len(words))[order], [names[at] for at in order.tolist()]


def places_in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among sorted distinct ones, which hold them all: by a hash table, and by search where it clashes."""
    bits = max(4, int(len(sorted_keys)).bit_length() + 2)
    factor, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    table = np.zeros(1 << bits, np.int32)
    table[(sorted_keys.view(np.uint64) * factor >> shift).view(np.int64)] = np.arange(len(sorted_keys), dtype=np.int32)
    found = table[(keys.view(np.uint64) * factor >> shift).view(np.int64)]
    clash = np.flatnonzero(sorted_keys[found] != keys)
    found[clash] = np.searchsorted(sorted_keys, keys[clash])
    return found


def word_keys(words) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(word) >> 1 for word in words), np.int64, len(words))


def bucket_of_strings(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> 8 * (DEPTH - 1)) * 40503 >> 4) % buckets


def bucket_of_words(keys: np.ndarray, buckets: int) -> np.ndarray:
    return buckets + keys % buckets


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return zlib.compress(np.diff(keys, prepend=0).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int64))


def squeezed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def spread(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype)


def dealt(keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers, and the places of their keys in ascending order of the keys. Keys come sorted."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for start, end in zip(bounds, np.append(bounds[1:], len(order))):
        yield int(bucket[order[start]]), order[start:end]


CELL = "bucket int, chunk long, run long, keys binary, counts binary"


def cells(buckets: int):
    """What the runs of a partition ask for, a row for each run and bucket."""

    def of_run(chunk: int, start: int, texts: list[str], held: list[bool]) -> Iterator[tuple]:
        whole, train = Run(texts), ~np.array(held, bool)
        strings, counts = whole.strings(train)
        keys, times, _ = whole.vocabulary(train)
        for bucket, at in dealt(strings, bucket_of_strings(strings, buckets)):
            yield bucket, chunk, start, packed(strings[at]), squeezed(counts[at].astype(np.int32))
        for bucket, at in dealt(keys, bucket_of_words(keys, buckets)):
            yield bucket, chunk, start, packed(keys[at]), squeezed(times[at].astype(np.int32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, texts, held = None, 0, [], []
        columns = [field.split()[0] for field in CELL.split(", ")]
        for batch in batches:
            for chunk, row, text, out in zip(batch["chunk"], batch["row"], batch["text"], batch["held_out"]):
                if chunk != now:
                    if texts:
                        yield pd.DataFrame(of_run(now, start, texts, held), columns=columns)
                    now, start, texts, held = chunk, row, [], []
                texts.append(text)
                held.append(out)
        if texts:
            yield pd.DataFrame(of_run(now, start, texts, held), columns=columns)

    return run


def added_up(cell: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a bucket, their counts, and for each row the keys it asks for."""
    asked_for = [unpacked(data) for data in cell["keys"]]
    distinct = np.sort(np.concatenate(asked_for))
    distinct = distinct[np.diff(distinct, prepend=-1) != 0]
    counts = np.zeros(len(distinct))
    for keys, data in zip(asked_for, cell["counts"]):
        counts[np.searchsorted(distinct, keys)] += spread(data, np.int32)
    return distinct, counts, asked_for


class Level(NamedTuple):
    """The nodes of one depth: for each node of the deepest level its place here, then what belongs to the nodes."""

    place: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weight: np.ndarray
    weighted: np.ndarray


def nodes(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, list[Level], np.ndarray]:
    """Of one of the eight decisions: each key's bit and its place among the deepest nodes, the levels from there to
    depth 2, and a key of each node of depth 2.

    Keys are distinct and ascending, so the deepest nodes are too; each further level is made from the one below.
    """
    byte = keys & 255
    one = (byte >> (7 - bit)) & 1
    name = keys - byte | 1 << bit | byte >> (8 - bit)
    new = np.diff(name, prepend=-1) != 0
    inside = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    name = name[first]
    ones = np.bincount(inside, counts * one, len(name))
    zeros = np.bincount(inside, counts, len(name)) - ones
    place = np.arange(len(name))
    weighted = log_estimate(zeros, ones)
    levels = [Level(place, zeros, ones, np.ones(len(name)), weighted)]
    for _ in range(DEPTH - 2):
        # The farthest byte of the context goes.
        name, index, up = np.unique((name >> 16 << 8) | (name & 255), return_index=True, return_inverse=True)
        first, place = first[index], up[place]
        zeros, ones = np.bincount(up, zeros, len(name)), np.bincount(up, ones, len(name))
        weighted, weight = mixed(log_estimate(zeros, ones), np.bincount(up, weighted, len(name)))
        levels.append(Level(place, zeros, ones, weight, weighted))
    return one, inside, levels, keys[first]


def summaries(buckets: int):
    """What a bucket adds to the upper contexts (kind 0: by nearest byte and node) and to the vocabulary (kind 1)."""

    def over(cell: pd.DataFrame) -> pd.DataFrame:
        keys, counts, _ = added_up(cell)
        if cell["bucket"].iloc[0] >= buckets:
            rows = [(1, 0, 0, float((counts > 0).sum()), float(counts.sum()), 0.0)]
        else:
            rows = []
            for bit in range(8):
                _, _, levels, some = nodes(keys, counts, bit)
                last = levels[-1]
                node = (1 << bit) | ((some & 255) >> (8 - bit))
                name, place = np.unique(some >> 8 * DEPTH << 8 | node, return_inverse=True)
                sums = [np.bincount(place, values, len(name)) for values in (last.weighted, last.zeros, last.ones)]
                rows += list(zip([0] * len(name), (name >> 8).tolist(), (name & 255).tolist(), *map(np.ndarray.tolist, sums)))
        return pd.DataFrame(rows, columns=["kind", "nearest", "node", "x", "y", "z"])

    return over


class Upper:
    """Contexts of one byte and of none: 256 x 256 arrays by nearest byte and node, and 256 by node."""

    def __init__(self, rows: list[tuple[int, int, float, float, float]]):
        below, self.zeros, self.ones = (np.zeros((256, 256)) for _ in range(3))
        for nearest, node, weighted, zeros, ones in rows:
            below[nearest, node], self.zeros[nearest, node], self.ones[nearest, node] = weighted, zeros, ones
        weighted, self.weight = mixed(log_estimate(self.zeros, self.ones), below)
        self.root_zeros, self.root_ones = self.zeros.sum(axis=0), self.ones.sum(axis=0)
        _, self.root_weight = mixed(log_estimate(self.root_zeros, self.root_ones), weighted.sum(axis=0))

    def log10(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte after the others."""
        whole = np.ones(len(keys))
        for bit in range(8):
            one, inside, levels, _ = nodes(keys, counts, bit)
            # The chance of a one is worked out once for each of the deepest nodes.
            deepest = keys[np.flatnonzero(np.diff(inside, prepend=-1))]
            nearest, node = deepest >> 8 * DEPTH, (1 << bit) | ((deepest & 255) >> (8 - bit))
            steps = [(level.zeros[level.place], level.ones[level.place], level.weight[level.place]) for level in levels]
            steps.append((self.zeros[nearest, node], self.ones[nearest, node], self.weight[nearest, node]))
            steps.append((self.root_zeros[node], self.root_ones[node], self.root_weight[node]))
            chance = np.full(len(deepest), np.nan)
            for zeros, ones, weight in steps:
                own = (ones + 0.5) / (zeros + ones + 1.0)
                mixture = np.where(np.isnan(chance), own, weight * own + (1 - weight) * chance)
                chance = np.where(zeros + ones > 0, mixture, chance)
            chance = np.where(np.isnan(chance), 0.5, chance)[inside]
            whole *= np.where(one == 1, chance, 1 - chance)
        return np.log10(whole)


ANSWER = "chunk long, run long, bucket int, answers binary"


def answers(buckets: int, upper: Upper):
    """For every run that asked a bucket: float32 log-probabilities of its strings or int32 counts of its words."""

    def over(cell: pd.DataFrame) -> pd.DataFrame:
        keys, counts, asked_for = added_up(cell)
        words = cell["bucket"].iloc[0] >= buckets
        values = counts.astype(np.int32) if words else upper.log10(keys, counts).astype(np.float32)
        parts = [squeezed(values[np.searchsorted(keys, own)]) for own in asked_for]
        return pd.DataFrame({"chunk": cell["chunk"], "run": cell["run"], "bucket": cell["bucket"], "answers": parts})

    return over


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "bits_per_byte double"
)


def scored(buckets: int, train_tokens: int, vocabulary: int, train_rows: int):
    """Scores of a chunk's documents from the answers to its runs."""
    whole = np.log10(train_tokens + 0.1 * (vocabulary + 1))

    def chance(counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 0.1) - whole

    end = float(chance(np.array([train_rows]))[0])

    def of_run(rows: pd.DataFrame, answer: dict[int, bytes]) -> pd.DataFrame:
        run = Run(rows["text"].tolist())
        train = np.ones(len(rows), bool)
        (strings, _), (keys, _, names) = run.strings(train), run.vocabulary(train)
        logs, counts = np.zeros(len(strings), np.float64), np.zeros(len(keys), np.int64)
        for bucket, at in dealt(strings, bucket_of_strings(strings, buckets)):
            logs[at] = spread(answer[bucket], np.float32)
        for bucket, at in dealt(keys, bucket_of_words(keys, buckets)):
            counts[at] = spread(answer[bucket], np.int32)
        score = np.add.reduceat(logs[places_in(strings, run.keys)], run.starts)
        place = dict(zip(names, range(len(names))))
        flat = np.fromiter(map(place.__getitem__, chain.from_iterable(run.words)), np.int64)
        document = np.repeat(np.arange(len(rows)), [len(line) for line in run.words])
        base = np.bincount(document, chance(counts)[flat], len(rows)) + end
        known = np.bincount(document, counts[flat] > 0, len(rows)) + (train_rows > 0)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"],
                "held_out": rows["held_out"],
                "n_tokens": [len(line) + 1 for line in run.words],
                "n_known": known.astype(np.int64),
                "train_tokens": train_tokens,
                "base_score": base,
                "score": score,
                "bits_per_byte": -score * np.log2(10) / run.sizes,
            }
        )

    def over(rows: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable").reset_index(drop=True)
        starts = np.sort(answered["run"].unique())
        belongs = np.searchsorted(starts, rows["row"].to_numpy(), side="right") - 1
        by_run: list[dict[int, bytes]] = [{} for _ in starts]
        for run, bucket, answer in zip(answered["run"], answered["bucket"], answered["answers"]):
            by_run[int(np.searchsorted(starts, run))][bucket] = answer
        return pd.concat(
            [of_run(rows[belongs == at].reset_index(drop=True), by_run[at]) for at in np.unique(belongs).tolist()],
            ignore_index=True,
        )

    return over


def held_out(doc_id: Column) -> Column:
    """One id in ten, by the checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def score_documents(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Base and model score of every document, learned from those that are not held out."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of("text").alias("text")
    )
    size, count, train_rows = rows.agg(
        F.sum(F.octet_length("text") + 1), F.count("*"), F.count(F.when(~F.col("held_out"), 1))
    ).first()
    if not count:
        return spark.createDataFrame([], SCORED)
    per_run = max(1, int(run_bytes * count / size))
    number = F.monotonically_increasing_id()
    chunk = F.shiftleft(F.shiftright(number, 33), 33) + F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / per_run)
    rows = stored(rows.withColumn("row", number).withColumn("chunk", chunk), "texts")
    buckets = max(1, int(size / 20 / BUCKET_KEYS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1000))
    # Cheaper to find again for the second pass than to store.
    asked_for = rows.select("chunk", "row", "text", "held_out").mapInPandas(cells(buckets), CELL)
    sums = (
        asked_for.groupBy("bucket")
        .applyInPandas(summaries(buckets), "kind int, nearest int, node int, x double, y double, z double")
        .groupBy("kind", "nearest", "node")
        .agg(F.sum("x"), F.sum("y"), F.sum("z"))
        .collect()
    )
    upper = Upper([tuple(row)[1:] for row in sums if row["kind"] == 0])
    words = [tuple(row) for row in sums if row["kind"] == 1]
    vocabulary = int(words[0][3]) if words else 0
    train_tokens = (int(words[0][4]) if words else 0) + train_rows
    answered = asked_for.groupBy("bucket").applyInPandas(answers(buckets, upper), ANSWER)
    return (
        rows.groupBy("chunk")
        .cogroup(answered.groupBy("chunk"))
        .applyInPandas(scored(buckets, train_tokens, vocabulary + (train_rows > 0), train_rows), SCORED)
    )
