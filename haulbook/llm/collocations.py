"""Collocations of each language by best-first branch-and-bound growth from prefixes.

A phrase of two to four words with count a is scored at each cut into a first part counted l and a rest counted r, by
2,000,000 a / (l + r) rounded down; its lowest cut is its score. Phrases grow word by word. For a phrase q that starts with a
word w, no phrase that starts with q can score above 2,000,000 f(q) / (f(w) + f(q)): it occurs f(q) times at most, its rest after
w as often as itself at least, and the fraction grows with its count. These bounds never rise along a growing phrase.

The search goes best first. Words and pairs are counted; each language gets a threshold, the score of about its 2000th pair, and
the frontier of phrases whose bounds reach it is expanded: its extensions are counted, to three words and from there to four.
All phrases that score the threshold or more are then known. One is dropped if an extension by a single word, to the right or
the left, has four fifths of its count (if a longer phrase has, so has one a word longer), so extensions of such phrases to
either side are counted too. If 2000 of them survive, the language is settled, ties at the 2000th place included; else its
threshold falls, to zero in the end, and only what the frontier gained is expanded.

Counting runs over the texts in tasks: words of a run of texts are numbered by Arrow, phrases are counted in numpy and
leave the task as one row for each different one, which Spark sums. Whole sets of phrases never travel: what a
task should count is told by bitmaps of fixed size over hashes of phrases, built in Spark. A bitmap lets some others
through, with their full counts; these cost shuffle and change nothing. Joins of counts are Spark's own, on the phrase itself.

Defined results: null texts are empty; a null language is ``und``; repeated rows count each time; texts without words, or with
fewer words than a phrase has, add nothing but their words; fewer than ``top`` survivors are all returned; among equal scores the
higher count comes first, then the phrase by its UTF-8 bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulbook.llm.common import stored, text_of

#: Words of the longest phrase, the least count of a phrase, and phrases returned of each language.
LONGEST, LEAST, TOP = 4, 30, 2000

#: A phrase goes if a longer one that holds it has this share of its count.
SHARE = (4, 5)

#: Bytes of text whose phrases are counted together, and bits of a bitmap. Results depend on neither.
RUN_BYTES, BITMAP_BITS = 1 << 23, 1 << 26

#: What each byte counts as: lower case, the byte that parts pieces, or the one between words.
BREAK, GAP = 0x0A, 0x20
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[65:91] += 32
CLASSES[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
CLASSES[0x09] = GAP


def word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(word) for word in words), np.uint64, len(words))


def joined_hash(start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its start and its last word."""
    mixed = (start ^ (start >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + last
    return mixed ^ (mixed >> np.uint64(32))


def bit_numbers(langs: pd.Series, phrases: pd.Series) -> pd.Series:
    """Bits of phrases in a bitmap, counted from one; the language is a phrase's first word, as it were."""
    split = [[lang.encode(), *phrase.encode().split(b" ")] for lang, phrase in zip(langs, phrases)]
    counts = np.array([len(words) for words in split], np.int64)
    flat = word_hash([word for words in split for word in words])
    starts = np.cumsum(counts) - counts
    hashes = flat[starts]
    for at in range(1, int(counts.max(initial=0))):
        longer = counts > at
        hashes[longer] = joined_hash(hashes[longer], flat[starts[longer] + at])
    return pd.Series((hashes % np.uint64(BITMAP_BITS)).astype(np.int64) + 1)


def bitmap(phrases: DataFrame) -> Broadcast:
    """The bitmap of some phrases (lang, phrase): BITMAP_BITS / 8 bytes, however many there are."""
    bits = phrases.select(F.pandas_udf(bit_numbers, "long")("lang", "phrase").alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bytes")
    )
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for bucket, part in parts.collect():
        data = np.frombuffer(bytes(part), np.uint8)[: len(out)]
        out[(bucket - 1) * len(data) : bucket * len(data)] = data
    return phrases.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(8 * len(bits))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


@dataclass(frozen=True)
class Wanted:
    """What a task counts: phrases of ``size`` words that extend one of ``prefixes`` to the right or one of ``suffixes`` to the left
    (all phrases without either), and of which all parts of ``part`` words are in ``frequent``."""

    size: int
    prefixes: Broadcast | None = None
    suffixes: Broadcast | None = None
    part: int = 0
    frequent: Broadcast | None = None


def runs(texts: pa.Array) -> Iterator[np.ndarray]:
    """The texts as classes of bytes, cut between pieces into runs of about RUN_BYTES."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), b"\n")
    whole = CLASSES[np.frombuffer(joined[0].as_buffer(), np.uint8)]
    start = 0
    while start < len(whole):
        end = start + RUN_BYTES
        if end < len(whole):
            breaks = np.flatnonzero(whole[start:end] == BREAK)
            while not len(breaks) and end < len(whole):
                breaks = np.flatnonzero(whole[end : end + RUN_BYTES] == BREAK) + end - start
                end += RUN_BYTES
            end = start + int(breaks[-1]) + 1 if len(breaks) else len(whole)
        yield whole[start:end]
        start = end


class Words:
    """The words of a run in order: ``code``, number of each in ``known``; ``piece``, number of the piece it stands in."""

    def __init__(self, classes: np.ndarray, lang: str):
        breaks = classes == BREAK
        inside = ~(breaks | (classes == GAP))
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, ends = edges[0::2], edges[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        values = pa.py_buffer(np.ascontiguousarray(classes[inside]))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), values]).dictionary_encode()
        self.known, self.code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(breaks, dtype=np.int32)[starts]
        hashes = word_hash(self.known.to_pylist())
        first = joined_hash(word_hash([lang.encode()])[:1], hashes) if len(hashes) else hashes
        #: Hashes of the phrases of one, two ... words that start at each word (the last ones run over pieces; never asked for).
        self.hashes = [first[self.code]]
        self.own = hashes[self.code]

    def phrase_hashes(self, size: int) -> np.ndarray:
        while len(self.hashes) < size:
            longer = self.hashes[-1][:-1]
            self.hashes.append(joined_hash(longer, self.own[len(self.own) - len(longer) :]))
        return self.hashes[size - 1]

    def counts(self, wanted: Wanted) -> tuple[pa.Array, np.ndarray]:
        """The different phrases wanted, and how often each occurs."""
        size, count = wanted.size, len(self.code) - wanted.size + 1
        if count <= 0:
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        kept = self.piece[:count] == self.piece[size - 1 :]
        if wanted.frequent is not None:
            good = in_bitmap(wanted.frequent.value, self.phrase_hashes(wanted.part))
            for shift in range(size - wanted.part + 1):
                kept &= good[shift : shift + count]
        if wanted.prefixes is not None or wanted.suffixes is not None:
            hashes = self.phrase_hashes(size - 1)
            extends = np.zeros(count, bool)
            if wanted.prefixes is not None:
                extends |= in_bitmap(wanted.prefixes.value, hashes[:count])
            if wanted.suffixes is not None:
                extends |= in_bitmap(wanted.suffixes.value, hashes[1 : count + 1])
            kept &= extends
        at = np.flatnonzero(kept)
        # Phrases are numbered word by word, so that numbers never leave 64 bits.
        number = self.code[at]
        for shift in range(1, size):
            number = number * len(self.known) + self.code[at + shift]
            if shift < size - 1:
                number = np.unique(number, return_inverse=True)[1]
        _, first, times = np.unique(number, return_index=True, return_counts=True)
        words = [self.known.take(pa.array(self.code[at[first] + shift])) for shift in range(size)]
        phrases = pc.binary_join_element_wise(*words, b" ") if size > 1 else words[0]
        return phrases.cast(pa.string()), times.astype(np.int64)


def counting(wanted: list[Wanted]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of wanted phrases in a partition's texts (lang, text), run by run."""

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for lang in pc.unique(table["lang"]).to_pylist():
            texts = table.filter(pc.equal(table["lang"], lang))["text"].combine_chunks().cast(pa.binary())
            for run in runs(pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts):
                words = Words(run, lang)
                for one in wanted:
                    phrases, times = words.counts(one)
                    yield from pa.table({
                        "lang": pa.repeat(pa.scalar(lang), len(phrases)),
                        "size": pa.array(np.full(len(phrases), one.size, np.int32)),
                        "phrase": phrases,
                        "f": pa.array(times),
                    }).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            kept.append(batch)
            held += batch.nbytes
            if held >= RUN_BYTES:
                yield from counted(pa.Table.from_batches(kept))
                kept, held = [], 0
        if kept:
            yield from counted(pa.Table.from_batches(kept))

    return run


def counts(docs: DataFrame, *wanted: Wanted, least: int) -> DataFrame:
    """``lang``, ``size``, ``phrase`` and ``f``, its count, of wanted phrases that occur ``least`` times or more, stored."""
    found = docs.mapInArrow(counting(list(wanted)), "lang string, size int, phrase string, f long")
    total = found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    out = stored(total.where(F.col("f") >= least), "counts")
    for one in wanted:
        for sent in (one.prefixes, one.suffixes):
            if sent is not None:
                sent.unpersist()
    return out


def start_of(size: int):
    """All words of a phrase but the last, and all but the first."""
    return F.substring_index("phrase", " ", size - 1), F.substring_index("phrase", " ", 1 - size)


def ratio(f: str, *others: str):
    """2,000,000 f / (sum of the others), rounded down, in decimals that hold any count."""
    below = " + ".join(f"cast({other} as decimal(19, 0))" for other in others)
    return F.expr(f"cast(2000000 * cast({f} as decimal(19, 0)) div ({below}) as bigint)")


def scored(phrases: DataFrame, size: int, known: DataFrame) -> DataFrame:
    """Phrases of ``size`` words with the ``score`` and the counts ``l`` and ``r`` of their lowest cut, and ``bound``, which no phrase
    that starts with them exceeds. ``known``: all counts; phrases with a part that is not among them are left out."""
    parts = [
        F.struct(F.lit(f"{side}{cut}").alias("name"), F.substring_index("phrase", " ", words).alias("part"))
        for cut in range(1, size)
        for side, words in (("l", cut), ("r", cut - size))
    ]
    split = phrases.select("lang", "phrase", "f", F.explode(F.array(*parts)).alias("x")).select("lang", "phrase", "f", "x.*")
    counted = split.join(known.select("lang", F.col("phrase").alias("part"), F.col("f").alias("its")), ["lang", "part"])
    names = [f"{side}{cut}" for cut in range(1, size) for side in "lr"]
    whole = counted.groupBy("lang", "phrase", "f").agg(
        F.count("*").alias("found"), *[F.max(F.when(F.col("name") == name, F.col("its"))).alias(name) for name in names]
    ).where(F.col("found") == len(names))
    cuts = [
        F.struct(ratio("f", f"l{cut}", f"r{cut}").alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r"))
        for cut in range(1, size)
    ]
    return whole.select(
        "lang", "phrase", "f", ratio("f", "l1", "f").alias("bound"), F.array_min(F.array(*cuts)).alias("low")
    ).select("lang", "phrase", "f", "bound", "low.score", "low.l", "low.r")


def band(phrases: DataFrame, thresholds: DataFrame, value: str) -> DataFrame:
    """Phrases whose ``value`` reaches their language's threshold now and did not before."""
    return phrases.join(thresholds, "lang").where(
        (F.col(value) >= F.col("now")) & (F.col("before").isNull() | (F.col(value) < F.col("before")))
    ).select("lang", "phrase", "f")


def lowered(thresholds: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """Thresholds of languages that are not settled brought down to the score of the pair at this rank, or to zero."""
    place = Window.partitionBy("lang").orderBy(F.col("score").desc())
    at = pairs.select("lang", "score").withColumn("place", F.row_number().over(place)).where(F.col("place") <= depth)
    lowest = at.groupBy("lang").agg(F.min("score").alias("lowest"), F.count("*").alias("n"))
    next_one = F.when(F.col("n") == depth, F.col("lowest")).otherwise(0).cast("long")
    return thresholds.join(lowest, "lang", "left").select(
        "lang", F.col("now").alias("before"), F.when(F.col("settled"), F.col("now")).otherwise(next_one).alias("now"), "settled"
    )


def surviving(by_size: dict[int, DataFrame], extensions: dict[int, DataFrame], thresholds: DataFrame) -> DataFrame:
    """Phrases that reach their thresholds and have no extension with SHARE of their count or more."""
    out = None
    for size, phrases in by_size.items():
        good = phrases.join(thresholds.select("lang", "now"), "lang").where(F.col("score") >= F.col("now")).drop("now")
        if size in extensions:
            start, rest = start_of(size + 1)
            longer = extensions[size].select("lang", F.explode(F.array(start, rest)).alias("phrase"), "f")
            longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
            up, down = (F.lit(number).cast("decimal(2, 0)") for number in SHARE)
            good = good.join(longer, ["lang", "phrase"], "left").where(
                F.col("longer").isNull() | (down * F.col("longer") < up * F.col("f"))
            ).drop("longer")
        out = good if out is None else out.unionByName(good)
    return out


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's best ``top`` collocations."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of("text").alias("text"))
    every_word = counts(texts, Wanted(1), least=1)
    totals = stored(every_word.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = every_word.where(F.col("f") >= least)
    pairs = counts(texts, Wanted(2, part=1, frequent=bitmap(words)), least=least)
    frequent = bitmap(pairs)
    pair_nodes = stored(scored(pairs, 2, words), "pairs")
    triples = quads = pairs.limit(0)
    thresholds = totals.select("lang", F.lit(None).cast("long").alias("now"), F.lit(False).alias("settled"))
    depth = top + top // 2
    while True:
        thresholds = stored(lowered(thresholds, pair_nodes, depth), "thresholds")
        depth *= 4
        found = counts(
            texts,
            Wanted(3, bitmap(band(pair_nodes, thresholds, "bound")), bitmap(band(pair_nodes, thresholds, "score")), 2, frequent),
            least=least,
        )
        triples = triples.union(found).distinct()
        nodes = stored(scored(triples, 3, words.union(pairs)), "triples")
        frontier = band(nodes, thresholds, "bound")
        # A phrase of four words is scored by what follows its first word too.
        rests = frontier.select("lang", start_of(3)[1].alias("phrase")).distinct()
        found = counts(
            texts,
            Wanted(4, bitmap(frontier), bitmap(band(nodes, thresholds, "score")), 2, frequent),
            Wanted(3, bitmap(rests), None, 2, frequent),
            least=least,
        )
        quads = stored(quads.union(found.where("size = 4")).distinct(), "quads")
        triples = stored(triples.union(found.where("size = 3")).distinct(), "triples")
        quad_nodes = scored(quads, 4, words.union(pairs).union(triples))
        left = stored(surviving({2: pair_nodes, 3: nodes, 4: quad_nodes}, {2: triples, 3: quads}, thresholds), "surviving")
        enough = left.groupBy("lang").agg(F.count("*").alias("survivors"))
        thresholds = stored(
            thresholds.join(enough, "lang", "left").select(
                "lang", "now", ((F.col("now") == 0) | (F.coalesce("survivors", F.lit(0)) >= top)).alias("settled")
            ),
            "thresholds",
        )
        if thresholds.where("not settled").isEmpty():
            break
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("f").desc(), "phrase")
    # Compared as it is, so that Spark limits each task's rows before it shuffles them.
    ranked = left.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
