"""Quality of documents by attention over their passages (multiple-instance learning).

A document is a bag of passages of a hundred words. Each passage is described by what its characters and words are like and
by hashed pairs of bytes, and encoded by a small network. A second, gated network gives every passage an attention
weight; the weighted mean of the encodings is the document's representation, from which its score follows. Only documents
carry labels: which passages matter is learned from them.

The network is fitted on a bounded sample of labelled documents (``MAX_BAGS`` of them, chosen by a hash of the id, with at most
``MAX_TRAIN_PASSAGES`` passages each, evenly spaced); scoring reads every passage of every document.

Defined results: null and empty texts are one passage without words; texts of any length are read whole; a document
with several labels counts with the lowest; without labels every score is one half; repeated rows are scored each; an
empty table gives an empty result; other columns pass through, and columns of theirs called like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import text_of

PASSAGE_WORDS = 100

#: The sample that the network is fitted on: documents, and passages of each.
MAX_BAGS, MAX_TRAIN_PASSAGES = 4000, 32

PAIRS = 64
ENCODED, GATES = 24, 12
EPOCHS, RATE, DECAY, SEED = 250, 0.02, 1e-4, 42

#: Kinds of bytes that are counted: capitals, small letters, digits, beyond ASCII, and marks by themselves or in groups.
KINDS = ("upper", "lower", "digit", "other", "!?", "|", "*#$%&@", ",;:", ".", "()[]{}<>=/\\")


def kinds_of_bytes() -> np.ndarray:
    table = np.full(256, len(KINDS), np.int64)
    table[65:91], table[97:123], table[48:58], table[128:] = 0, 1, 2, 3
    for number, marks in enumerate(KINDS[4:], 4):
        for mark in marks:
            table[ord(mark)] = number
    return table


KIND_OF = kinds_of_bytes()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages, and the number of passages of each text."""
    passages: list[list[bytes]] = []
    counts, repeats = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        parts = [words[at : at + PASSAGE_WORDS] for at in range(0, len(words), PASSAGE_WORDS)] or [[]]
        # A short rest says little by itself.
        if len(parts) > 1 and len(parts[-1]) < PASSAGE_WORDS // 4:
            rest = parts.pop()
            parts[-1] = parts[-1] + rest
        counts.append(len(parts))
        passages += parts
        repeats += [sum(map(bytes.__eq__, part, part[1:])) for part in parts]
    lines = [b" ".join(part) + b" " for part in passages]
    sizes = np.array([len(line) for line in lines])
    data = np.frombuffer(b"".join(lines), np.uint8)
    owner = np.repeat(np.arange(len(lines)), sizes)
    kinds = len(KINDS) + 1
    kind = np.bincount(owner * kinds + KIND_OF[data], minlength=len(lines) * kinds).reshape(-1, kinds)
    wide = data.astype(np.int64)
    pair = (wide[:-1] * 40503 + wide[1:] * 30011 >> 5) % PAIRS
    pairs = np.bincount(owner[:-1] * PAIRS + pair, minlength=len(lines) * PAIRS).reshape(-1, PAIRS)
    words = np.array([len(part) for part in passages])
    distinct = np.array([len(set(part)) for part in passages])
    some = np.maximum(words, 1)
    own = [
        np.log1p(words),
        (sizes - words) / some,
        distinct / some,
        np.array(repeats) / some,
    ]
    per_byte = kind[:, : len(KINDS)] / np.maximum(sizes, 1)[:, None]
    per_word = np.log1p(10 * kind[:, 4 : len(KINDS)] / some[:, None])
    mix = np.sqrt(pairs / np.maximum(sizes, 1)[:, None])
    return np.column_stack([*own, per_byte, per_word, mix]), np.array(counts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


class Network:
    """Encoder, gated attention and classifier, fitted by gradient descent on the labels of bags."""

    def __init__(self, passages: np.ndarray, counts: np.ndarray, labels: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.scale = passages.mean(axis=0), passages.std(axis=0) + 1e-3
        width = passages.shape[1]
        self.weights = {
            "encode": random.normal(0, 1 / np.sqrt(width), (width, ENCODED)),
            "shift": np.zeros(ENCODED),
            "gate": random.normal(0, 1 / np.sqrt(ENCODED), (ENCODED, GATES)),
            "open": random.normal(0, 1 / np.sqrt(ENCODED), (ENCODED, GATES)),
            "attend": random.normal(0, 1 / np.sqrt(GATES), GATES),
            "judge": random.normal(0, 1 / np.sqrt(ENCODED), ENCODED),
            "prior": np.zeros(1),
        }
        self.fit(self.scaled(passages), counts, labels.astype(float))

    def scaled(self, passages: np.ndarray) -> np.ndarray:
        return np.clip((passages - self.mean) / self.scale, -8, 8)

    def forward(self, passages: np.ndarray, counts: np.ndarray) -> tuple:
        w = self.weights
        starts = np.cumsum(counts) - counts
        encoded = np.maximum(passages @ w["encode"] + w["shift"], 0)
        gate, opened = np.tanh(encoded @ w["gate"]), 1 / (1 + np.exp(-(encoded @ w["open"])))
        level = (gate * opened) @ w["attend"]
        level = np.exp(level - np.repeat(np.maximum.reduceat(level, starts), counts))
        attention = level / np.repeat(sums(level, starts), counts)
        bag = sums(attention[:, None] * encoded, starts)
        chance = 1 / (1 + np.exp(-np.clip(bag @ w["judge"] + w["prior"], -40, 40)))
        return starts, encoded, gate, opened, attention, bag, chance

    def gradients(self, passages: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts, encoded, gate, opened, attention, bag, chance = self.forward(passages, counts)
        error = (chance - labels) / len(labels)
        to_bag = np.repeat(error[:, None] * w["judge"], counts, axis=0)
        to_attention = (encoded * to_bag).sum(axis=1)
        to_level = attention * (to_attention - np.repeat(sums(attention * to_attention, starts), counts))
        to_product = to_level[:, None] * w["attend"]
        to_gate, to_open = to_product * opened * (1 - gate**2), to_product * gate * opened * (1 - opened)
        to_encoded = attention[:, None] * to_bag + to_gate @ w["gate"].T + to_open @ w["open"].T
        to_encoded *= encoded > 0
        found = {
            "encode": passages.T @ to_encoded,
            "shift": to_encoded.sum(axis=0),
            "gate": encoded.T @ to_gate,
            "open": encoded.T @ to_open,
            "attend": (gate * opened).T @ to_level,
            "judge": bag.T @ error,
            "prior": error.sum(keepdims=True),
        }
        return {name: value + DECAY * w[name] for name, value in found.items()}

    def fit(self, passages: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> None:
        first = {name: np.zeros_like(value) for name, value in self.weights.items()}
        second = {name: np.zeros_like(value) for name, value in self.weights.items()}
        for step in range(1, EPOCHS + 1):
            for name, slope in self.gradients(passages, counts, labels).items():
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope**2
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                self.weights[name] = self.weights[name] - RATE * move

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        passages, counts = features(texts)
        return self.forward(self.scaled(passages), counts)[-1]


def held_out(doc_id: Column) -> Column:
    """One id in three, by the checksum of the id as text; rows without an id have no label and are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, label: str, max_bags: int) -> list[tuple[str, int]]:
    """Texts and labels of the sample: a bounded number of rows, each cut to evenly spaced passages."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min(label).cast("int").alias("label")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_bags)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = text.split()
            parts = [words[at : at + PASSAGE_WORDS] for at in range(0, len(words), PASSAGE_WORDS)]
            if len(parts) > MAX_TRAIN_PASSAGES:
                at = np.linspace(0, len(parts) - 1, MAX_TRAIN_PASSAGES).astype(int).tolist()
                text = " ".join(" ".join(word[:1000] for word in parts[place]) for place in at)
            out.append(text)
        return pd.Series(out, dtype=object)

    # At most max_bags pairs of numbers are broadcast.
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", cut("text").alias("text"), "label")
    rows = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(max_bags)
    return [(row["text"], row["label"]) for row in rows.toLocalIterator()]


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", max_bags: int = MAX_BAGS) -> Network | None:
    """The network, or None if there are no labels."""
    passages, counts, marks, texts = [], [], [], []

    def describe() -> None:
        if texts:
            own, sizes = features(texts)
            passages.append(own.astype(np.float32))
            counts.append(sizes)
            texts.clear()

    for text, mark in sampled(docs, labels, label, max_bags):
        texts.append(text)
        marks.append(mark)
        if len(texts) == 200:
            describe()
    describe()
    return Network(np.concatenate(passages), np.concatenate(counts), np.array(marks)) if marks else None


def with_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_bags: int = MAX_BAGS) -> DataFrame:
    """Documents with ``held_out``, ``score`` and ``predicted``."""
    network = trained(docs, labels, label, max_bags)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(network.score(texts.tolist()))

    names = [column for column in docs.columns if column not in ("held_out", "score", "predicted")]
    scores = F.lit(0.5) if network is None else score(text_of("text"))
    out = docs.select(*names, held_out(F.col("doc_id")).alias("held_out"), scores.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
