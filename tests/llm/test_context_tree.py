import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import WORD, empty, messy, messy_rows

from haulbook.llm import context_tree

HALF = math.log(0.5)


def words_of(text):
    lowered = "".join(chr(ord(mark) + 32) if "A" <= mark <= "Z" else mark for mark in text or "")
    return WORD.findall(lowered)


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


class Tree:
    """Context-tree weighting as the definition says, node by node."""

    def __init__(self, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])

    @staticmethod
    def decisions(byte):
        node = 1
        for shift in range(7, -1, -1):
            bit = byte >> shift & 1
            yield node, bit
            node = node * 2 + bit

    def places(self, data):
        padded = b"\xff" * self.depth + data
        for at in range(len(data)):
            yield padded[at : at + self.depth], padded[at + self.depth]

    def learn(self, data):
        for context, byte in self.places(data):
            for node, bit in self.decisions(byte):
                for length in range(self.depth + 1):
                    self.counts[context[self.depth - length :], node][bit] += 1

    def settle(self):
        children = defaultdict(list)
        for context, node in self.counts:
            if context:
                children[context[1:], node].append((context, node))
        self.weight, weighted = {}, {}
        for key in sorted(self.counts, key=lambda key: -len(key[0])):
            zeros, ones = self.counts[key]
            own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
            if len(key[0]) == self.depth:
                weighted[key], self.weight[key] = own, 1.0
            else:
                weighted[key] = HALF + np.logaddexp(own, sum(weighted[child] for child in children[key]))
                self.weight[key] = math.exp(HALF + own - weighted[key])

    def log10(self, data):
        total = 0.0
        for context, byte in self.places(data):
            for node, bit in self.decisions(byte):
                chance = None
                for length in range(self.depth, -1, -1):
                    key = context[self.depth - length :], node
                    if key in self.counts:
                        zeros_ones = self.counts[key]
                        own = (zeros_ones[bit] + 0.5) / (sum(zeros_ones) + 1)
                        share = 1.0 if chance is None else self.weight[key]
                        chance = own if chance is None else share * own + (1 - share) * chance
                total += math.log10(0.5 if chance is None else chance)
        return total


@pytest.mark.parametrize("run_bytes", [10 << 20, 2000])
def test_scores_equal_the_definition(spark, run_bytes):
    rows = [row for row in messy_rows() if row[0] not in (27, 28)]
    frame = spark.createDataFrame(rows, messy(spark).schema)
    found = context_tree.score_documents(frame, run_bytes).collect()
    assert len(found) == len(rows)
    lines = [(row[0], words_of(row[1])) for row in rows]
    tree, counts = Tree(context_tree.DEPTH), Counter()
    for doc_id, words in lines:
        if not held(doc_id):
            tree.learn(" ".join(words).encode() + b"\xff")
            counts.update([*words, None])
    tree.settle()
    whole = math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    expected = []
    for doc_id, words in lines:
        tokens = [*words, None]
        base = sum(math.log10(counts[word] + 0.1) - whole for word in tokens)
        known = sum(counts[word] > 0 for word in tokens)
        score = tree.log10(" ".join(words).encode() + b"\xff")
        expected.append((str(doc_id), held(doc_id), len(tokens), known, sum(counts.values()), base, score))
    order = lambda row: (row[0], row[2], round(row[5], 6))
    mine = sorted(((str(row["doc_id"]), *row[1:7]) for row in found), key=order)
    for one, other in zip(mine, sorted(expected, key=order)):
        assert one[:5] == other[:5]
        assert one[5] == pytest.approx(other[5], rel=1e-9) and one[6] == pytest.approx(other[6], rel=1e-4, abs=1e-4)


def test_long_texts(spark):
    found = {row["doc_id"]: row for row in context_tree.score_documents(messy(spark)).collect()}
    assert found[27]["n_tokens"] == 20_001 and found[28]["n_tokens"] == 2
    assert all(row["score"] < 0 and math.isfinite(row["score"]) for row in found.values())


def test_probabilities_of_a_byte_sum_to_one():
    keys = np.arange(256, dtype=np.int64) + (0x6162636465 << 8)
    counts = np.zeros(256)
    counts[[97, 98, 200]] = 5, 2, 1
    upper = context_tree.Upper([(0x61, 1, -3.0, 6.0, 2.0)])
    assert (10 ** upper.log10(keys, counts)).sum() == pytest.approx(1.0)


def test_log_gamma():
    values = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e9])
    assert context_tree.log_gamma(values) == pytest.approx([math.lgamma(value) for value in values], rel=1e-10, abs=1e-10)


def test_learns_from_held_in_alone_and_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = context_tree.score_documents(docs)
    sums = found.where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert sums[0] > sums[1]


def test_empty(spark):
    assert context_tree.score_documents(empty(spark)).count() == 0
