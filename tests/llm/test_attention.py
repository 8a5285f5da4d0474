import zlib

import numpy as np
import pytest
from fixtures import empty, messy, messy_rows

from haulbook.llm import attention_quality as quality
from haulbook.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def test_gradients_are_those_of_the_loss():
    random = np.random.default_rng(3)
    passages, counts, labels = random.normal(size=(9, 5)), np.array([2, 1, 4, 2]), np.array([0.0, 1.0, 1.0, 0.0])
    network = quality.Network.__new__(quality.Network)
    network.weights = {
        "encode": random.normal(size=(5, 4)), "shift": random.normal(size=4), "gate": random.normal(size=(4, 3)),
        "open": random.normal(size=(4, 3)), "attend": random.normal(size=3), "judge": random.normal(size=4),
        "prior": random.normal(size=1),
    }

    def loss():
        chance = network.forward(passages, counts)[-1]
        fit = -(labels * np.log(chance) + (1 - labels) * np.log(1 - chance)).mean()
        return fit + quality.DECAY / 2 * sum((value**2).sum() for value in network.weights.values())

    for name, slope in network.gradients(passages, counts, labels).items():
        value = network.weights[name]
        for place in np.ndindex(value.shape):
            kept = value[place]
            value[place] = kept + 1e-6
            above = loss()
            value[place] = kept - 1e-6
            below = loss()
            value[place] = kept
            assert slope[place] == pytest.approx((above - below) / 2e-6, abs=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    found = quality.with_quality(docs, labels, max_bags=1500).join(labels, "doc_id").where("held_out").collect()
    right = sum(row["predicted"] == row["quality"] for row in found)
    assert right > 0.98 * len(found)


def test_messy_rows(spark):
    rows = [(row[0], int(row[0] % 2), 0) for row in messy_rows()[:12]] + [(None, 1, 0), (1, None, 0), (2, 1, 0)]
    found = quality.with_quality(messy(spark), spark.createDataFrame(rows, LABELS)).collect()
    assert len(found) == len(messy_rows())
    for row in found:
        doc_id = row["doc_id"]
        assert row["held_out"] == (doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
        assert row["tokens"] == "theirs"


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], LABELS)
    assert {row["score"] for row in quality.with_quality(messy(spark), none).collect()} == {0.5}
    assert quality.with_quality(empty(spark), none).count() == 0
