import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import empty, messy, messy_rows

from haulbook.llm import pii_crf as pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return [int(mark) for mark in text if mark in "0123456789"]


def card(text):
    found = digits(text)[::-1]
    total = sum(value if at % 2 == 0 else sum(divmod(2 * value, 10)) for at, value in enumerate(found))
    return 13 <= len(found) <= 19 and total % 10 == 0


def brute(text):
    tests = (
        (EMAIL, lambda found: True),
        (IP, lambda found: all(int(part) <= 255 for part in found.split("."))),
        (CARD, card),
        (PHONE, lambda found: 9 <= len(digits(found)) <= 15),
    )
    return [(n, *m.span()) for n, (pattern, good) in enumerate(tests) for m in pattern.finditer(text) if good(m[0])]


def test_base_spans_equal_the_patterns():
    random.seed(3)
    parts = ["a", "b.c", "@", "@x.org", ".", "-", " ", "+", "1", "255.", "10.0.0.1", "4381893557741609", "+1 (555) 010-9999"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(1, 12)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.nodes(text, pii.base_spans(text))


def test_messy_rows(spark):
    found = pii.with_spans(messy(spark)).collect()
    assert len(found) == len(messy_rows())
    for row in found:
        base = brute(row["text"] or "")
        assert [row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]] == [sum(s[0] == n for s in base) for n in range(4)]
        named = [f"{pii.KINDS[kind]}:{start}:{end}" for kind, start, end in base]
        assert row["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) - {""} <= set(row["spans"].split(","))
    assert {row["doc_id"] for row in found if row["spans"]} == {30}


def test_the_field_carries_labels_to_other_mentions(spark):
    texts = [
        "call +1 (555) 010-9999 soon " + "filler " * 200 + "again (555) 010-9999 or 555 010 8888",
        "mail anna.b@mail.example.org then " + "filler " * 50 + "at anna.b@mail later, not bob@mail",
        "no entity here: (555) 010-9999 and anna.b@mail",
    ] + [f"call +1 (555) 010-{n:04d} or mail u{n}@x{n}.example.org" for n in range(50)]
    docs = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "doc_id long, text string")
    found = {row["doc_id"]: row for row in pii.with_spans(docs).collect()}
    phone, mail = texts[0].rindex("(555)"), texts[1].rindex("anna.b@mail")
    assert found[0]["spans"].split(",")[1:] == [f"phone:{phone}:{phone + 14}"]
    assert found[1]["spans"].split(",")[1:] == [f"email:{mail}:{mail + 11}"]
    assert found[2]["spans"] == ""
    clean = {row["doc_id"]: row["text"] for row in pii.redact(docs).collect()}
    assert "again [PHONE] or 555 010 8888" in clean[0] and "at [EMAIL] later, not bob@mail" in clean[1]
    assert clean[2] == texts[2]


def test_messages_equal_enumeration_on_a_tree():
    field = pii.Potentials([("chain", "0", 3, 50), ("chain", "4", 0, 20), ("skip", "", 1, 9)])
    unary = np.random.default_rng(2).normal(size=(3, 5))
    labels = np.zeros((5, 5, 5))
    for place in np.ndindex(labels.shape):
        labels[place] = sum(unary[at, label] for at, label in enumerate(place))
        labels[place] += field.chain[place[0], place[1]] + field.chain[place[1], place[2]]
    labels = np.exp(labels) / np.exp(labels).sum()
    found = field.passed(unary, [])
    for at in range(3):
        others = tuple(axis for axis in range(3) if axis != at)
        assert found[at] == pytest.approx(labels.sum(axis=others), abs=1e-3)


def test_messages_equal_enumeration_with_skip_edges():
    """With the base span known, the loop that the skip edge closes is open, and messages are exact."""
    field = pii.Potentials([("chain", "0", 3, 50), ("chain", "4", 0, 20), ("skip", "", 1, 9)])
    unary = np.random.default_rng(5).normal(size=(4, 5))
    unary[0] = -50.0
    unary[0, 3] = 0.0
    carried = np.array([[False, False, False, True, False]])
    labels = np.zeros((5, 5, 5, 5))
    for place in np.ndindex(labels.shape):
        labels[place] = sum(unary[at, label] for at, label in enumerate(place))
        labels[place] += sum(field.chain[place[at], place[at + 1]] for at in range(3))
        labels[place] += field.skip * (place[0] == place[3] == 3)
    labels = np.exp(labels) / np.exp(labels).sum()
    found = field.passed(unary, [(0, 3)], carried)
    for at in range(4):
        others = tuple(axis for axis in range(4) if axis != at)
        assert found[at] == pytest.approx(labels.sum(axis=others), abs=1e-3)


def test_what_a_pattern_refuses_is_not_added(spark):
    refused = "pay 9807915762804490 and again 9807915762804490"
    texts = [
        refused,
        refused + " 10.0.0.1",
        "card 4381893557741609 then 9807915762804490 9807915762804490 and 4381.8935.5774.1609",
        "call +1 (555) 010-9999 not 1235550109999 but 05550109999 4381893557741608",
        "to info@mail.example.org and info@host, then INFO@mail",
        "4381893557741609 5550109999",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row["doc_id"]: row["spans"] for row in pii.with_spans(docs).collect()}

    def at(number, string, kind):
        start = texts[number].rindex(string)
        return f"{kind}:{start}:{start + len(string)}"

    assert found[0] == "" and found[1] == at(1, "10.0.0.1", "ip")
    assert found[2] == ",".join([at(2, "4381893557741609", "card"), at(2, "4381.8935.5774.1609", "card")])
    assert found[3] == ",".join([at(3, "+1 (555) 010-9999", "phone"), at(3, "05550109999", "phone")])
    assert found[4] == ",".join([at(4, "info@mail.example.org", "email"), at(4, "INFO@mail", "email")])


def test_null_text_stays_and_empty(spark):
    assert [row["text"] for row in pii.redact(messy(spark)).where("doc_id = 20").collect()] == [None]
    assert pii.with_spans(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0
