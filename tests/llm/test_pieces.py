import random

import numpy as np
import pytest
import sentencepiece
from fixtures import empty, messy

from haulbook.llm import piece_transducer
from haulbook.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_ids_equal_the_library(spark, reference):
    found = piece_transducer.with_ids(messy(spark), PIECE_MODEL).collect()
    for row in found:
        text = row["text"] or ""
        assert row["ids"] == reference.encode(text) and row["n_ids"] == len(row["ids"])
        assert row["decoded"] == text.replace("▁", " ") and row["round_trip"]
        assert row["score"] == "theirs"


def test_random_strings(reference):
    transducer = piece_transducer.compiled(piece_transducer.read_model(PIECE_MODEL))
    random.seed(7)
    for _ in range(3000):
        text = "".join(random.choices(["the", "ing", " ", "  ", " " * 17, "\n", "é", "日", "▁", "x", "12", "\x00", "😀"], k=12))
        assert transducer.encode(text) == reference.encode(text)
        assert transducer.decode(transducer.encode(text)) == text.replace("▁", " ")


def test_a_full_table_takes_no_more(reference, monkeypatch):
    monkeypatch.setattr(piece_transducer, "MAX_WORDS", 3)
    transducer = piece_transducer.Transducer(piece_transducer.read_model(PIECE_MODEL))
    for text in ("a b c d e f g", "h i j", "a b  c"):
        assert transducer.encode(text) == reference.encode(text)
    assert len(transducer.words) == 3


def test_broken_bytes_decode(reference):
    transducer = piece_transducer.compiled(piece_transducer.read_model(PIECE_MODEL))
    assert transducer.decode([transducer.byte_ids[0xFF]]) == "�"
    assert transducer.decode([1, 2]) == ""


def test_the_acceptor_equals_joining(reference):
    transducer = piece_transducer.Transducer(piece_transducer.read_model(PIECE_MODEL))
    names = list(transducer.ids)
    random.seed(11)
    usual = [at for at, name in enumerate(names) if (len(name) == 1 or transducer.left[at] >= 0) and name.strip("▁")]
    short = [at for at in usual if len(names[at]) < 4]
    pairs = [random.choices(random.choice((usual, short)), k=2) for _ in range(20_000)]
    pairs = [(left, right) for left, right in pairs if "▁" not in names[right]]
    left, right = np.array(pairs).T
    for _ in range(2):
        # The second time all verdicts come from the table of pairs.
        found = transducer.may_follow(left, right)
        for verdict, a, b in zip(found.tolist(), left.tolist(), right.tolist()):
            assert verdict == (transducer.joined(names[a] + names[b]) == [names[a], names[b]]), (names[a], names[b])


@pytest.fixture(scope="module")
def unigram():
    # A message of the trainer's part that says Unigram, behind the one that says otherwise.
    return piece_transducer.read_model(PIECE_MODEL) + b"\x12\x02\x18\x01"


def test_unigram_models_take_the_path_of_least_weight(unigram):
    transducer = piece_transducer.Transducer(unigram)
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram)
    random.seed(13)
    for _ in range(500):
        text = "".join(random.choices(["the", "ing", "er", " ", "  ", "tion", "a", "x", "12", "st", "."], k=random.randint(1, 9)))
        pieces = [transducer.surface[at] for at in transducer.encode(text)]
        shown = "▁" + text.replace(" ", "▁")
        assert "".join(pieces) == shown
        best = [0.0]
        for end in range(1, len(shown) + 1):
            ways = [best[at] - transducer.scores[shown[at:end]] for at in range(end) if shown[at:end] in transducer.scores]
            best.append(min(ways))
        weight = -sum(map(transducer.scores.__getitem__, pieces))
        assert weight == best[-1]
        first = library.nbest_encode(text, nbest_size=2, out_type=str)[0]
        assert weight == pytest.approx(-sum(map(transducer.scores.__getitem__, first)), rel=1e-6)
        assert transducer.decode(transducer.encode(text)) == text
    assert transducer.decode(transducer.encode("日\n\x00 é😀")) == "日\n\x00 é😀"


def test_long_words(reference):
    transducer = piece_transducer.compiled(piece_transducer.read_model(PIECE_MODEL))
    for text in ("x" * 20_000, "the" * 5_000 + " " * 40, "\n" * 5_000, "😀é" * 3_000):
        assert transducer.encode(text) == reference.encode(text)


def test_empty(spark):
    assert piece_transducer.with_ids(empty(spark), PIECE_MODEL).count() == 0
