import random
import re
from collections import Counter

import pytest
from fixtures import empty, messy, messy_rows

from haulbook.llm import collocations

DOCS = "doc_id long, text string, lang string, f long, phrase string, size string"


def brute(docs, top=2000, least=30):
    """All phrases counted in dictionaries, each held against all longer ones."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [word for word in re.split("[ \t]+", piece) if word]
            lang = "und" if lang is None else lang
            n[lang] += len(words)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    f[lang, tuple(words[at : at + size])] += 1
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    held = {}
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                inner = lang, words[at : at + size]
                held[inner] = max(held.get(inner, 0), a)
    out = []
    for lang in n:
        rows = []
        for (its, words), a in candidates.items():
            if its != lang or 100 * held.get((lang, words), 0) >= 80 * a:
                continue
            score, _, l, r = min(
                (2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                for k in range(1, len(words))
            )
            rows.append((-score, -a, " ".join(words).encode(), l, r))
        rows.sort()
        out += [
            (lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
            for rank, (score, a, phrase, l, r) in enumerate(rows[:top], 1)
        ]
    return sorted(out)


def texts(seed=0, count=160):
    """Random words with fixed phrases of all kinds among them: nested ones, variants at both ends, equal scores."""
    r = random.Random(seed)
    fixed = ["new york", "in New York city", "the\tnew york city", "as soon as possible", "soon as", "vice versa", "Ünï cödé ▁x", "a b a b a b"]
    out = []
    for at in range(count):
        words = [r.choice([*fixed, "alpha", "beta", "gamma", "delta", "eps", "the", "a", "b"]) for _ in range(r.randint(0, 60))]
        text = "".join(word + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for word in words)
        out.append((text, ["en", "de", None][at % 3] if at % 10 else "en"))
    return out + [(None, "en"), ("", None), (" . ,", "fr"), ("one", "xx"), (out[0][0], "en")]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(at, text, lang, 1, "theirs", "x") for at, (text, lang) in enumerate(rows)], DOCS)
    return sorted(map(tuple, collocations.mine(docs.repartition(3), **options).collect()))


@pytest.mark.parametrize("top,least,run,bits", [(2000, 30, 1 << 23, 1 << 26), (7, 5, 600, 1 << 16), (3, 2, 1 << 23, 1 << 15)])
def test_collocations_equal_brute_force(spark, monkeypatch, top, least, run, bits):
    """Also with runs of a few texts, with several rounds, and with bitmaps so full that they let much through."""
    monkeypatch.setattr(collocations, "RUN_BYTES", run)
    monkeypatch.setattr(collocations, "BITMAP_BITS", bits)
    rows = texts(top)
    expected = brute(rows, top, least)
    assert found(spark, rows, top=top, least=least) == expected and expected


def test_many_phrases_dropped_below_the_first_threshold(spark):
    """A chain of nested phrases fills the best places of the pairs, so that thresholds have to fall."""
    r = random.Random(5)
    rows = [(". ".join(f"p{at} q{at} r{at} s{at}" for at in r.sample(range(30), 20)), "en") for _ in range(20)]
    rows += [(". ".join(f"w{r.randint(0, 5)} v{r.randint(0, 5)}" for _ in range(40)), "en") for _ in range(20)]
    expected = brute(rows, 40, 5)
    assert len(expected) == 40
    assert found(spark, rows, top=40, least=5) == expected


def test_runs_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RUN_BYTES", 10)
    rows = [("long piece without any break, short. x y z w v\n" * 4, "en"), ("no break at all here", "en")]
    assert found(spark, rows, top=9, least=2) == brute(rows, 9, 2)


def test_messy_and_empty_tables(spark):
    rows = [(row[1], row[2]) for row in messy_rows()]
    assert sorted(map(tuple, collocations.mine(messy(spark), least=2).collect())) == brute(rows, 2000, 2)
    assert collocations.mine(empty(spark)).count() == 0


def test_scores_pass_64_bits(spark):
    huge = spark.createDataFrame([("en", "a b", 2**61)], "lang string, phrase string, f long")
    known = spark.createDataFrame([("en", "a", 2**61 + 8), ("en", "b", 2**62)], "lang string, phrase string, f long")
    row = collocations.scored(huge, 2, known).first()
    assert row["score"] == 2000000 * 2**61 // (2**61 + 8 + 2**62) and row["bound"] == 2000000 * 2**61 // (2**62 + 8)
