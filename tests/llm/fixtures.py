"""Small tables with everything that operators must cope with."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, __text string, score string"


def sentence(seed: int, words: int = 80) -> str:
    random.seed(seed)
    return " ".join("".join(random.choices("abcdefghijklmno", k=random.randint(2, 8))) for _ in range(words))


def messy_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    clean = [sentence(seed) for seed in range(12)]
    rows = [(number, text, "en", f"src{number % 3}") for number, text in enumerate(clean)]
    rows += [(20, None, "en", "src0"), (21, "", None, None), (22, " \t\n", "de", "src1"), (None, clean[0], "en", None)]
    rows += [(23, clean[1], "en", "src1"), (24, clean[1] + " end", "en", "src1"), (24, clean[1] + " end", "en", "src1")]
    rows += [(25, "one two three", "fr", "src2"), (26, "Ünï ▁ cödé   😀\n\nx  y ", "fr", "src2")]
    rows += [(27, sentence(99, 20_000), "en", "src0"), (28, "x" * 50_000, "en", "src0"), (29, "same word " * 300, "es", "src9")]
    rows += [(30, "write to anna.b@mail.example.org or 10.0.0.1 now, +1 (555) 010-9999 ok", "en", "src0")]
    return [(*row, None if row[1] is None else len(row[1]), "theirs", "theirs", "theirs") for row in rows]


def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
