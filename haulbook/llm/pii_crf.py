"""Personal data by fixed patterns and a skip-chain conditional random field over each document.

The patterns find the base spans, which always stay. Besides them a document has candidates: strings of the same
alphabet that no pattern accepts (an address without a dot in its domain, a number without its plus sign). Base spans and
candidates are the nodes of the field, in text order. Neighbours are joined by chain edges; nodes that name the same entity
(equal local parts, equal last digits), however far apart, by skip edges, each to the next and to the first of its entity, so
that their number stays linear. Skip edges carry the labels of the base spans of their entity and no others, so what two
candidates share says nothing by itself. A candidate can only take a label whose own check it passes (Luhn, the number of
digits) and only as another way of writing a base span: the front of its address, the end of its number, the same
card. Loopy message passing gives every candidate its label distribution, and candidates with a likely label become spans
of that kind. Texts without a base span therefore never gain one, whatever else they hold.

Potentials are learned from all documents in one counting pass: labels by shape of the string, labels of neighbours,
and how often nodes of one entity have one label among the base spans. Shapes are tuples of small numbers, so the
counts are bounded whatever the corpus.

Defined results: null and empty texts have no spans; texts of any length are read whole, in time linear in their length;
offsets are code points, ends exclusive; repeated rows are read each; an empty table gives an empty result; other columns pass
through, and columns of theirs called like a result are replaced by it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import text_of, unused

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: a kind's place in KINDS, and the last for none.
NONE = len(KINDS)

#: Bounds of the log-potentials, rounds of message passing, damping, and the probability from which a label is taken.
MAX_UNARY, MAX_CHAIN, MAX_SKIP, ROUNDS, DAMPING, LIKELY = 3.0, 0.5, 6.0, 20, 0.3, 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HINT = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SHORT_DOMAIN = re.compile(r"[A-Za-z0-9-]+")
# A match from inside a run of digits would go on as one from its start, so only starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+")
# Between numbers that stand side by side: an unbroken run of nine digits is a number of its own.
GLUE = re.compile(r"(?<=[0-9]{9})\x20{1,2}|\x20{1,2}(?=[0-9]{9})")
NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # label, start, end


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> tuple[list[Span], list[Span]]:
    """Addresses by the pattern, and strings around an @ that it does not accept.

    Before an @ the pattern can only match the whole run of permitted characters, so each @ is looked at once.
    """
    found, others = [], []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            if whole := DOMAIN.match(text, at + 1):
                end = whole.end()
                found.append((0, start, end))
            elif short := SHORT_DOMAIN.match(text, at + 1):
                others.append((NONE, start, short.end()))
        at = text.find("@", max(at + 1, end))
    return found, others


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, then start."""
    if not HINT.search(text):
        return []
    found = emails(text)[0]
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match[0].split(".")):
            found.append((1, *match.span()))
    for match in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", match[0]) if match.end() - match.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *match.span()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, match[0])) <= 15:
                found.append((3, *match.span()))
    return found


def numbers(text: str) -> list[tuple[int, int]]:
    """Where numbers of seven digits and more stand that may be written in any way."""
    found = []
    for match in NUMBER.finditer(text):
        place, end = match.span()
        if end - place < 7:
            continue
        cuts = [gap.span() for gap in GLUE.finditer(text, place, end)]
        for stop, after in [*cuts, (end, end)]:
            if stop - place <= 40 and sum(map(str.isdigit, text[place:stop])) >= 7:
                found.append((place, stop))
            place = after
    return found


def nodes(text: str, base: list[Span]) -> list[Span]:
    """Base spans and, apart from them, candidates: in text order."""
    if not HINT.search(text):
        return []
    taken = sorted((start, end) for _, start, end in base)
    others = emails(text)[1] if "@" in text else []
    others += [(NONE, *span) for span in numbers(text)]
    free, place, reach = [], 0, -1
    for label, start, end in sorted(others, key=lambda span: span[1]):
        while place < len(taken) and taken[place][0] < end:
            reach = max(reach, taken[place][1])
            place += 1
        if start >= reach:
            free.append((label, start, end))
            reach = end
    return sorted(base + free, key=lambda span: span[1:])


def entity(string: str) -> str:
    """What nodes of one entity have in common."""
    if "@" in string:
        return string.split("@")[0].lower()
    if string.count(".") == 3 and not set(string) & set(" ()+-") and max(map(len, string.split("."))) <= 3:
        return string
    return NOT_DIGITS.sub("", string)[-9:]


def rewrites(label: int, known: str, string: str) -> bool:
    """Whether a string is another way of writing a base span of this kind, and passes the kind's own check."""
    if label == 0:
        return known.lower().startswith(string.lower() + ".")
    if "@" in string:
        return False
    digits, whole = NOT_DIGITS.sub("", string), NOT_DIGITS.sub("", known)
    if label == 2:
        return digits == whole and 13 <= len(digits) <= 19 and luhn(digits)
    # Country codes may be left out, and zeros put in their place.
    own = digits.lstrip("0")
    return label == 3 and len(digits) <= 15 and len(own) >= 9 and whole.endswith(own)


def shape(string: str) -> str:
    """A short description of a string; there are a few thousand at most."""
    digits = sum(map(str.isdigit, string))
    return ":".join(
        map(
            str,
            (
                min(string.count("@"), 2),
                min(digits, 20),
                int("+" in string),
                int("(" in string),
                min(string.count("."), 4),
                int(" " in string or "-" in string),
            ),
        )
    )


def skip_edges(keys: list[str]) -> list[tuple[int, int]]:
    """Of every node to the next and to the first of its entity."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    edges = []
    for at, key in enumerate(keys):
        if key in first:
            edges.append((last[key], at))
            if first[key] != last[key]:
                edges.append((first[key], at))
        else:
            first[key] = at
        last[key] = at
    return edges


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a partition adds to the counts that the potentials come from."""
    total: Counter[tuple[str, str, int]] = Counter()
    for batch in batches:
        for text in batch["text"]:
            spans = nodes(text, base_spans(text))
            for label, start, end in spans:
                total["shape", shape(text[start:end]), label] += 1
            for (left, _, _), (right, _, _) in zip(spans, spans[1:]):
                total["chain", str(left), right] += 1
            sure = [span for span in spans if span[0] != NONE]
            for left, right in skip_edges([entity(text[start:end]) for _, start, end in sure]):
                total["skip", "", int(sure[left][0] == sure[right][0])] += 1
    yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["part", "what", "label", "n"])


class Potentials:
    """Log-potentials of the field."""

    def __init__(self, counts: list[tuple[str, str, int, int]]):
        by_shape: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(NONE + 1))
        # Before any count, nodes of one entity are held to have one label 99 times in 100.
        chain, skip = np.ones((NONE + 1, NONE + 1)), np.array([1.0, 99.0])
        for part, what, label, n in counts:
            if part == "shape":
                by_shape[what][label] += n
            elif part == "chain":
                chain[int(what), label] += n
            else:
                skip[label] += n
        self.shapes = {
            what: np.clip(np.log((n + 0.1) / (n.max() + 0.1)), -MAX_UNARY, 0.0) for what, n in by_shape.items()
        }
        # How much more often two labels stand side by side than their own frequencies say.
        share = chain / chain.sum()
        self.chain = np.clip(np.log(share / np.outer(share.sum(1), share.sum(0))), -MAX_CHAIN, MAX_CHAIN)
        self.skip = min(MAX_SKIP, max(0.0, math.log(skip[1] / skip[0])))
        self.unknown = np.array([-MAX_UNARY] * NONE + [0.0])

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """The base spans and those that the field adds."""
        found = nodes(text, base)
        open_nodes = [at for at, node in enumerate(found) if node[0] == NONE]
        if not base or not open_nodes:
            return base
        strings = [text[start:end] for _, start, end in found]
        keys = [entity(string) for string in strings]
        known: dict[str, dict[str, int]] = defaultdict(dict)
        for (label, _, _), key, string in zip(found, keys, strings):
            if label != NONE:
                known[key][string] = label
        allowed = np.zeros((len(found), NONE + 1), bool)
        allowed[:, NONE] = True
        for at in open_nodes:
            for string, label in known.get(keys[at], {}).items():
                allowed[at, label] |= rewrites(label, string, strings[at])
        if not allowed[open_nodes, :NONE].any():
            return base
        skips = skip_edges(keys)
        carried = np.zeros((len(skips), NONE + 1), bool)
        for at, (left, _) in enumerate(skips):
            carried[at, list(known.get(keys[left], {}).values())] = True
        unary = np.array([self.shapes.get(shape(string), self.unknown) for string in strings])
        for at, (label, _, _) in enumerate(found):
            if label != NONE:
                unary[at] = -50.0
                unary[at, label] = 0.0
            else:
                unary[at, ~allowed[at]] = -50.0
        belief = self.passed(unary, skips, carried)
        added = []
        for at in open_nodes:
            label = int(belief[at].argmax())
            if label != NONE and belief[at, label] > LIKELY:
                added.append((label, *found[at][1:]))
        return base + added

    def passed(self, unary: np.ndarray, skips: list[tuple[int, int]], carried: np.ndarray | None = None) -> np.ndarray:
        """Label distributions of all nodes after message passing along chain and skip edges.

        ``carried`` tells which labels each skip edge rewards at both of its ends.
        """
        size, labels = unary.shape
        chain = [(at, at + 1) for at in range(size - 1)]
        edges = np.array(chain + skips)
        same = np.zeros((len(skips), labels, labels))
        if skips:
            same[:, np.arange(labels), np.arange(labels)] = carried * self.skip
        weights = np.concatenate((np.repeat(self.chain[None], len(chain), 0), same))
        source = np.concatenate((edges[:, 0], edges[:, 1]))
        target = np.concatenate((edges[:, 1], edges[:, 0]))
        weights = np.concatenate((weights, weights.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))))
        messages = np.zeros((2 * len(edges), labels))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, target, messages)
            out = (total[source] - messages[back])[:, :, None] + weights
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages).max()
            messages = DAMPING * messages + (1 - DAMPING) * new
            if change < 1e-4:
                break
        total = unary.copy()
        np.add.at(total, target, messages)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def learned(docs: DataFrame) -> Potentials:
    """Potentials from all documents. The counts that come to the driver are bounded by the number of shapes."""
    counts = docs.select(text_of("text").alias("text")).mapInPandas(counted, "part string, what string, label int, n long")
    return Potentials([tuple(row) for row in counts.groupBy("part", "what", "label").agg(F.sum("n")).collect()])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[label]}:{start}:{end}" for label, start, end in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first gives the name."""
    if not spans:
        return text
    out, place = [], 0
    for label, start, end in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start >= place:
            out += [text[place:start], f"[{KINDS[label].upper()}]"]
        place = max(place, end)
    return "".join(out) + text[place:]


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def reported(text: Column, potentials: Potentials) -> Column:
    """Base counts, the digest of the base spans and all spans, as a struct."""

    @F.pandas_udf(RESULT)
    def over(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for string in texts:
            base = base_spans(string)
            counts = Counter(label for label, _, _ in base)
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((*(counts[kind] for kind in range(NONE)), digest, written(potentials.spans(string, base))))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return over(text_of(text))


def with_spans(docs: DataFrame) -> DataFrame:
    """Documents with ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` and ``spans``."""
    new = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    rest = docs.drop(*new)
    found = unused(rest, "__found")
    out = rest.withColumn(found, reported(F.col("text"), learned(docs)))
    return out.select(*rest.columns, *[F.col(f"{found}.{name}").alias(name) for name in new])


def redact(docs: DataFrame) -> DataFrame:
    """Documents whose ``text`` has every span replaced by its kind; a null text stays null."""
    potentials = learned(docs)

    @F.pandas_udf("string")
    def over(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else redacted(text, potentials.spans(text, base_spans(text))))

    return docs.withColumn("text", over(F.col("text")))
