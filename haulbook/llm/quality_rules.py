"""Quality rules as a short-circuit cascade, built from DataFrame functions alone.

Every rule is a predicate over a document's own measures and says when to reject it. On a stored sample each rule's
cost (seconds) and selectivity (share rejected) are measured; rules are then tried in the order of rejection per cost,
and a document that one rule rejects is not shown to the later ones. The order changes what is computed, never
which documents are kept.

Defined results: a null text counts as the empty text; empty texts have no words and fail the base rule; repeated rows
are judged each for itself; an empty table gives an empty result; other columns pass through unread, and a column of
theirs with the name of a measure is dropped in favour of the measure.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import stored, text_of, unused, words_of

#: Rows of the sample on which rules are timed. It decides their order only.
SAMPLE_ROWS = 1000

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named reason to reject, from the words and the text of a document."""

    name: str
    rejects: Callable[[Column, Column], Column]


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    lines = lines_with_words(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeat_positions(windows: Column) -> Column:
    """The windows that have an equal among the others, sorted by hash, as (hash, position).

    Sorting by hash brings equal windows together. Most texts have no repeat, and their distinct count tells.
    """
    numbered = F.transform(windows, lambda value, at: F.struct(value.alias("h"), at.alias("at")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(numbered))


def repeated(ordered_windows: Column) -> Column:
    """Positions, ascending, of the windows with an equal neighbour."""

    def hash_at(at: Column) -> Column:
        return F.get(ordered_windows, at)["h"]

    found = F.filter(ordered_windows, lambda own, at: (own["h"] == hash_at(at - 1)) | (own["h"] == hash_at(at + 1)))
    return F.sort_array(F.transform(found, lambda own: own["at"]))


def words_under(positions: Column) -> Column:
    """Words covered by 3-word windows at these ascending positions, each word once."""
    new = F.transform(
        positions, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - at, F.lit(3))).cast("long")
    )
    return F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda total, more: total + more), F.lit(0).cast("long"))


def with_repeats(frame: DataFrame, windows: str, name: str) -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that occur at least twice. Each step is a column of its own, so
    that none is computed anew for every element of the next."""
    ordered_windows, places = unused(frame, "__sorted"), unused(frame, "__at")
    frame = frame.withColumn(ordered_windows, repeat_positions(F.col(windows)))
    frame = frame.withColumn(places, repeated(F.col(ordered_windows)))
    return frame.withColumn(name, words_under(F.col(places))).drop(ordered_windows, places)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each 3-word window, in order; none for texts of fewer than three words."""
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.arrays_zip(
                F.slice(words, 1, F.size(words) - 2).alias("a"),
                F.slice(words, 2, F.size(words) - 2).alias("b"),
                F.slice(words, 3, F.size(words) - 2).alias("c"),
            ),
            lambda window: F.xxhash64(window["a"], window["b"], window["c"]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


#: Rejections beyond the base rule. All are shares, so that long documents are judged like short ones.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda words, text: 10 * n_symbols(text) > 3 * F.size(words)),
    Rule("capitals", lambda words, text: 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > word_chars(words)),
    Rule("shouts", lambda words, text: 2 * F.regexp_count(text, F.lit("[!?]{2,}")) > F.size(words)),
    Rule("digits", lambda words, text: 2 * F.regexp_count(text, F.lit("[0-9]")) > word_chars(words)),
    Rule("word_length", lambda words, text: (word_chars(words) > 20 * F.size(words)) | (word_chars(words) < 2 * F.size(words))),
    Rule("few_distinct", lambda words, text: 20 * F.size(F.array_distinct(words)) < F.least(F.size(words), F.lit(2000))),
    Rule("dup_lines", lambda words, text: 10 * n_dup_lines(text) > 4 * F.size(lines_with_words(text))),
)


def measured(sample: DataFrame, rules: Sequence[Rule]) -> dict[str, tuple[float, float]]:
    """Seconds and share of rows rejected of every rule over a stored sample."""
    ready = sample.select(text_of("text").alias("text")).withColumn("words", words_of(F.col("text")))
    words, text = F.col("words"), F.col("text")
    shares = ready.agg(*[F.avg(rule.rejects(words, text).cast("double")).alias(rule.name) for rule in rules]).first()

    def seconds(frame: DataFrame) -> float:
        taken = []
        for _ in range(2):
            started = time.perf_counter()
            frame.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        return min(taken)

    idle = seconds(ready.select(F.size("words")))
    return {
        rule.name: (max(seconds(ready.select(rule.rejects(words, text))) - idle, 1e-3), shares[rule.name] or 0.0)
        for rule in rules
    }


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample, the best first."""
    total = docs.count()
    if total == 0 or len(rules) < 2:
        return list(rules)
    share = min(1.0, 2.0 * sample_rows / total)
    sample = stored(docs.select("text").sample(fraction=share, seed=42).limit(sample_rows), "rule-sample")
    figures = measured(sample, rules)
    return sorted(rules, key=lambda rule: -figures[rule.name][1] / figures[rule.name][0])


def first_rejection(rules: Sequence[Rule], words: Column, text: Column) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(words, text), F.lit(rule.name)).otherwise(verdict)
    return verdict


def not_inlined() -> Column:
    """Always true. Being non-deterministic to the optimizer, it keeps filters on the verdict where they stand; pushed
    below, they would repeat every measure inside the functions that use it."""
    return F.monotonically_increasing_id() >= 0


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, order: bool = True) -> DataFrame:
    """Documents with the measures of the base rule, ``base_failed`` and ``kept``."""
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    cascade = ordered(docs, rules) if order else list(rules)
    out = docs.drop(*new)
    names = out.columns
    text_name, words_name, windows_name = (unused(out, name) for name in ("__text", "__words", "__windows"))
    text, words = F.col(text_name), F.col(words_name)
    out = out.withColumn(text_name, text_of("text"))
    out = out.withColumn(words_name, words_of(text)).withColumn(windows_name, window_hashes(words))
    out = with_repeats(out, windows_name, "n_repeat_words")
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": word_chars(words),
            "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    verdict = ~F.col("base_failed") & first_rejection(cascade, words, text).isNull()
    return out.withColumn("kept", verdict & not_inlined()).select(*names, *new)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, order: bool = True) -> DataFrame:
    """The documents that pass the base rule and every rule of the cascade, with their own columns.

    Here the cascade decides alone, so the costly window count is only made for documents that all else lets through.
    """
    cascade = ordered(docs, rules) if order else list(rules)
    inner = [unused(docs, name) for name in ("__text", "__words", "__passed", "__windows", "__repeat", "__kept")]
    text, words, passed, windows, repeat, kept = inner
    ready = docs.withColumn(text, text_of("text")).withColumn(words, words_of(F.col(text)))
    rejected = first_rejection(cascade, F.col(words), F.col(text))
    ready = ready.withColumn(passed, (F.size(words) >= 50) & rejected.isNull())
    ready = ready.withColumn(windows, F.when(F.col(passed), window_hashes(F.col(words))))
    ready = with_repeats(ready, windows, repeat)
    verdict = F.col(passed) & (100 * F.col(repeat) <= 50 * F.size(words))
    return ready.withColumn(kept, verdict & not_inlined()).where(kept).select(*docs.columns)
