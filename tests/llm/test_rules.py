from collections import Counter

import pytest
from fixtures import WORD, empty, messy, messy_rows

from haulbook.llm import quality_rules


@pytest.fixture(scope="module")
def judged(spark):
    return quality_rules.judge(messy(spark)).collect()


def measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[at : at + 3]) for at in range(len(words) - 2)]
    times = Counter(windows)
    under = {at + k for at, window in enumerate(windows) if times[window] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(mark in "#*$%&|<>" for mark in text or ""),
        len(lines) - len(set(lines)),
        len(under),
    )


def test_measures_equal_brute_force(judged):
    assert len(judged) == len(messy_rows())
    for row in judged:
        mine = (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"])
        assert mine == measures(row["text"])
        assert row["base_failed"] == (mine[0] < 50 or 100 * mine[4] > 50 * mine[0])
        assert not (row["base_failed"] and row["kept"])


def test_other_columns_stay(judged):
    assert {row["__text"] for row in judged} == {"theirs"} and {row["tokens"] for row in judged} == {"theirs"}


def test_clean_documents_stay_and_repeats_go(spark, judged):
    kept = {row["doc_id"] for row in judged if row["kept"]}
    assert set(range(12)) | {23, 24, 27} <= kept
    assert not kept & {20, 21, 22, 25, 28, 29}
    stage = quality_rules.keep_good(messy(spark))
    assert stage.columns == messy(spark).columns
    names = stage.columns
    assert sorted(map(repr, stage.collect())) == sorted(
        repr(row) for row in quality_rules.judge(messy(spark)).where("kept").select(*names).collect()
    )


def test_order_does_not_change_the_verdict(spark, judged):
    other = quality_rules.judge(messy(spark), tuple(reversed(quality_rules.RULES)), order=False).collect()
    assert sorted(map(repr, other)) == sorted(map(repr, judged))


def test_plan_has_no_python(spark):
    plan = quality_rules.judge(messy(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert quality_rules.judge(empty(spark)).count() == 0
    assert quality_rules.keep_good(empty(spark)).count() == 0
