import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from haulbook.operators import ranking
from haulbook.operators.ranking import Key

ROWS = st.lists(
    st.tuples(
        st.integers(-3, 3),
        st.integers(0, 40),
        st.text(alphabet="aäbβ", max_size=6),
    ),
    min_size=1,
    max_size=60,
)
DDL = "priority smallint, at timestamp_ntz, name string, id string"
KEYS = [Key("priority", descending=True), Key("at"), Key("name", descending=True), Key("id")]


@pytest.fixture
def narrow(monkeypatch):
    """So small that a few rows already take several passes."""
    monkeypatch.setattr(ranking, "SMALL", 2)
    monkeypatch.setattr(ranking, "BUCKETS", 3)
    monkeypatch.setattr(ranking, "TOP_K_ROWS", 0)


def frame(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    full = [(p, start + datetime.timedelta(seconds=t), name, f"{n:03d}") for n, (p, t, name) in enumerate(rows)]
    return spark.createDataFrame(full, DDL).coalesce(1).persist(), sorted(
        full, key=lambda r: (-r[0], r[1], [-b for b in r[2].encode()] + [1], r[3])
    )


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, data=st.data())
def test_first_rows_equal_a_sorted_prefix(spark, narrow, rows, data):
    found, expected = frame(spark, rows)
    count = data.draw(st.integers(0, len(rows) + 2))
    chosen = {row.id for row in ranking.first_rows(found, KEYS, count).collect()}
    assert chosen == {row[3] for row in expected[:count]}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, data=st.data())
def test_deep_page_equals_a_sorted_slice(spark, narrow, rows, data):
    found, expected = frame(spark, rows)
    offset, limit = data.draw(st.integers(0, len(rows) + 2)), data.draw(st.integers(0, 20))
    page = [row.id for row in ranking.page(found, KEYS, offset, limit).collect()]
    assert page == [row[3] for row in expected[offset : offset + limit]]


def test_weighted_rank(spark):
    rows = spark.createDataFrame([(1, 5), (2, 100), (3, 7)], "at int, n bigint")
    cut, left = ranking.cut_at(rows, [Key("at")], 50, weight="n")
    assert rows.where(cut.covers).count() == 2 and left == 45
    assert ranking.cut_at(rows, [Key("at")], 112, weight="n")[0] is None


def test_all_rows_tied_but_for_the_last_key(spark):
    rows = spark.range(20000).selectExpr("1 AS at", "cast(id AS string) AS id")
    cut, _ = ranking.cut_at(rows, [Key("at"), Key("id")], 12345)
    assert rows.where(cut.covers).count() == 12345
