import pytest
from conftest import keyed

from haulbook.plans import control


@pytest.fixture
def requests_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "request_id string, priority smallint")


@pytest.fixture
def transfers_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "request_id string, id string, priority smallint")


def acks(outcome, key="request_id"):
    return keyed(outcome.acks, "updated_count", key=key)


def rejected(outcome, key="request_id"):
    return keyed(outcome.rejected, "reason", key=key)


def test_reconsider_only_failed(all_states, requests_of):
    outcome = control.reconsider_requests(*all_states, requests_of(("R1", 0)))
    changed = keyed(outcome.changed, "status", "steps_run")
    assert changed == {"R1-03": ("pending", 0), "R1-09": ("pending", 0)}
    assert acks(outcome) == {"R1": 2} and rejected(outcome) == {}


def test_reconsider_request_without_failures_and_unknown(two_requests, requests_of):
    outcome = control.reconsider_requests(*two_requests, requests_of(("R1", 0), ("X", 0)))
    assert outcome.changed.count() == 0
    assert acks(outcome) == {"R1": 0} and rejected(outcome) == {"X": "not_found"}


def test_reconsider_single(all_states, transfers_of):
    targets = transfers_of(("R1", "R1-03", 0), ("R1", "R1-04", 0), ("R2", "R1-09", 0))
    outcome = control.reconsider_transfers(all_states[0], targets)
    assert list(keyed(outcome.changed, "status")) == ["R1-03"]
    assert acks(outcome, "id") == {"R1-03": 1, "R1-04": 0}
    assert rejected(outcome, "id") == {"R1-09": "not_found"}


def test_prioritise_pending_only(all_states, requests_of):
    outcome = control.prioritise_requests(*all_states, requests_of(("R1", 2)))
    assert keyed(outcome.changed, "status", "priority") == {"R1-00": ("pending", 2), "R1-06": ("pending", 2)}
    assert acks(outcome) == {"R1": 2}


def test_prioritise_same_value_is_no_change(two_requests, requests_of):
    outcome = control.prioritise_requests(*two_requests, requests_of(("R1", 0)))
    assert outcome.changed.count() == 0
    assert acks(outcome) == {"R1": 0} and rejected(outcome) == {}


def test_prioritise_conflict_and_unknown(make, requests_of):
    transfers = make.transfers([{"id": "a", "request": "R1", "status": "succeeded"}])
    outcome = control.prioritise_requests(transfers, make.requests(R1=0), requests_of(("R1", 1), ("X", 1)))
    assert acks(outcome) == {}
    assert rejected(outcome) == {"R1": "conflict", "X": "not_found"}


def test_prioritise_single(all_states, transfers_of):
    targets = transfers_of(("R1", "R1-00", 7), ("R1", "R1-06", 0), ("R1", "R1-01", 7), ("R2", "R1-00", 7))
    outcome = control.prioritise_transfers(all_states[0], targets)
    assert keyed(outcome.changed, "priority") == {"R1-00": 7}
    assert acks(outcome, "id") == {"R1-00": 1, "R1-06": 0}
    reasons = sorted(tuple(row) for row in outcome.rejected.collect())
    assert reasons == [("R1", "R1-01", "conflict"), ("R2", "R1-00", "not_found")]
