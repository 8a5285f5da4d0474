from conftest import at, keyed

from haulbook.operators.aggregates import count_by_status, request_status_map, summaries
from haulbook.plans import report
from haulbook.schemas import STATUSES


def test_summary_fills_missing_states_with_zero(two_requests):
    transfers, requests = two_requests
    found = {row.id: row for row in summaries(transfers, requests).collect()}
    assert [found["R1"][status] for status in STATUSES] == [10, 0, 0, 0, 0, 0]
    assert [found["R2"][status] for status in STATUSES] == [20, 0, 0, 0, 0, 0]
    assert found["R1"].submitted_at is None and found["R1"].updated_at is None


def test_summary_counts_each_state(all_states):
    transfers, requests = all_states
    found = {row.id: row for row in summaries(transfers, requests).collect()}
    assert [found["R1"][status] for status in STATUSES] == [2, 2, 2, 2, 1, 1]
    assert [found["R2"][status] for status in STATUSES] == [4, 4, 3, 3, 3, 3]


def test_status_map_has_all_states(two_requests):
    counts = keyed(request_status_map(two_requests[0]), "status_counts", key="request_id")
    assert counts["R1"] == dict.fromkeys(STATUSES, 0) | {"pending": 10}


def test_summary_times_are_first_and_last(make):
    rows = [
        {"id": "a", "request": "R1", "submitted_at": at(5), "updated_at": at(7)},
        {"id": "b", "request": "R1", "submitted_at": at(3), "updated_at": at(9)},
        {"id": "c", "request": "R1"},
    ]
    row = summaries(make.transfers(rows), make.requests(R1=0)).first()
    assert (row.submitted_at, row.updated_at) == (at(3), at(9))


def test_summary_as_map(all_states):
    row = report.with_status_map(summaries(*all_states)).where("id = 'R1'").first()
    assert row.status_counts["pending"] == 2 and "pending" not in row


def test_list_requests_pages(two_requests):
    transfers, requests = two_requests
    newest = report.list_requests(transfers, requests, 0, 1, newest_first=True)
    assert [row.id for row in newest.items.collect()] == ["R2"] and newest.total == 2
    second = report.list_requests(transfers, requests, 1, 1, newest_first=True)
    assert [row.id for row in second.items.collect()] == ["R1"]
    oldest = report.list_requests(transfers, requests, 0, 2, newest_first=False)
    assert [row.id for row in oldest.items.collect()] == ["R1", "R2"]


def test_request_without_transfers_counts_but_is_not_listed(make, two_requests):
    requests = make.requests(R1=1234, R2=1235, R3=1236)
    listed = report.list_requests(two_requests[0], requests, 0, 10)
    assert [row.id for row in listed.items.collect()] == ["R2", "R1"] and listed.total == 3


def test_request_status_reports_unknown_ids(spark, all_states):
    ids = spark.createDataFrame([("R1",), ("nobody",)], "id string")
    found = report.request_status(*all_states, ids)
    assert [row.id for row in found.found.collect()] == ["R1"]
    assert [tuple(row) for row in found.rejected.collect()] == [("nobody", "not_found")]


def test_list_transfers_pages(two_requests):
    transfers, _ = two_requests
    page = report.list_transfers(transfers, "R2", 5, 3)
    assert [row.id for row in page.items.collect()] == ["R2-05", "R2-06", "R2-07"] and page.total == 20
    last = report.list_transfers(transfers, "R2", 0, 2, descending=True)
    assert [row.id for row in last.items.collect()] == ["R2-19", "R2-18"]


def test_list_transfers_empty_pages(two_requests):
    transfers, _ = two_requests
    assert report.list_transfers(transfers, "R1", 0, 0).items.count() == 0
    assert report.list_transfers(transfers, "R1", 100, 5).items.count() == 0


def test_list_transfers_of_one_state(all_states):
    page = report.list_transfers(all_states[0], "R1", status="failed")
    assert [row.id for row in page.items.collect()] == ["R1-03", "R1-09"] and page.total == 2


def test_transfer_details_need_both_ids(spark, all_states):
    ids = spark.createDataFrame([("R1", "R1-03"), ("R2", "R1-03")], "request_id string, id string")
    found = report.transfer_details(all_states[0], ids)
    row = found.found.collect()
    assert [(r.id, r.status, r.steps_run) for r in row] == [("R1-03", "failed", 3)]
    assert [tuple(r) for r in found.rejected.collect()] == [("R2", "R1-03", "not_found")]


def test_count_by_status(all_states):
    assert keyed(count_by_status(all_states[0]), "n", key="status")["pending"] == 6
