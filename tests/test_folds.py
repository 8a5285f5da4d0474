import json

import pytest
from conftest import at, keyed
from pyspark.errors import PySparkException

from haulbook.plans import folds
from haulbook.sources.ledger import Ledger


@pytest.fixture(scope="module")
def ledger(make):
    """R1 and R2 submitted, R3 submitted with priority 2."""
    rows = [{"id": f"R1-{n:02d}", "request": "R1", "status": "submitted"} for n in range(50)]
    rows += [{"id": f"R2-{n:02d}", "request": "R2", "status": "submitted"} for n in range(20)]
    rows += [{"id": f"R3-{n:02d}", "request": "R3", "status": "submitted", "priority": 2} for n in range(2)]
    return make.transfers(rows), make.requests(R1=0, R2=1, R3=2)


def test_results_set_state_info_and_steps(ledger, make, now):
    rows = []
    for n in range(50):
        if n % 3:
            rows.append(("R1", f"R1-{n:02d}", "SUCCESS" if n % 3 == 1 else "FATAL_FAILURE", f'{{"i+1":{n}}}'))
    changed = folds.apply_results(ledger[0], make.results(rows), now)
    found = keyed(changed, "status", "info", "steps_run", "updated_at")
    assert len(found) == 33
    assert found["R1-01"] == ("succeeded", '{"i+1":1}', 0, at(9000))
    assert found["R1-02"] == ("failed", '{"i+1":2}', 0, at(9000))


def test_last_result_wins_and_each_counts_as_a_step(ledger, make, now):
    rows = [("R1", "R1-00", "SUCCESS", "1"), ("R1", "R1-00", "FATAL_FAILURE", "2"), ("R1", "R1-00", "SUCCESS", "3")]
    changed = folds.apply_results(ledger[0], make.results(rows), now)
    assert keyed(changed, "status", "info", "steps_run") == {"R1-00": ("succeeded", "3", 2)}


def test_mismatched_ids_change_nothing(ledger, make, now):
    results = make.results([("R2", "R1-00", "SUCCESS", "{}"), ("R1", "nobody", "SUCCESS", "{}")])
    assert folds.apply_results(ledger[0], results, now).count() == 0
    progress = make.progress([("R2", "R1-00", 1, "{}"), ("R1", "nobody", 1, "{}")])
    assert folds.apply_progress(ledger[0], progress, now).count() == 0


def test_unknown_signal_fails(ledger, make, now):
    changed = folds.apply_results(ledger[0], make.results([("R1", "R1-00", "MAYBE", "{}")]), now)
    with pytest.raises(PySparkException, match="unknown result signal"):
        changed.collect()


def test_highest_step_wins_within_a_batch(ledger, make, now):
    rows = [("R1", "R1-00", step, str(info)) for info, step in enumerate((3, 2, 1))]
    changed = folds.apply_progress(ledger[0], make.progress(rows), now)
    assert keyed(changed, "status", "info", "steps_run") == {"R1-00": ("inprogress", "0", 3)}


def test_first_of_equal_steps_wins(ledger, make, now):
    rows = [("R1", "R1-00", step, str(info)) for info, step in enumerate((1, 4, 4, 2))]
    changed = folds.apply_progress(ledger[0], make.progress(rows), now)
    assert keyed(changed, "info", "steps_run") == {"R1-00": ("1", 4)}


def test_batches_one_by_one_equal_one_batch(spark, ledger, make, now, tmp_path):
    log = Ledger(spark, f"{tmp_path}/ledger")
    log.load(ledger[0])
    for info, step in enumerate((1, 2, 3, 4, 3, 2, 1)):
        progress = make.progress([("R1", "R1-00", step, str(info))])
        log.append(info, transfers=folds.apply_progress(log.transfers(before=info), progress, now))
    assert keyed(log.transfers(before=7).where("id = 'R1-00'"), "info", "steps_run") == {"R1-00": ("3", 4)}


def test_ended_and_pending_rows_ignore_progress(all_states, make, now):
    rows = [("R1", f"R1-{n:02d}", 9, "{}") for n in range(10)]
    changed = keyed(folds.apply_progress(all_states[0], make.progress(rows), now), "status")
    assert sorted(changed) == ["R1-01", "R1-02", "R1-07", "R1-08"]


def test_step_zero_counts_for_new_but_not_for_reconsidered(make, now):
    rows = [{"id": "new", "request": "R", "status": "submitted", "steps": -1}]
    rows += [{"id": "again", "request": "R", "status": "submitted", "steps": 0}]
    progress = make.progress([("R", "new", 0, "{}"), ("R", "again", 0, "{}")])
    assert list(keyed(folds.apply_progress(make.transfers(rows), progress, now), "status")) == ["new"]


def test_merged_fold_equals_progress_then_results(all_states, make, now):
    progress = make.progress([("R1", f"R1-{n:02d}", n, f"p{n}") for n in range(10)])
    results = make.results([("R1", f"R1-{n:02d}", "SUCCESS", f"r{n}") for n in range(0, 10, 2)] * 2)
    transfers = all_states[0]
    first = folds.apply_progress(transfers, progress, now)
    between = transfers.join(first, "id", "left_anti").unionByName(first)
    second = folds.apply_results(between, results, now)
    expected = first.join(second, "id", "left_anti").unionByName(second)
    merged = folds.apply_messages(transfers, progress, results, now)
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_expansion(ledger, make, now):
    transfers, requests = ledger
    rows = [("R3", f"R3-{n:02d}", "EXPANDED", f'[{{"child":{n}}}]') for n in range(2)]
    results = make.results(rows)
    expansion = folds.expand(transfers, results, requests)
    children = expansion.children.collect()
    assert sorted((c.request_id, c.status, c.body, c.steps_run, c.priority) for c in children) == [
        ("R3", "pending", '{"child":0}', -1, 2),
        ("R3", "pending", '{"child":1}', -1, 2),
    ]
    parents = keyed(folds.apply_results(transfers, results, now), "status", "info")
    assert {status for status, _ in parents.values()} == {"expanded"}
    listed = [child for _, info in parents.values() for child in json.loads(info)["expandedTo"]]
    assert sorted(listed) == sorted(child.id for child in children)


def test_expansion_into_nothing(ledger, make, now):
    transfers, requests = ledger
    results = make.results([("R3", "R3-00", "EXPANDED", "[]")])
    assert folds.expand(transfers, results, requests).children.count() == 0
    assert keyed(folds.apply_results(transfers, results, now), "info") == {"R3-00": '{"expandedTo":[]}'}


def test_each_expansion_message_has_children_of_its_own(ledger, make):
    results = make.results([("R3", "R3-00", "EXPANDED", '[{"a":1}]')] * 2)
    ids = [child.id for child in folds.expand(*[ledger[0], results, ledger[1]]).children.collect()]
    assert len(set(ids)) == 2


def test_expansion_under_another_request(ledger, make):
    results = make.results([("R1", "R3-00", "EXPANDED", '[{"a":1}]')])
    child = folds.expand(ledger[0], results, ledger[1]).children.first()
    assert (child.request_id, child.priority) == ("R1", 2)


def test_expansion_of_unknown_transfers(ledger, make):
    rows = [("R3", "nobody", "EXPANDED", "[1]"), ("X", "R3-00", "EXPANDED", "[1]"), ("R3", "R3-01", "EXPANDED", "[1]")]
    results = make.results(rows)
    with pytest.raises(PySparkException, match="unknown transfer|unknown request"):
        folds.expand(ledger[0], results, ledger[1]).children.collect()
    lenient = folds.expand(ledger[0], results, ledger[1], strict=False)
    assert lenient.children.count() == 1
    assert keyed(lenient.rejected, "reason", key="transfer_id") == {
        "nobody": "unknown transfer",
        "R3-00": "unknown request",
    }


def test_expansion_must_carry_a_list(ledger, make):
    results = make.results([("R3", "R3-00", "EXPANDED", '{"a":1}')])
    with pytest.raises(PySparkException):
        folds.expand(ledger[0], results, ledger[1]).children.collect()
