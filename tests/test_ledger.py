import pytest
from conftest import keyed
from pyspark.sql import functions as F

from haulbook.operators import joins
from haulbook.plans import control, folds, report
from haulbook.sources.ledger import Ledger


def changed(make, status, *ids):
    return make.transfers([{"id": name, "request": "R1", "status": status} for name in ids])


def test_new_ledger_is_empty(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.transfers().count() == 0 and ledger.requests().count() == 0 and ledger.next_batch() == 0
    assert ledger.open_transfers(before=70).count() == 0


def test_last_image_wins(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=4)
    ledger.load(changed(make, "pending", "a", "b", "c"), make.requests(R1=0))
    ledger.append(0, transfers=changed(make, "submitted", "a", "b"))
    ledger.append(1, stage=2, transfers=changed(make, "inprogress", "b"))
    ledger.append(1, stage=5, transfers=changed(make, "failed", "b", "d"), requests=make.requests(R2=1))
    expected = {"a": "submitted", "b": "failed", "c": "pending", "d": "failed"}
    assert keyed(ledger.transfers(before=2), "status") == expected
    assert keyed(ledger.open_transfers(before=2), "status") == {"a": "submitted", "c": "pending"}
    assert keyed(ledger.transfers(before=1, stage=5), "status") == {"a": "submitted", "b": "inprogress", "c": "pending"}
    assert keyed(ledger.transfers(before=1), "status") == {"a": "submitted", "b": "submitted", "c": "pending"}
    assert keyed(ledger.transfers(before=0), "status") == {"a": "pending", "b": "pending", "c": "pending"}
    assert ledger.requests(before=1).count() == 1 and ledger.requests(before=2).count() == 2


def test_a_batch_that_comes_again_replaces_its_own_rows(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    ledger.load(changed(make, "pending", "a", "b"))
    ledger.append(0, transfers=changed(make, "failed", "a", "b"))
    ledger.append(0, transfers=changed(make, "failed", "a"))
    assert keyed(ledger.transfers(before=1), "status") == {"a": "failed", "b": "pending"}


def test_only_committed_batches_are_read_by_default(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    ledger.load(changed(make, "pending", "a"))
    ledger.append(0, transfers=changed(make, "failed", "a"))
    assert keyed(ledger.transfers(), "status") == {"a": "pending"}
    commits = tmp_path / "ledger/checkpoint/commits"
    commits.mkdir(parents=True)
    (commits / "0").touch()
    assert keyed(ledger.transfers(), "status") == {"a": "failed"} and ledger.next_batch() == 1


@pytest.mark.parametrize("buckets", [None, 2])
def test_snapshots_keep_the_state_at_every_batch(spark, make, tmp_path, buckets):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=buckets, every=2)
    expected = {}
    for batch in range(6):
        ledger.fold_if_due(batch)
        ledger.append(batch, transfers=changed(make, "failed", f"t{batch}", "all"), requests=make.requests(**{f"R{batch}": batch}))
        ledger.append(batch, 3, transfers=changed(make, "pending", f"u{batch}"))
        expected |= {f"t{batch}": "failed", "all": "failed", f"u{batch}": "pending"}
        assert keyed(ledger.transfers(before=batch + 1), "status") == expected
        assert ledger.open_transfers(before=batch + 1).count() == batch + 1
        assert ledger.requests(before=batch + 1).count() == batch + 1
    assert sorted(path.name for path in (tmp_path / "ledger/transfers/snapshot").iterdir()) == ["before=2", "before=4"]
    # A batch that comes again after a snapshot was taken before it finds the state it had.
    assert keyed(ledger.transfers(before=3), "status") == {k: v for k, v in expected.items() if k[1:] in ("0", "1", "2", "ll")}


def test_a_snapshot_that_was_cut_off_is_taken_again(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=2, every=2)
    ledger.append(0, transfers=changed(make, "pending", "a"))
    ledger.append(1, transfers=changed(make, "failed", "b"))
    ledger.fold_if_due(2)
    next((tmp_path / "ledger/transfers/snapshot/before=2").glob("*/_SUCCESS")).unlink()
    assert keyed(ledger.transfers(before=2), "status") == {"a": "pending", "b": "failed"}
    ledger.fold_if_due(2)
    assert keyed(ledger.transfers(before=2), "status") == {"a": "pending", "b": "failed"}
    assert list((tmp_path / "ledger/transfers/snapshot/before=2").glob("*/_SUCCESS"))


def test_snapshot_survives_the_session(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=4)
    ledger.load(changed(make, "pending", "a", "b").unionByName(changed(make, "failed", "c")), make.requests(R1=0))
    ledger.append(0, transfers=changed(make, "failed", "b"), requests=make.requests(R2=1))
    other = Ledger(spark.newSession(), f"{tmp_path}/ledger")
    for table in spark.catalog.listTables():
        if table.name.startswith("haulbook_"):
            spark.sql(f"DROP TABLE {table.name}")
    assert keyed(other.transfers(before=1), "status") == {"a": "pending", "b": "failed", "c": "failed"}
    assert keyed(other.open_transfers(before=1), "status") == {"a": "pending"}
    assert sorted(keyed(other.requests(before=1), "received_at")) == ["R1", "R2"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_snapshot_is_not_shuffled_for_a_join_by_id(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=4)
    ledger.load(changed(make, "pending", *[f"t{n}" for n in range(100)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ledger.transfers().join(changed(make, "failed", "t1").select("id").distinct(), "id")
        plan = plan_of(joined)
        assert "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning") == 1
        assert joined.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_reach_the_scans_and_old_appends_are_not_listed(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", every=2)
    ledger.load(changed(make, "pending", "a", "b"))
    for batch in range(4):
        ledger.fold_if_due(batch)
        ledger.append(batch, transfers=changed(make, "failed", "a"))
    transfers = ledger.transfers(before=4)
    assert "EqualTo(status,pending)" in plan_of(transfers.where("status = 'pending'").select("id"))
    files = transfers.inputFiles()
    assert not any("after=0" in file or "before=0" in file for file in files) and any("after=2" in file for file in files)


def test_admission_leaves_the_ended_part_unread(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=2)
    ended = changed(make, "succeeded", *[f"e{n}" for n in range(50)])
    ledger.load(ended.unionByName(changed(make, "pending", "a", "b")))
    ledger.append(0, transfers=changed(make, "pending", "e1").unionByName(changed(make, "failed", "a")))
    opened = ledger.open_transfers(before=1)
    plan = plan_of(opened)
    assert "PartitionFilters: [isnotnull(ended" in plan and "NOT ended" in plan
    assert keyed(opened, "status") == {"b": "pending", "e1": "pending"}


def test_folding_does_not_shuffle_the_snapshot(spark, make, now, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=4)
    ledger.load(changed(make, "submitted", *[f"t{n}" for n in range(20)]))
    ledger.append(0, transfers=changed(make, "submitted", "t1"))
    results = make.results([("R1", "t1", "SUCCESS", "1"), ("R1", "t2", "SUCCESS", "2"), ("R2", "t3", "SUCCESS", "3")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folded = [folds.apply_results(part, results, now) for part in ledger.parts(before=1)]
        # Two for the messages (by transfer and request, then by transfer) and one for the changed ids.
        assert plan_of(folded[0]).count("Exchange hashpartitioning") == 3
        found = [keyed(part, "status") for part in folded]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [{"t2": "succeeded"}, {"t1": "succeeded"}]


def shuffled_before_a_join(frame):
    """Whether the snapshot is exchanged before it is first joined."""
    lines = plan_of(frame).split("\n")
    place = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
    found = False
    for at, line in enumerate(lines):
        if "haulbook_transfers" not in line:
            continue
        level = place[at]
        for above in range(at - 1, -1, -1):
            if place[above] < level:
                level = place[above]
                if "Join" in lines[above]:
                    break
                found |= "Exchange" in lines[above]
    return found


def test_few_ids_do_not_shuffle_the_snapshot(spark, make, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=4)
    ledger.load(changed(make, "failed", *[f"t{n}" for n in range(50)]), make.requests(R1=0))
    targets = spark.createDataFrame([("R1", "t1"), ("R1", "none")], "request_id string, id string")
    with_priority = targets.withColumn("priority", F.lit(3))
    results = make.results([("R1", "t1", "EXPANDED", "[1]")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        transfers, requests = ledger.transfers(), ledger.requests()
        keys = ["request_id", "id"]
        outcomes = (control.reconsider_transfers(transfers, targets), control.prioritise_transfers(transfers, with_priority))
        details = report.transfer_details(transfers, targets)
        plans = [joins.existing(targets, transfers, keys), joins.missing(targets, transfers, keys)]
        plans += [joins.parent_priority(results, transfers), folds.expand(transfers, results, requests).children]
        plans += [frame for outcome in outcomes for frame in (outcome.changed, outcome.acks, outcome.rejected)]
        plans += [details.found, details.rejected]
        assert shuffled_before_a_join(targets.join(transfers.select(*keys), keys, "left_semi"))
        assert [at for at, frame in enumerate(plans) if shuffled_before_a_join(frame)] == []
        assert [frame.count() for frame in plans] == [1, 1, 1, 1, 1, 1, 1, 0, 0, 2, 1, 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
