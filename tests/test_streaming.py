import sys
from dataclasses import dataclass
from decimal import Decimal

import pytest
from conftest import keyed
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks.streams import RangeRunner, run_until_killed
from haulbook.plans.folds import apply_folded, folded
from haulbook.sources import messages
from haulbook.sources.ledger import Ledger
from haulbook.streaming import listen as listening
from haulbook.streaming import runner, stages
from haulbook.streaming.listen import Listener, commands, listen, signals, submissions, tagged, ticks
from haulbook.streaming.progress_state import read_closed, read_progress_state, start_progress_state

# The runner of this module has to reach the workers, as a user's would with --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def put(spark, folder, *values, arrival=0):
    rows = [(value, arrival + n) for n, value in enumerate(values)]
    messages.write_folder(spark.createDataFrame(rows, messages.RECORDS), folder)


def envelope(request, transfer, message):
    return f'{{"ids":{{"request":"{request}","transfer":"{transfer}"}},"message":{message}}}'


@pytest.mark.parametrize("value", ["", "{}", "[1]", '{"ids":{"request":"r"},"message":1}', envelope("r", "t", "1")[:-1]])
def test_malformed_envelopes(spark, value):
    records = spark.createDataFrame([(value, 1), (envelope("r", "t", "[0,{}]"), 2)], messages.RECORDS)
    with pytest.raises(Exception, match="(?i)malformed"):
        messages.decode(records).collect()
    lenient = messages.decode(records, strict=False)
    assert [tuple(row) for row in messages.quarantined(lenient).collect()] == [(1, value)]
    assert messages.as_progress(messages.sound(lenient)).first()[:4] == ("r", "t", 0, "{}")


def keep_state(spark, tmp_path, **options):
    query = start_progress_state(streams(spark, tmp_path), f"{tmp_path}/closed", f"{tmp_path}/state", **options)
    query.awaitTermination()
    return keyed(read_progress_state(spark, f"{tmp_path}/state"), "step", "info", key="transfer_id")


def closed(spark, tmp_path):
    return sorted((row.transfer_id, row.step, row.how) for row in read_closed(spark, f"{tmp_path}/closed").collect())


def test_malformed_record_stops_the_stream(spark, tmp_path):
    put(spark, f"{tmp_path}/progress", "oops")
    with pytest.raises(PySparkException):
        keep_state(spark, tmp_path)


def test_state_goes_on_where_it_stopped_and_ends_with_results(spark, tmp_path):
    put(spark, f"{tmp_path}/progress", envelope("r", "a", '[3,"x"]'), envelope("r", "b", '[1,"y"]'), envelope("r", "b", '[1,"z"]'))
    assert keep_state(spark, tmp_path) == {"a": (3, '"x"'), "b": (1, '"y"')}
    put(spark, f"{tmp_path}/progress", envelope("r", "a", '[2,"late"]'), envelope("r", "b", '[2,"z"]'), arrival=10)
    assert keep_state(spark, tmp_path) == {"a": (3, '"x"'), "b": (2, '"z"')}
    put(spark, f"{tmp_path}/results", envelope("r", "a", '["SUCCESS",{}]'), envelope("r", "never", '["SUCCESS",{}]'), arrival=20)
    assert keep_state(spark, tmp_path) == {"b": (2, '"z"')}
    # Progress that comes after the result opens nothing.
    put(spark, f"{tmp_path}/progress", envelope("r", "a", '[4,"later"]'), envelope("s", "a", '[0,"other"]'), arrival=30)
    assert keep_state(spark, tmp_path) == {"b": (2, '"z"'), "a": (0, '"other"')}
    assert closed(spark, tmp_path) == [("a", 3, "ended"), ("never", None, "ended")]


def test_timers_remove_what_is_silent_or_ended(spark, tmp_path):
    put(spark, f"{tmp_path}/progress", envelope("r", "quiet", '[3,"x"]'), envelope("r", "done", '[1,"y"]'))
    put(spark, f"{tmp_path}/results", envelope("r", "done", '["SUCCESS",{}]'))
    options = {"silence_millis": 1, "linger_millis": 1}
    assert keep_state(spark, tmp_path, **options) == {"quiet": (3, '"x"')}
    put(spark, f"{tmp_path}/progress", envelope("r", "new", '[0,"n"]'), arrival=10)
    assert keep_state(spark, tmp_path, **options) == {"new": (0, '"n"')}
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() == 1
    assert closed(spark, tmp_path) == [("done", 1, "ended"), ("quiet", 3, "silent")]


def test_transfers_of_a_group_share_an_entry_and_keep_their_own_times(spark, tmp_path):
    names = [f"t{n}" for n in range(200)]
    put(spark, f"{tmp_path}/progress", *(envelope("r", name, '[2,"x"]') for name in names))
    assert keep_state(spark, tmp_path, groups=3, silence_millis=1) == {name: (2, '"x"') for name in names}
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() == 3
    # A message keeps its own transfer alone, and a result ends one; the others have been silent.
    put(spark, f"{tmp_path}/progress", envelope("r", "t7", '[1,"late"]'), arrival=1000)
    put(spark, f"{tmp_path}/results", envelope("r", "t8", '["SUCCESS",{}]'), arrival=1000)
    assert keep_state(spark, tmp_path, groups=3) == {"t7": (2, '"x"')}
    silent = [(name, 2, "silent") for name in names if name not in ("t7", "t8")]
    assert closed(spark, tmp_path) == sorted([*silent, ("t8", 2, "ended")])


@pytest.fixture
def ledger(spark, make, tmp_path):
    rows = [{"id": f"t{n}", "request": "R1", "body": f'{{"i":{n}}}'} for n in range(6)]
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=2)
    ledger.load(make.transfers(rows), make.requests(R1=0))
    return ledger


def streams(spark, tmp_path):
    for name in ("progress", "results"):
        (tmp_path / name).mkdir(exist_ok=True)
    progress = messages.as_progress(messages.decode(messages.folder_stream(spark, f"{tmp_path}/progress")))
    results = messages.as_results(messages.decode(messages.folder_stream(spark, f"{tmp_path}/results")))
    return signals(progress, results)


def sent_by(spark, tmp_path):
    sent = messages.as_requests(messages.decode(messages.read_folder(spark, f"{tmp_path}/outbox/*")))
    return sorted((row.transfer_id, row.body) for row in sent.collect())


def test_messages_are_reduced_once_for_all_parts_of_the_ledger(spark, ledger, tmp_path, monkeypatch):
    """The second batch finds the snapshot and the images of the first."""
    calls, parts = [], []
    monkeypatch.setattr(listening, "folded", lambda rows: calls.append(1) or folded(rows))
    monkeypatch.setattr(listening, "apply_folded", lambda part, *rest: parts.append(1) or apply_folded(part, *rest))
    for number in range(2):
        put(spark, f"{tmp_path}/results", *(envelope("R1", f"t{n}", '["SUCCESS",{}]') for n in (number, 4)), arrival=10 * number)
        listen(streams(spark, tmp_path), Listener(ledger), available_now=True).awaitTermination()
    assert (len(calls), len(parts)) == (2, 3)
    assert {row.id: row.steps_run for row in ledger.transfers().where("status = 'succeeded'").collect()} == {"t0": 0, "t1": 0, "t4": 1}


def test_sweeps_and_folds_to_the_end(spark, ledger, tmp_path):
    """Two slots: every round ends what is in flight, and the next two are submitted."""
    listener = Listener(ledger, max_in_flight=2, outbox=f"{tmp_path}/outbox")
    put(spark, f"{tmp_path}/ticks", "tick")
    stream = streams(spark, tmp_path).unionByName(ticks(messages.folder_stream(spark, f"{tmp_path}/ticks")))
    listen(stream, listener, available_now=True).awaitTermination()
    put(spark, f"{tmp_path}/progress", envelope("R1", "t0", '[0,{"at":0}]'))
    for number in range(3):
        done = [envelope("R1", f"t{n}", '["SUCCESS",{}]') for n in (2 * number, 2 * number + 1)]
        put(spark, f"{tmp_path}/results", *done, arrival=number * 10)
        listen(stream, listener, available_now=True).awaitTermination()
    found = keyed(ledger.transfers(), "status", "steps_run")
    assert found == {"t0": ("succeeded", 1)} | {f"t{n}": ("succeeded", 0) for n in range(1, 6)}
    assert sent_by(spark, tmp_path) == [(f"t{n}", f'{{"i":{n}}}') for n in range(6)]


def test_unknown_parents_are_set_aside_unless_strict(spark, ledger, make):
    results = tagged("fold", make.results([("R1", "nobody", "EXPANDED", "[1]"), ("R1", "t0", "EXPANDED", "[1,2]")]))
    with pytest.raises(PySparkException):
        Listener(ledger).handle(results, 0)
    Listener(ledger, strict=False).handle(results, 0)
    assert ledger.transfers(before=1).count() == 8
    assert spark.read.parquet(f"{ledger.root}/rejected/batch=0").first().transfer_id == "nobody"


def test_unknown_kinds_are_refused(spark, ledger, make):
    with pytest.raises(ValueError, match="unknown kinds"):
        Listener(ledger).handle(tagged("fold", make.progress([])).unionByName(tagged("gossip", make.progress([("R1", "t0", 1, "")]))), 0)


BULK = "request_id string, transfers array<struct<payload: string, priority: smallint>>, defaults struct<payload: string, priority: smallint>, arrival long"


def bulk(spark, *rows):
    return submissions(spark.createDataFrame([(*row, at) for at, row in enumerate(rows)], BULK))


def targets(spark, kind, *rows):
    return commands(kind, spark.createDataFrame(rows, "request_id string, id string, priority smallint, arrival long"))


def test_a_batch_of_everything_takes_effect_in_order(spark, ledger, make):
    """A new request is re-prioritised, a failed transfer reconsidered and both submitted, all in one batch."""
    schema = '{"type": "object", "properties": {"n": {"type": "integer"}}}'
    listener = Listener(ledger, max_in_flight=2, schema=schema)
    failed = make.results([("R1", "t3", "FATAL_FAILURE", "{}"), ("R1", "t4", "SUCCESS", "{}")])
    Listener(ledger).handle(tagged("fold", failed), 0)
    items = [('{"n":1}', 1), ("{}", None), ('{"n":3}', None)]
    new = bulk(spark, ("R2", items, ('{"n":2}', 4)), ("R3", [('{"n":"x"}', None)], None), ("R1", [("{}", None)], None), ("R2", [], None))
    again = targets(spark, "reconsider_transfers", ("R1", "t3", None, 1), ("R1", "t4", None, 2), ("R1", "nobody", None, 3))
    first = targets(spark, "prioritise_transfers", ("R1", "t3", 5, 1), ("R1", "t3", 8, 2), ("R1", "t4", 9, 3))
    whole = targets(spark, "prioritise_requests", ("R2", None, 7, 1), ("none", None, 7, 2))
    result = tagged("fold", make.results([("R1", "t5", "SUCCESS", "1")]))
    listener.handle(first.unionByName(whole).unionByName(again).unionByName(new).unionByName(result), 1)
    found = keyed(ledger.transfers(before=2), "request_id", "status", "priority", "body")
    assert found["t3"][:3] == ("R1", "submitted", 8) and found["t5"][1] == "succeeded"
    second = {row[3]: row[1:3] for row in found.values() if row[0] == "R2"}
    assert set(second) == {'{"n":1}', '{"n":2}', '{"n":3}'} and all(priority == 7 for _, priority in second.values())
    assert sorted(status for status, _ in second.values()) == ["pending", "pending", "submitted"]
    assert sorted(keyed(ledger.requests(before=2), "received_at")) == ["R1", "R2"]
    answers = sorted(
        (row.kind, row.request_id, row.transfer_id or "", row.updated_count, row.reason)
        for row in listener.replies(spark).collect()
    )
    assert answers == sorted([
        ("submit", "R2", "", 3, None), ("submit", "R3", "", None, "invalid"), ("submit", "R1", "", None, "conflict"),
        ("reconsider_transfers", "R1", "t3", 1, None), ("reconsider_transfers", "R1", "t4", 0, None),
        ("reconsider_transfers", "R1", "nobody", None, "not_found"), ("prioritise_requests", "R2", "", 3, None),
        ("prioritise_requests", "none", "", None, "not_found"), ("prioritise_transfers", "R1", "t3", 1, None),
        ("prioritise_transfers", "R1", "t4", None, "conflict"),
    ], key=lambda row: row[:3])


def test_reconsidered_requests(spark, ledger, make):
    listener = Listener(ledger)
    listener.handle(tagged("fold", make.results([("R1", f"t{n}", "FATAL_FAILURE", "{}") for n in (0, 1)])), 0)
    listener.handle(targets(spark, "reconsider_requests", ("R1", None, None, 0), ("R1", None, None, 1), ("R9", None, None, 2)), 1)
    assert keyed(ledger.transfers(before=2), "status") == {f"t{n}": "pending" for n in range(6)}
    assert sorted((row.request_id, row.updated_count, row.reason) for row in listener.replies(spark).collect()) == [
        ("R1", 2, None), ("R9", None, "not_found")
    ]


def test_a_killed_batch_is_processed_again_to_the_same_state(spark, ledger, make, tmp_path):
    """Killed between write and commit, and, the second time, between two stages; snapshots are taken in between."""
    ledger.every = 1
    put(spark, f"{tmp_path}/progress", envelope("R1", "t0", '[0,{"at":0}]'))
    put(spark, f"{tmp_path}/results", envelope("R1", "t1", '["EXPANDED",[1,2]]'))
    options = {"max_in_flight": 3, "outbox": f"{tmp_path}/outbox"}
    run_until_killed(streams(spark, tmp_path), ledger, **options)
    assert ledger.next_batch() == 0 and ledger.transfers().count() == 6
    listen(streams(spark, tmp_path), Listener(ledger, **options), available_now=True).awaitTermination()
    state = keyed(ledger.transfers(), "status", "steps_run")
    assert len(state) == 8 and sorted(status for status, _ in state.values()).count("submitted") == 3
    sent = sent_by(spark, tmp_path)

    class Broken(Listener):
        def sweep(self, batch):
            raise InterruptedError

    put(spark, f"{tmp_path}/results", envelope("R1", sent[0][0], '["SUCCESS",{}]'), arrival=9)
    with pytest.raises(PySparkException):
        listen(streams(spark, tmp_path), Broken(ledger, **options), available_now=True).awaitTermination()
    assert keyed(ledger.transfers(), "status", "steps_run") == state
    listen(streams(spark, tmp_path), Listener(ledger, **options), available_now=True).awaitTermination()
    after = keyed(ledger.transfers(), "status")
    assert after[sent[0][0]] == "succeeded" and sorted(after.values()).count("submitted") == 3
    assert len(sent_by(spark, tmp_path)) == 4 == len({name for name, _ in sent_by(spark, tmp_path)})


def test_ticking(spark, ledger, tmp_path):
    """A writer without messages sweeps by itself."""
    query = listen(streams(spark, tmp_path), Listener(ledger, max_in_flight=3), ticking=True)
    try:
        for _ in range(200):
            if ledger.next_batch() > 0 or query.exception():
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    assert ledger.transfers().where("status = 'submitted'").count() == 3


# --- runner and stages


@dataclass(frozen=True)
class Odd:
    """Fails in each way a user's code can."""

    def initialize(self, request):
        if request == "plain":
            raise ValueError("no luck")
        if request == "silent":
            raise ValueError
        if request == "caused":
            raise ValueError("outer") from KeyError("inner")
        return request

    def step(self, progress):
        raise RuntimeError("OH NO")


def run(spark, payloads):
    rows = [("R", f"t{n}", payload, n) for n, payload in enumerate(payloads)]
    frame = spark.createDataFrame(rows, "request_id string, transfer_id string, body string, arrival bigint")
    return [(row.is_done, row.signal, row.info) for row in runner.initialize(frame, Odd()).collect()]


def test_failures_become_results(spark):
    prefix = '{"message":"Unhandled error initializing transfer'
    found = run(spark, ['"plain"', '"silent"', '"caused"', '"not a step"'])
    assert found[:3] == [
        (True, "FATAL_FAILURE", prefix + ': no luck","detail":null}'),
        (True, "FATAL_FAILURE", prefix + '","detail":null}'),
        (True, "FATAL_FAILURE", prefix + """: outer","detail":"'inner'"}"""),
    ]
    assert found[3][1] == "FATAL_FAILURE" and "not a step" in found[3][2]
    assert run(spark, ["not json"])[0][1] == "FATAL_FAILURE"


def test_failing_step(spark):
    frame = spark.createDataFrame(
        [("R", "t", 4, "{}", 0)], "request_id string, transfer_id string, step int, info string, arrival bigint"
    )
    row = runner.advance(frame, Odd()).first()
    assert (row.step, row.is_done, row.signal) == (5, True, "FATAL_FAILURE")
    assert row.info == '{"message":"Unhandled error running step on transfer: OH NO","detail":null}'


def test_stages_interleave_and_end(spark, tmp_path):
    topics = stages.Topics(f"{tmp_path}/topics")
    sizes = {"long": 401, "quick": 90, "none": 0, "bad": -1}
    values = [envelope("R", name, f'{{"object":"{name}","size":{size}}}') for name, size in sizes.items()]
    put(spark, f"{topics.requests}/initial", *values)
    stages.run_until_done(spark, topics, RangeRunner(), f"{tmp_path}/work")
    results = messages.as_results(messages.decode(messages.read_folder(spark, f"{topics.results}/*")))
    found = keyed(results, "signal", "info", "arrival", key="transfer_id")
    assert found["long"][:2] == ("SUCCESS", '{"bytes":401,"object":"long"}')
    assert found["quick"][:2] == ("SUCCESS", '{"bytes":90,"object":"quick"}')
    assert found["quick"][2] < found["long"][2]
    assert found["none"][:2] == ("SUCCESS", '{"bytes":0,"object":"none"}')
    assert found["bad"][0] == "FATAL_FAILURE"
    progress = messages.as_progress(messages.decode(messages.read_folder(spark, f"{topics.progress}/*")))
    steps = progress.where("transfer_id = 'long'").agg(F.sort_array(F.collect_list("step"))).first()[0]
    assert steps == [0, 1, 2, 3, 4]


def test_requests_join_a_running_stage(spark, tmp_path):
    """One query: what comes in while others are under way takes its first step in the batch of their next ones."""
    topics = stages.Topics(f"{tmp_path}/topics")
    put(spark, f"{topics.requests}/a", *(envelope("R", f"a{size}", f'{{"object":"a","size":{size}}}') for size in (150, 950)))
    query = stages.start_folder_stages(spark, topics, RangeRunner(), f"{tmp_path}/work")
    try:
        while not list((tmp_path / "work/checkpoint/commits").glob("1")):
            assert query.exception() is None
            query.awaitTermination(0.1)
        put(spark, f"{topics.requests}/b", envelope("R", "b", '{"object":"b","size":250}'))
        query.processAllAvailable()
    finally:
        query.stop()
    steps = spark.read.parquet(f"{tmp_path}/work/steps")
    found = {
        name: [tuple(row) for row in steps.where(F.col("transfer_id") == name).orderBy("step").select("step", "batch", "is_done").collect()]
        for name in ("a150", "a950", "b")
    }
    for rows in found.values():
        # A step per batch, without a gap.
        assert [row[1] - rows[0][1] for row in rows] == [row[0] for row in rows] and [row[2] for row in rows].count(True) == 1
    assert [len(rows) for rows in found.values()] == [3, 11, 4]
    assert found["a950"][0][1] < found["b"][0][1] <= found["a950"][-1][1]
    results = messages.as_results(messages.decode(messages.read_folder(spark, f"{topics.results}/*")))
    assert sorted(row.transfer_id for row in results.collect()) == ["a150", "a950", "b"]


@dataclass(frozen=True)
class Together(Odd):
    """Takes its payloads many at a time."""

    def step_batch(self, progress):
        return [runner.Done({"n": len(progress)}) if value else ValueError("no value") for value in progress]


def test_a_runner_may_take_batches(spark):
    rows = [("r", f"t{n}", 0, text, Decimal(n)) for n, text in enumerate(["1", "0", "2"])]
    frame = spark.createDataFrame(rows, "request_id string, transfer_id string, step int, info string, arrival decimal(38,0)")
    found = runner.advance(frame.coalesce(1), Together()).orderBy("transfer_id").collect()
    assert [row.signal for row in found] == ["SUCCESS", "FATAL_FAILURE", "SUCCESS"]
    assert found[0].info == '{"n":3}' and "no value" in found[1].info and found[2].arrival == 2


def test_kafka_arrival_orders_and_identifies(spark):
    rows = [("2024-01-01 00:00:01", 0, 5), ("2024-01-01 00:00:00", 7, 9), ("2024-01-01 00:00:01", 12, 2**63 - 1)]
    frame = spark.createDataFrame(rows, "t string, partition int, offset bigint")
    found = frame.select(messages.kafka_arrival(F.col("t").cast("timestamp"), F.col("partition"), F.col("offset"))).collect()
    values = [row[0] for row in found]
    assert values[1] < values[0] < values[2] and len(set(values)) == 3 and None not in values
