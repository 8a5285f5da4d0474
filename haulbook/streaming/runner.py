"""The plug-in point for user code that moves one transfer ahead by one step.

A runner has two functions. `initialize` turns a request payload into the first `Progress`, or ends the transfer at once
with `Done` or `Expanded`; `step` turns a progress payload into the next `Progress` or `Done`. Raising an exception ends
the transfer as failed. Payloads are JSON values; runners are pickled to the executors, so they hold settings, not
connections.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a failure message starts with, by stage.
INIT_FAILURE = "Unhandled error initializing transfer"
STEP_FAILURE = "Unhandled error running step on transfer"

#: A step taken: `is_done` with a signal, or not done with the number of steps so far; `info` is JSON text.
STEPS_DDL = (
    "request_id string, transfer_id string, step int, is_done boolean, signal string, info string, arrival bigint"
)


@dataclass(frozen=True)
class Progress:
    value: Any


@dataclass(frozen=True)
class Done:
    value: Any


@dataclass(frozen=True)
class Expanded:
    requests: list[Any]


class Runner(Protocol):
    def initialize(self, request: Any) -> Progress | Done | Expanded: ...

    def step(self, progress: Any) -> Progress | Done: ...


def _failure(description: str, problem: Exception) -> dict[str, str | None]:
    text = str(problem)
    cause = problem.__cause__
    return {
        "message": f"{description}: {text}" if text else description,
        "detail": (str(cause) or None) if cause is not None else None,
    }


def _text(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _outcome(call: Callable[[Any], Any], payload: str, description: str) -> tuple[bool, str | None, str]:
    """(is done, signal, info) of one call; an exception is an outcome too."""
    try:
        taken = call(json.loads(payload))
        if isinstance(taken, Exception):
            raise taken
        if isinstance(taken, Progress):
            return False, None, _text(taken.value)
        if isinstance(taken, Done):
            return True, "SUCCESS", _text(taken.value)
        if isinstance(taken, Expanded):
            return True, "EXPANDED", _text(list(taken.requests))
        raise TypeError(f"not a step: {taken!r}")
    except Exception as problem:
        return True, "FATAL_FAILURE", _text(_failure(description, problem))


def _outcomes(calls: Callable[[list], list], payloads: list[str], description: str) -> list[tuple]:
    """The same for a runner that takes many payloads at once and returns a step or an exception for each."""
    try:
        taken = calls([json.loads(payload) for payload in payloads])
        if len(taken) != len(payloads):
            raise ValueError(f"{len(taken)} steps for {len(payloads)} payloads")
    except Exception as problem:
        taken = [problem] * len(payloads)
    return [_outcome(lambda _, step=step: step, "null", description) for step in taken]


def _run(rows: DataFrame, runner: Runner, method: str, description: str) -> DataFrame:
    """Steps of all rows: by the runner's batch method (``initialize_batch``, ``step_batch``) if it has one."""
    call, calls = getattr(runner, method), getattr(runner, f"{method}_batch", None)
    # Arrivals keep the type of their source.
    ddl = STEPS_DDL.replace("arrival bigint", f"arrival {rows.schema['arrival'].dataType.simpleString()}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if calls is not None:
                outcomes = _outcomes(calls, batch["payload"].tolist(), description)
            else:
                outcomes = [_outcome(call, payload, description) for payload in batch["payload"]]
            taken = pd.DataFrame(outcomes, columns=["is_done", "signal", "info"], index=batch.index)
            yield pd.concat([batch.drop(columns="payload"), taken], axis=1)

    return rows.mapInPandas(run, ddl)


def initialize(requests: DataFrame, runner: Runner) -> DataFrame:
    """First step of each request (request_id, transfer_id, body, arrival); it counts as step 0."""
    rows = requests.select(
        "request_id", "transfer_id", F.lit(0).alias("step"), "arrival", F.col("body").alias("payload")
    )
    return _run(rows, runner, "initialize", INIT_FAILURE)


def advance(progress: DataFrame, runner: Runner) -> DataFrame:
    """Next step of each progress message."""
    rows = progress.select(
        "request_id", "transfer_id", (F.col("step") + 1).alias("step"), "arrival", F.col("info").alias("payload")
    )
    return _run(rows, runner, "step", STEP_FAILURE)
