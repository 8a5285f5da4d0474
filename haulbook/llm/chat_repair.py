"""Chat formatting: a minimum-cost repair of each conversation's roles, rendered turn by turn.

A legal conversation may open with a system turn, goes on with user and assistant in turn and ends with an assistant. A
dynamic program over that automaton decides for every source turn whether it is kept, gets another role, or is merged
into the turn before it, and where empty turns are put in, so that the total cost is least.

A conversation may be of any length, so it is cut into segments by turn number. What a segment does to the cost is a small
matrix (from each state before it to each state after it); a pass along the segments adds the matrices up from the start,
a pass back picks the states between them, and each segment is then repaired for itself between its two states. Neither
pass keeps more than one segment. The result is one row per source turn with the piece it adds to the rendered
conversation, so no row grows with a conversation: the pieces of one conversation, in the order of ``segment`` and ``place``,
put together are its rendered text.

Defined results: turns are ordered by number, then by a hash of role and text, null numbers last; rows alike in every one
of these are one turn; a null text is empty; a null or unknown role may become any role at a small cost; a null
conversation id is a conversation; an empty table gives an empty result; other columns are not read. Marks of the
template inside a text are broken by a space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import stored

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "ai": "assistant"}

#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles that may follow.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}

MERGE, INSERT, NAME, RELABEL = 1.0, 2.0, 1.0, 3.0
INFINITE = float("inf")

#: Turns of a segment by number, and rows from which such a range of turns is cut further.
SEGMENT, CROWDED = 1024, 8192


def inserted_between(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from a state to one that a role may follow; None if nothing does."""
    ways: list[tuple[int, tuple[int, ...]]] = [(state, ())]
    seen = {state}
    for now, path in ways:
        if role in LEGAL[now]:
            return path
        for step in LEGAL[now]:
            if step not in seen and step != SYSTEM:
                seen.add(step)
                ways.append((step, (*path, step)))
    return None


BETWEEN = {(state, role): inserted_between(state, role) for state in range(4) for role in (SYSTEM, USER, ASSISTANT)}
#: Empty turns that end a conversation legally.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_number(role: str | None) -> int:
    """1 to 3, or 0 for a role that is unknown."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def steps(role: int) -> list[tuple[int, int, float, str]]:
    """What a turn of this role can do: (state before, state after, cost, action), the preferred first."""
    found = []
    for state in range(4):
        for new in (SYSTEM, USER, ASSISTANT):
            change = 0.0 if new == role else RELABEL if role else NAME
            empty = BETWEEN[state, new]
            if empty is not None:
                found.append((state, new, change + INSERT * len(empty), "keep" if new == role else "relabel"))
        if state != START:
            change = 0.0 if state == role else RELABEL if role else NAME
            found.append((state, state, change + MERGE, "merge"))
    return found


STEPS = [steps(role) for role in range(4)]
END_COST = np.array([INSERT * len(ENDING[state]) for state in range(4)])


def matrix_of(roles: list[int]) -> np.ndarray:
    """Least cost from each state before to each state after these turns."""
    total = np.full((4, 4), INFINITE)
    np.fill_diagonal(total, 0.0)
    for role in roles:
        new = np.full((4, 4), INFINITE)
        for before, after, cost, _ in STEPS[role]:
            new[:, after] = np.minimum(new[:, after], total[:, before] + cost)
        total = new
    return total


def repair(roles: list[int], first: int, last: int) -> list[tuple[int, int, str]]:
    """For each turn (state before, state after, action) on the cheapest way from state to state."""
    togo = [np.full(4, INFINITE) for _ in range(len(roles) + 1)]
    togo[-1][last] = 0.0
    for at in range(len(roles) - 1, -1, -1):
        for before, after, cost, _ in STEPS[roles[at]]:
            togo[at][before] = min(togo[at][before], cost + togo[at + 1][after])
    found, state = [], first
    for at, role in enumerate(roles):
        best = min(
            (step for step in STEPS[role] if step[0] == state), key=lambda step: (step[2] + togo[at + 1][step[1]], step[1])
        )
        found.append((state, best[1], best[3]))
        state = best[1]
    return found


def opened(role: int) -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n"


CLOSED = "<|im_end|>\n"


def piece(before: int, after: int, action: str, text: str, final: bool) -> tuple[str, list[str]]:
    """What a turn adds to the rendered text, and the roles of the empty turns put in before it."""
    text = text.replace("<|im_", "<| im_")
    if action == "merge":
        empty: tuple[int, ...] = ()
        out = "\n" + text if text else ""
    else:
        empty = BETWEEN[before, after]
        out = (CLOSED if before != START else "") + "".join(opened(role) + CLOSED for role in empty)
        out += opened(after) + text
    if final:
        out += CLOSED + "".join(opened(role) + CLOSED for role in ENDING[after])
    return out, [ROLES[role - 1] for role in empty]


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[tuple]]:
    """Rows with equal keys of a sorted partition, as they come."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from batch.itertuples(index=False)

    for _, run in groupby(rows(), key=lambda row: tuple(str(getattr(row, key)) for key in keys)):
        yield run


def framed(columns: list[str], size: int = 2000) -> tuple[list, Callable[[], pd.DataFrame]]:
    rows: list[tuple] = []

    def flush() -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=columns, dtype=object)
        rows.clear()
        return frame

    return rows, flush


def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, flush = framed(["conv", "segment", "costs"])
    for run in runs(batches, ["conv", "segment"]):
        turns = list(run)
        costs = matrix_of([role_number(turn.role) for turn in turns])
        rows.append((turns[0].conv, turns[0].segment, costs.ravel().tolist()))
        if len(rows) >= 2000:
            yield flush()
    yield flush()


def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds to every segment the least costs of the states before it and, to the last, that it is the last."""
    rows, flush = framed(["conv", "segment", "costs", "reached", "last"])
    for run in runs(batches, ["conv"]):
        reached, held = np.array([0.0, INFINITE, INFINITE, INFINITE]), None
        for segment in run:
            if held is not None:
                rows.append((*held, False))
            held = (segment.conv, segment.segment, list(segment.costs), reached.tolist())
            reached = (reached[:, None] + np.array(segment.costs).reshape(4, 4)).min(axis=0)
            if len(rows) >= 2000:
                yield flush()
        rows.append((*held, True))
    yield flush()


def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states before and after every segment, from the last segment to the first."""
    rows, flush = framed(["conv", "segment", "before", "after", "last", "cost"])
    for run in runs(batches, ["conv"]):
        after = None
        for segment in run:
            reached, costs = np.array(segment.reached), np.array(segment.costs).reshape(4, 4)
            if after is None:
                ends = (reached[:, None] + costs).min(axis=0) + END_COST
                after = int(ends.argmin())
                total = float(ends[after])
            before = int((reached + costs[:, after]).argmin())
            rows.append((segment.conv, segment.segment, before, after, segment.last, total))
            after = before
            if len(rows) >= 2000:
                yield flush()
    yield flush()


OUT = (
    "conv_id long, segment string, place int, turn long, role string, new_role string, action string, "
    "inserted array<string>, piece string, cost double"
)


def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, flush = framed([field.split()[0] for field in OUT.split(", ")])
    for run in runs(batches, ["conv", "segment"]):
        turns = list(run)
        one = turns[0]
        found = repair([role_number(turn.role) for turn in turns], one.before, one.after)
        for place, (turn, (before, after, action)) in enumerate(zip(turns, found)):
            final = bool(one.last) and place == len(turns) - 1
            out, empty = piece(before, after, action, turn.text or "", final)
            number = None if pd.isna(turn.turn) else int(turn.turn)
            conv = None if pd.isna(turn.conv_id) else int(turn.conv_id)
            rows.append((conv, one.segment, place, number, turn.role, ROLES[after - 1], action, empty, out, one.cost))
        if len(rows) >= 2000:
            yield flush()
    yield flush()


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per source turn: its new role, what was done, the empty turns before it and its rendered piece."""
    above_zero = F.col("turn").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    wide = F.lpad(above_zero.cast("string"), 20, "0")
    block = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(1 << 53))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).distinct()
    rows = rows.withColumns(
        {
            # Joins and groups by a conversation's name, which is never null.
            "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("null")),
            "hash": F.shiftrightunsigned(F.xxhash64("role", "text"), 1),
            "block": F.lpad((block + F.lit(1 << 53)).cast("string"), 20, "0"),
        }
    )
    # A range of turns that holds very many rows is cut by turn and, within a turn, by the hash that orders its rows.
    crowds = rows.groupBy("conv", "block").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
    finer = F.concat_ws(
        "-", "block", F.coalesce(wide, F.lit("9" * 20)), F.lpad(F.shiftright("hash", 51).cast("string"), 4, "0")
    )
    rows = rows.join(crowds, ["conv", "block"], "left").select(
        "conv_id", "conv", F.when(F.col("n").isNull(), F.col("block")).otherwise(finer).alias("segment"),
        "turn", "hash", "role", "text",
    )
    rows = stored(rows, "turns")
    order = [F.col("turn").asc_nulls_last(), "hash", "role", "text"]
    by_segment = rows.repartition("conv", "segment").sortWithinPartitions("conv", "segment", *order)
    costs = by_segment.mapInPandas(matrices, "conv string, segment string, costs array<double>")
    costs = costs.repartition("conv").sortWithinPartitions("conv", "segment")
    ahead = costs.mapInPandas(
        forward, "conv string, segment string, costs array<double>, reached array<double>, last boolean"
    )
    back = stored(ahead, "segments").repartition("conv").sortWithinPartitions(F.col("conv"), F.col("segment").desc())
    states = back.mapInPandas(
        backward, "conv string, segment string, before int, after int, last boolean, cost double"
    )
    known = rows.join(stored(states, "states"), ["conv", "segment"])
    return known.repartition("conv", "segment").sortWithinPartitions("conv", "segment", *order).mapInPandas(rendered, OUT)
