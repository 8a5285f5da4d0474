"""The latest progress of the transfers under way, kept as keyed streaming state with an end.

Progress and results come as one stream of tagged messages. A transfer has a state from its first message on: its highest step,
whatever the order of arrival. A result ends it. The two topics are not ordered against each other, so an ended transfer's key
stays for a while, without its info, to keep late progress from opening it again; then a timer removes it. Another timer
gives up transfers that have been silent for too long. State so grows with what is under way and not with what ever was.

A call of Python for each transfer costs milliseconds, so transfers are dealt to groups by a hash of their ids: a group's
transfers are folded in one call, each with a time of its own at which it is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from haulbook.sources.messages import MAX_WAIT

#: How long a transfer may be silent, and how long an ended one is remembered, unless configured otherwise.
SILENCE_MILLIS, LINGER_MILLIS = 7 * 24 * 3600 * 1000, 3600 * 1000

#: Groups that transfers are dealt to by a hash of their ids. A group's transfers are one entry of the state store and one call
#: of Python, so there should be some hundred of them to a group; a checkpoint keeps the number that it was made with.
GROUPS = 4096

KEYS = ["request_id", "transfer_id"]
MESSAGE_DDL = "request_id string, transfer_id string, step int, info string, arrival {}, is_end boolean"
ENTRY_DDL = "request_id string, transfer_id string, step int, info string, arrival string, ended boolean, due bigint"
#: The entries of a group, column by column.
STATE_DDL = ", ".join(f"{name} array<{kind}>" for name, kind in (field.split() for field in ENTRY_DDL.split(", ")))
CLOSED_DDL = "request_id string, transfer_id string, step int, info string, how string"


def latest_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Per transfer its highest step, of equal ones the first to arrive, and whether it has ended."""
    # Results sort last: the rows that say where a transfer is are those of its progress.
    order = rows.sort_values(["is_end", "step", "arrival"], ascending=[True, False, True], kind="stable")
    best = order.drop_duplicates(KEYS)
    ended = rows[rows["is_end"]][KEYS].drop_duplicates().assign(is_end=True)
    return best.drop(columns="is_end").merge(ended, on=KEYS, how="left").assign(is_end=lambda x: x["is_end"].eq(True))


def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages to one per transfer, batch by batch, so that a transfer that most are about does not reach its state's task
    with all of them."""
    for batch in batches:
        yield latest_of(batch)


def news_of(chunks: Iterator[pd.DataFrame]) -> dict[tuple, tuple]:
    """Per transfer of a group (step, info, arrival, ended) of a batch's messages; the step is null if none tells it."""
    news: dict[tuple, tuple] = {}
    for chunk in chunks:
        names = [*KEYS, "step", "info", "arrival", "is_end"]
        for request, transfer, step, info, arrival, ending in zip(*(chunk[name].tolist() for name in names)):
            known = news.get((request, transfer), (None, None, None, False))
            if pd.notna(step) and (known[0] is None or (int(step), -int(arrival)) > (known[0], -known[2])):
                known = int(step), info, int(arrival), known[3]
            news[request, transfer] = (*known[:3], known[3] or bool(ending))
    return news


def start_progress_state(
    messages: DataFrame,
    folder: str,
    checkpoint: str,
    available_now: bool = True,
    silence_millis: int = SILENCE_MILLIS,
    linger_millis: int = LINGER_MILLIS,
    max_wait: str = MAX_WAIT,
    groups: int = GROUPS,
) -> StreamingQuery:
    """Keep the state of tagged messages; transfers that ended or fell silent are written to ``folder``, batch by batch."""

    def fold(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        entries = {entry[:2]: entry[2:] for entry in zip(*state.get)} if state.exists else {}
        news = {} if state.hasTimedOut else news_of(chunks)
        closed = []
        # What this batch has messages for is not silent, however late they come.
        for key in [key for key, entry in entries.items() if entry[-1] <= now and key not in news]:
            step, info, _, ended, _ = entries.pop(key)
            if not ended:
                closed.append((*key, step, info, "silent"))
        for key, (new, new_info, came, ending) in news.items():
            step, info, arrival, ended, _ = entries.get(key, (None, None, None, False, None))
            if not ended:
                if new is not None and (step is None or (new, -came) > (step, -int(arrival))):
                    step, info, arrival = new, new_info, str(came)
                if ending:
                    closed.append((*key, step, info, "ended"))
                    ended, info = True, None
            entries[key] = step, info, arrival, ended, now + (linger_millis if ended else silence_millis)
        if entries:
            state.update(tuple(map(list, zip(*((*key, *entry) for key, entry in entries.items())))))
            state.setTimeoutDuration(max(1, min(entry[-1] for entry in entries.values()) - now))
        else:
            state.remove()
        if closed:
            yield pd.DataFrame(closed, columns=[*KEYS, "step", "info", "how"]).astype({"step": "Int32"})

    def handle(changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    own = messages.select(*KEYS, "step", "info", "arrival", F.col("signal").isNotNull().alias("is_end"))
    kind = own.schema["arrival"].dataType.simpleString()
    dealt = own.mapInPandas(reduced, MESSAGE_DDL.format(kind)).withColumn("group", F.pmod(F.xxhash64(*KEYS), F.lit(groups)))
    states = dealt.groupBy("group").applyInPandasWithState(
        fold, CLOSED_DDL, STATE_DDL, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
    writer = states.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.trigger(processingTime=max_wait).start()
    # Timers ask for batches without data for ever; a run over what is there looks at them with its data alone.
    setting, spark = "spark.sql.streaming.noDataMicroBatches.enabled", messages.sparkSession
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def read_progress_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Where the transfers under way are, from the state store's last committed version."""
    states = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    columns = [f"`{field.split()[0]}`" for field in ENTRY_DDL.split(", ")]
    entries = states.select(F.explode(F.expr(f"arrays_zip({', '.join(columns)})")).alias("entry")).select("entry.*")
    return entries.where("NOT ended AND step IS NOT NULL").select(*KEYS, "step", "info")


def read_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Transfers that ended or fell silent, with the step they had got to."""
    return spark.read.schema(f"{CLOSED_DDL}, batch int").parquet(folder)
