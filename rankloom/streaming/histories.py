"""Bounded user histories kept as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankloom.columns import HISTORY_LENGTH, ITEM, ROW, TIME, USER


def stream_history(events: DataFrame, length: int = HISTORY_LENGTH) -> DataFrame:
    """Attach the user's last ``length`` items before each event to a stream.

    The state of a user is one bounded list, whatever the number of events. Within
    a micro-batch events are taken in time order; an event that arrives in a later
    batch is appended in arrival order. Limit the batch size at the source
    (``maxFilesPerTrigger``), because a batch of one user is handled by one task.
    """
    schema = f"{USER} bigint, {ITEM} bigint, {TIME} bigint, {ROW} bigint, history array<bigint>"

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches), ignore_index=True).sort_values([TIME, ROW], kind="stable")
        histories = []
        for item in rows[ITEM]:
            histories.append(past)
            past = [*past, int(item)][-length:]
        state.update((past,))
        yield rows[[USER, ITEM, TIME, ROW]].assign(history=histories)

    return (
        events.select(USER, ITEM, TIME, ROW)
        .groupBy(USER)
        .applyInPandasWithState(
            update, schema, "items array<bigint>", "append", GroupStateTimeout.NoTimeout
        )
    )
