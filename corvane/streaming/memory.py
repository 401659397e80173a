"""Conversation memory as a stateful stream: the last exchanges of each conversation, kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Exchanges that a conversation keeps, and how long after the last one it is forgotten, where exchanges have a time.
LAST, EXPIRY = 5, "1 day"
_STATE = "turns array<long>, lines array<string>, last long"
_OUT = "conv_id long, turn long, history string"


def remember(exchanges: DataFrame, last: int = LAST, time: str | None = None, expiry: str = EXPIRY) -> DataFrame:
    """(conv_id, turn, history) for a stream of (conv_id, turn, question, answer): the last exchanges up to each one, oldest first.

    State is bounded: ``last`` exchanges for each conversation, and with ``time``, a
    timestamp column, only for conversations that had one within ``expiry`` before
    the newest of all. An exchange that comes again replaces itself, so that a batch
    done again after a restart changes nothing; one that comes late takes its place
    by turn, or is too old to be kept. Rows come out in order of turns.
    """
    patience = int(pd.Timedelta(expiry).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, lines, newest = state.get if state.exists else ([], [], 0)
        held = dict(zip(map(int, turns), lines, strict=True))
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for turn, question, answer in zip(rows["turn"], rows["question"], rows["answer"], strict=True):
            held[int(turn)] = f"Q: {question}\nA: {answer}"
            kept = [t for t in sorted(held) if t <= turn][-last:]
            out.append((key[0], int(turn), "\n".join(held[t] for t in kept)))
        kept = sorted(held)[-last:]
        if time:
            newest = max(int(newest), int(rows["at"].max()))
            state.update((kept, [held[t] for t in kept], newest))
            state.setTimeoutTimestamp(max(newest + patience, state.getCurrentWatermarkMs() + 1))
        else:
            state.update((kept, [held[t] for t in kept], 0))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history"])

    columns = ["cast(conv_id as long) AS conv_id", "cast(turn as long) AS turn", "question", "answer"]
    if time:
        # The watermark follows the newest exchange; ``at`` is its time in milliseconds.
        exchanges = exchanges.withWatermark(time, "0 seconds")
        columns += [time, f"unix_millis({time}) AS at"]
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return exchanges.selectExpr(*columns).groupBy("conv_id").applyInPandasWithState(update, _OUT, _STATE, "append", timeout)
