"""Streams of transfer events: windowed counts with late data, and the state each transfer has come to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States after which nothing more is expected.
TERMINAL = ("Succeeded", "Errored", "Cancelled", "Rejected", "TimedOut")


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by kind and window; events later than `late` behind the newest are left out, as a watermark says."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def latest_states(events: DataFrame, key: str, time: str, state: str, forget: str = "7 days") -> DataFrame:
    """The newest state of each key seen so far, whatever order events arrive in; a terminal state stays.

    A key that hears nothing for `forget` of processing time is forgotten, so
    that the state kept follows the transfers under way, not all there ever were.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def follow(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        at, now = held.get if held.exists else (pd.Timestamp(0), None)
        for batch in batches:
            for t, s in sorted(zip(batch[time], batch[state].fillna("")), key=lambda x: x[0]):
                done = now is not None and now.endswith(TERMINAL)
                if s and (t > at and not done or s.endswith(TERMINAL) and not done):
                    at, now = t, s
        held.update((at, now))
        held.setTimeoutDuration(wait)
        yield pd.DataFrame({key: [k[0]], "state_at": [at], "latest_state": [now]})

    return events.groupBy(key).applyInPandasWithState(
        follow, f"{key} string, state_at timestamp, latest_state string", "state_at timestamp, latest_state string", "update", GroupStateTimeout.ProcessingTimeTimeout
    )
