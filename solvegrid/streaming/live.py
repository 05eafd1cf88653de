"""The log as a stream: rates by window, late rows, and lives as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def unique(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def lives(log: DataFrame, most: int, floor: float) -> DataFrame:
    """expert_id, step, lives after each batch of the log; the state is one number for each expert."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else most
        rows = pd.concat(list(frames)).sort_values("step")
        out = []
        for s, rate in zip(rows["step"], rows["rate"], strict=True):
            now = min(now + 1, most) if rate > floor else max(now - 1, 0)
            out.append((key[0], int(s), now))
        state.update((now,))
        yield pd.DataFrame(out, columns=["expert_id", "step", "lives"])

    return log.groupBy("expert_id").applyInPandasWithState(step, "expert_id long, step long, lives int", "lives int", "append", GroupStateTimeout.NoTimeout)
