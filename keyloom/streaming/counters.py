"""Counters whose window opens with the first event: state by key, handled in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.session import ship
from keyloom.streaming.base import events_stream, run_to_end


def stream_fixed_windows(spark: SparkSession, folder: str, window_ms: int = 3_600_000) -> DataFrame:
    """``(user_id, opened_ms, counter)``, a row for each window that later events of the batch or stream have closed."""
    ship(spark)

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, counter = state.get if state.exists else (None, 0)
        closed = []
        for ts in sorted(t for batch in batches for t in batch["ts_ms"]):
            if opened is not None and ts < opened + window_ms:
                counter += 1
                continue
            if opened is not None:
                closed.append((key[0], opened, counter))
            opened, counter = ts, 1
        state.update((opened, counter))
        yield pd.DataFrame(closed, columns=["user_id", "opened_ms", "counter"])

    rows = events_stream(spark, folder).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    closed = rows.groupBy("user_id").applyInPandasWithState(count, "user_id long, opened_ms long, counter long", "opened_ms long, counter long", "append", GroupStateTimeout.NoTimeout)
    return run_to_end(closed, "stream-increx")
