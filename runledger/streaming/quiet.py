"""Sources that have been quiet for a while.

A source that is being written changes many times. It is released once, when no change has come for the quiet period. The
state of a source is two numbers, and a timer in processing time fires without further events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds without a change after which a source is released.
QUIET_MS = 5000
#: Fixed by Spark: the state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASED = "path string, n_events bigint, last_change timestamp"


class QuietPeriod(StatefulProcessor):
    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "n bigint, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self.pending.get() if self.pending.exists() else (0, None)
        for batch in rows:
            n += len(batch)
            newest = batch["modified"].max()
            last = newest if last is None or newest > last else last
        # Every change starts the period anew.
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        self.pending.update((n, last.to_pydatetime() if hasattr(last, "to_pydatetime") else last))
        yield pd.DataFrame({"path": [], "n_events": [], "last_change": []}).astype({"path": str, "n_events": "int64", "last_change": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.pending.exists():
            return
        n, last = self.pending.get()
        self.pending.clear()
        yield pd.DataFrame({"path": [key[0]], "n_events": [n], "last_change": [pd.Timestamp(last)]})

    def close(self) -> None:
        pass


def after_quiet(spark: SparkSession, events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(path, n_events, last_change) of each path of ``events`` (path, modified) once it has been quiet; n_events since it was last released."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keyed = events.select("path", F.col("modified"))
    return keyed.groupBy("path").transformWithStateInPandas(QuietPeriod(quiet_ms), RELEASED, "append", "ProcessingTime")
