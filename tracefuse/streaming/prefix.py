"""Detection windows of a live event stream: prefix counts per container, kept as state.

A container's windows begin at its start in the manifest and are nested, so the
state holds one count per (name, smallest window that contains the event).  A
window's counts are emitted once, when the watermark has passed its last
second; the state goes with the last window.  State is bounded by names x
windows for each container whose windows are open.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracefuse.operators.counting import attach_start

#: Spark keeps map state and timers in this store only
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PrefixWindows(StatefulProcessor):
    """Counts of one container by (feature, smallest window that holds the event)."""

    def __init__(self, windows: list[tuple[str, int]], key_col: str):
        self.tags = [t for t, _ in windows]
        self.limits = np.array([n for _, n in windows], np.int64)
        self.key_col = key_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "start_ts bigint")
        self.counts = handle.getMapState("counts", "feature string, slot int", "n bigint")

    def _closes(self, start: int) -> list[int]:
        """Milliseconds at which each window's last second is over."""
        return [(start + int(n) + 1) * 1000 for n in self.limits]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            slot = np.searchsorted(self.limits, (part["ts_s"] - part["start_ts"]).to_numpy())
            inside = slot < len(self.limits)
            if not inside.any():
                continue
            if not self.start.exists():
                start = int(part["start_ts"].iloc[0])
                self.start.update((start,))
                for at in self._closes(start):
                    if at > now:  # a window closed before the first event holds nothing
                        self.handle.registerTimer(at)
            sums = part[inside].assign(slot=slot[inside]).groupby(["feature", "slot"])["n"].sum()
            for (feature, at), n in sums.items():
                entry = (feature, int(at))
                held = self.counts.getValue(entry)[0] if self.counts.containsKey(entry) else 0
                self.counts.updateValue(entry, (held + int(n),))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closes = self._closes(self.start.get()[0])
        window = closes.index(expiredTimerInfo.getExpiryTimeInMs())
        totals: dict[str, int] = {}
        for (feature, slot), (n,) in self.counts.iterator():
            if slot <= window:
                totals[feature] = totals.get(feature, 0) + n
        if window == len(closes) - 1:
            self.counts.clear()
            self.start.clear()
        yield pd.DataFrame({self.key_col: [key[0]] * len(totals), "window_tag": [self.tags[window]] * len(totals),
                            "feature": list(totals), "n": list(totals.values())})

    def close(self) -> None:
        pass


def prefix_window_counts(events: DataFrame, manifest: DataFrame, windows: Mapping[str, int | None], key_col: str = "container",
                         ts_col: str = "ts", feature_col: str = "feature", watermark: str = "1 minute",
                         manifest_max_rows: int | None = 1_000_000) -> DataFrame:
    """(key, window_tag, feature, n) of a stream of mapped events, once per window and container.

    The batch rules hold: an event is in window N when its whole second less the
    start is at most N, events before the start are kept, a container missing
    from the manifest starts at 0.  Rows that arrive after the watermark are
    dropped.  A window without a last second (None) never closes and is left
    out.  Events with a NULL time are dropped.
    The session must use the state store named by ``STATE_STORE``.
    """
    finite = sorted(((t, int(n)) for t, n in windows.items() if n is not None), key=lambda w: w[1])
    if not finite:
        raise ValueError("no window has a last second")
    spark = events.sparkSession
    if spark.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError(f"{STATE_STORE[0]} must be {STATE_STORE[1]}")
    ev = events.select(key_col, F.col(ts_col).cast("timestamp").alias("ts"), F.col(feature_col).alias("feature")) \
        .filter(F.col("ts").isNotNull())
    ev = attach_start(ev, manifest, key_col, manifest_max_rows=manifest_max_rows)
    ev = ev.select(key_col, "ts", F.unix_seconds("ts").alias("ts_s"), "start_ts", "feature", F.lit(1).cast("bigint").alias("n"))
    key_type = dict(events.dtypes)[key_col]
    return ev.withWatermark("ts", watermark).groupBy(key_col).transformWithStateInPandas(
        PrefixWindows(finite, key_col), f"`{key_col}` {key_type}, window_tag string, feature string, n bigint",
        "Append", "EventTime")
