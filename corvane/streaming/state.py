"""Keyed state with a time to live, and rolling counters that an action resets, as stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Before any second.
NEVER = -(1 << 62)
OUT = "key string, replica string, last_seen timestamp, live boolean"


def ttl_entries(touches: DataFrame, ttl_s: int, late: str = "0 seconds") -> DataFrame:
    """touches(key, replica, last_seen) as changes of an index whose entries expire.

    A touch makes or refreshes its key's entry, the last writer wins; once the watermark has passed an entry's age
    by more than the time to live it is given out as no longer live.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            replica, seen = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "replica": [replica], "last_seen": [pd.Timestamp(seen, unit="us")], "live": [False]})
            return
        replica, seen = state.get if state.exists else (None, -1)
        for batch in batches:
            at = batch["last_seen"].astype("int64") // 1000 if batch["last_seen"].dtype == "datetime64[ns]" else batch["last_seen"].astype("datetime64[us]").astype("int64")
            for r, t in zip(batch["replica"], at):
                if (t, r or "") >= (seen, replica or ""):
                    replica, seen = r, int(t)
        state.update((replica, seen))
        state.setTimeoutTimestamp(max(seen // 1000 + ttl_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "replica": [replica], "last_seen": [pd.Timestamp(seen, unit="us")], "live": [True]})

    return touches.withWatermark("last_seen", late).groupBy("key").applyInPandasWithState(update, OUT, "replica string, seen long", "append", GroupStateTimeout.EventTimeTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PRESSURE = "seconds array<long>, counts array<long>, reset long, latest long"


class _Pressure(StatefulProcessor):
    """A key's events of the window by second, the last action on it and the latest second seen."""

    def __init__(self, window_s: int, late_s: int, out: list[str]):
        self.window, self.late, self.out = window_s, late_s, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("pressure", _PRESSURE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seconds", kind="stable")
        seconds, counts, reset, latest = self.state.get() if self.state.exists() else ([], [], NEVER, NEVER)
        t, acts = batch["seconds"].to_numpy("int64"), batch["acts"].to_numpy(bool)
        latest = max(latest, int(t.max()))
        resets = np.concatenate([[reset], t[acts]])
        own = t[~acts]
        kept = own[own >= reset]  # what comes later than an action that it precedes counts for nothing
        times, which = np.unique(np.concatenate([np.array(seconds, dtype="int64"), kept]), return_inverse=True)
        total = np.bincount(which, np.concatenate([np.array(counts, dtype="int64"), np.ones(len(kept))]), len(times)).astype("int64")
        upto = np.concatenate([[0], np.cumsum(total)])
        since = resets[np.searchsorted(resets[1:], own, "right")]  # the last action at or before each event
        first = np.searchsorted(times, np.maximum(own - self.window, since), "left")
        found = np.where(own >= reset, upto[np.searchsorted(times, own, "right")] - upto[first], 0)
        reset = int(resets[-1])
        keep = (times >= reset) & (times >= latest - self.window - self.late)
        self.state.update((times[keep].tolist(), total[keep].tolist(), reset, latest))
        self.handle.registerTimer((latest + self.window + 1) * 1000)
        yield pd.DataFrame(dict(zip(self.out, (batch["id"].to_numpy()[~acts], [key[0]] * len(own), found))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and expiredTimerInfo.getExpiryTimeInMs() > (self.state.get()[3] + self.window) * 1000:
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def pressure_stream(events: DataFrame, key: str, time: str, window_s: int, order: str = "event_id", reset: Column | None = None, late_s: int = 600) -> DataFrame:
    """``prefix.rolling_pressure`` of a stream: each event with its key's events so far in the window up to it.

    A micro-batch is taken in order of time.  Events that come late, but within ``late_s``, count for themselves and for later
    ones; events before an action that was taken in already have a pressure of 0 and count for nothing.  A key's state is a number
    for each second of the window and of lateness, whatever its events; it goes when the watermark has passed the window.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    acts = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    kinds = dict(events.dtypes)
    rows = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, f"{late_s} seconds")
    rows = rows.select(F.col(key).alias("key"), F.col(time).alias("at"), F.unix_timestamp(time).alias("seconds"), F.col(order).alias("id"), acts.alias("acts"))
    return rows.groupBy("key").transformWithStateInPandas(_Pressure(window_s, late_s, [order, key, "pressure"]), f"`{order}` {kinds[order]}, `{key}` {kinds[key]}, pressure long", "append", "eventTime")
