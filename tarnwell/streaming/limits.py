"""Usage and waits of calls as they come: what operators/rolling.py gives for a table, for a stream.

Each group (one budget) has in state the moments of its last seconds: calls and tokens added
up by time. A call is answered in the micro-batch that brings it, from what is known by then:
the moments before it, and the calls of its own batch at its own time or before. Replayed by
time, with the calls of one moment in one batch, a stream gives what the batch form gives,
whatever its batches and however often it was stopped.

State is bounded by the moments of `seconds` and `late`: a timer takes a moment out once the
watermark says that no call can look back at it any more. Calls that are later than the
watermark are left out, as are calls without a time. A budget is used up in order, so its
calls are one task's in each micro-batch; a micro-batch is as large as the source's trigger
options allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: The state store that state with timers needs, set on the session before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def answers(times: np.ndarray, calls: np.ndarray, valued: np.ndarray, tokens: np.ndarray, limit: float, span: int) -> pd.DataFrame:
    """requests, tokens (null if no call has any) and wait_seconds of moments in ascending order, each over the span up to it."""
    first = np.searchsorted(times, times - span, "left")
    total = lambda xs: np.concatenate([[0], np.cumsum(xs)])
    n, v, s = total(calls), total(valued), total(tokens)
    here = np.arange(1, len(times) + 1)
    used = np.round(s[here] - s[first], 9)
    # the first moment at which so much has expired that the rest is within the limit
    frees = np.minimum(np.searchsorted(np.round(s[1:], 9), np.round(s[here] - limit, 9), "left"), len(times) - 1)
    wait = np.where(used > limit, np.maximum(times[frees] + span - times, 0) / 1e6, 0.0)
    return pd.DataFrame({"requests": n[here] - n[first], "tokens": np.where(v[here] > v[first], used, np.nan), "wait_seconds": wait})


class Budget(StatefulProcessor):
    """The queue of one group's moments: time in microseconds, and the calls, calls with tokens and tokens of that time."""

    def __init__(self, limit: float, seconds: float, names: list[str]):
        self.limit, self.span, self.names = limit, int(seconds * 1_000_000), names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        moment = StructType([StructField("calls", LongType()), StructField("valued", LongType()), StructField("tokens", DoubleType())])
        self.queue = handle.getMapState("queue", StructType([StructField("t", LongType())]), moment)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True)
        calls.columns = [*self.names, "_g", "_ts", "_n", "_t"]  # they come by position
        new = calls.assign(calls=1, valued=calls["_n"].notna().astype("int64"), tokens=calls["_n"].fillna(0.0)).groupby("_t")[["calls", "valued", "tokens"]].sum()
        held = [(t[0], *moment) for t, moment in self.queue.iterator()]
        both = pd.concat([pd.DataFrame(held, columns=["_t", "calls", "valued", "tokens"]).set_index("_t"), new]) if held else new
        both = both.groupby(level=0).sum().sort_index()
        for t in new.index:
            moment = both.loc[t]
            self.queue.updateValue((int(t),), (int(moment["calls"]), int(moment["valued"]), float(moment["tokens"])))
        for second in {int(t + self.span) // 1_000_000 + 1 for t in new.index}:  # one timer for the moments of a second
            self.handle.registerTimer(second * 1000)
        found = answers(both.index.to_numpy(np.int64), *(both[c].to_numpy() for c in ("calls", "valued", "tokens")), self.limit, self.span).set_index(both.index)
        yield pd.concat([calls[self.names], found.loc[calls["_t"]].reset_index(drop=True)], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.span
        for t in [t for t in self.queue.keys() if t[0] < until]:
            self.queue.removeKey(t)
        return iter(())

    def close(self) -> None:
        pass


def live(calls: DataFrame, id: list[str], time: str, tokens: str, limit: float, group: str | None = None, seconds: float = 60, late: str = "10 seconds") -> DataFrame:
    """id, requests, tokens and wait_seconds of each call of a stream: of the last seconds up to and with it, and until it is within the limit.

    id: the columns that name a call; null and repeated ones stay what they are. group: one
    budget for each of its values (null is one), or one for all calls. Tokens are not
    negative; nulls count as none. The session needs STORE.
    """
    budget = F.col(group).cast("string") if group is not None else F.lit("")
    # as strings through pandas, where whole numbers with nulls would become floats
    names = [f"_id{i}" for i in range(len(id))]
    rows = calls.select(*[F.col(c).cast("string").alias(n) for c, n in zip(id, names)], budget.alias("_g"), F.col(time).cast("timestamp").alias("_ts"), F.col(tokens).cast("double").alias("_n"))
    rows = rows.where(F.col("_ts").isNotNull()).withColumn("_t", F.unix_micros("_ts")).withWatermark("_ts", late)
    out = StructType([*[StructField(n, StringType()) for n in names], StructField("requests", LongType()), StructField("tokens", DoubleType()), StructField("wait_seconds", DoubleType())])
    found = rows.groupBy("_g").transformWithStateInPandas(Budget(limit, seconds, names), out, "append", "eventTime")
    types = dict(calls.select(*id).dtypes)
    return found.select(*[F.col(n).cast(types[c]).alias(c) for c, n in zip(id, names)], "requests", "tokens", "wait_seconds")
