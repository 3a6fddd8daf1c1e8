"""Live segments whose waiting elements are entries of the state of their own.

What ``streams.segments`` keeps as arrays of one row, rewritten with each batch, stands here in a map of the state store by time and tie: a batch reads what waits in one go, adds those of its elements
that are not ripe yet and takes out those that are; what is ripe at once never enters the state, so calls to the store are as many as elements that wait, not as elements. A series can begin from what a batch job has left (its next position, last cut, last value and time), and states that are not touched for ``idle`` run out by themselves. The
store must be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> str | None:
    """Have streams that start from now on keep their state in RocksDB; returns the setting that stood before."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    return before


class _Series(StatefulProcessor):
    """Segments of one series after another."""

    def __init__(self, key: str, threshold: float, min_len: int, late: int, idle_ms: int | None):
        self.key, self.threshold, self.min_len, self.late, self.idle_ms = key, threshold, min_len, late, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.idle_ms} if self.idle_ms else {}
        self.done = handle.getValueState("done", "pos bigint, cut bigint, last double, upto bigint", **ttl)
        self.waiting = handle.getMapState("waiting", "t bigint, k bigint", "v double, n int", **ttl)
        self.newest = handle.getValueState("newest", "t bigint", **ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.done.update((int(r["pos"]), int(r["cut"]), float(r["last"]), int(r["upto"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pos, cut, last, upto = self.done.get() if self.done.exists() else (0, 0, None, None)
        known = self.newest.exists()
        newest = self.newest.get()[0] if known else None
        given = [(b["place_"].to_numpy("int64"), b["tie_"].to_numpy("int64"), b["value_"].to_numpy(float)) for b in rows]
        times, ties, values = (np.concatenate(c) for c in zip(*given, strict=True))
        old = times < upto if upto is not None else np.zeros(len(times), bool)
        late = list(zip(times[old].tolist(), values[old].tolist(), strict=True))
        times, ties, values = times[~old], ties[~old], values[~old]
        if len(times):
            newest = int(times.max()) if newest is None else max(newest, int(times.max()))
            self.newest.update((newest,))
        closed: list[tuple[int, int]] = []
        if newest is not None:
            held = dict(self.waiting.iterator()) if known else {}
            ripe = [(e, v, n) for e, (v, n) in held.items() if e[0] <= newest - self.late]
            for e, _, _ in ripe:
                self.waiting.removeKey(e)
            waits: dict[tuple[int, int], tuple[float, int]] = {}
            on = times > newest - self.late
            for *e, v in zip(times[on].tolist(), ties[on].tolist(), values[on].tolist(), strict=True):  # an element that comes again waits once more
                waits[tuple(e)] = (v, (waits.get(tuple(e)) or held.get(tuple(e)) or (v, 0))[1] + 1)
            for e, x in waits.items():
                self.waiting.updateValue(e, x)
            often = [n for _, _, n in ripe]
            times = np.concatenate([np.repeat(np.array([e[0] for e, _, _ in ripe], "int64"), often), times[~on]])
            ties = np.concatenate([np.repeat(np.array([e[1] for e, _, _ in ripe], "int64"), often), ties[~on]])
            order = np.lexsort((ties, times))
            values = np.concatenate([np.repeat(np.array([v for _, v, _ in ripe], float), often), values[~on]])[order]
            if len(values):
                before = np.concatenate([[np.nan if last is None else last], values[:-1]])
                for i in np.flatnonzero(np.abs(values - before) >= self.threshold).tolist():
                    if pos + i - cut >= self.min_len:
                        closed.append((cut, pos + i))
                        cut = pos + i
                pos, last, upto = pos + len(values), float(values[-1]), int(times[order[-1]])
                self.done.update((pos, cut, last, upto))
        n, m = len(closed), len(late)
        if not n + m:
            return
        yield pd.DataFrame(
            {
                self.key: [key[0]] * (n + m), "kind": ["segment"] * n + ["late"] * m, "start": pd.array([a for a, _ in closed] + [None] * m, "Int64"), "end": pd.array([b for _, b in closed] + [None] * m, "Int64"),
                "at": pd.array([None] * n + [t for t, _ in late], "Int64"), "value": pd.array([None] * n + [v for _, v in late], "Float64"),
            }
        )

    def close(self) -> None:
        pass


def segments(elements: DataFrame, key: str, ts: str, tie: str, value: str, threshold: float, min_len: int, late: int = 0, idle: str | None = None, begun: DataFrame | None = None) -> DataFrame:
    """Closed segments and late elements, as ``streams.segments`` gives them, for append mode: (key, kind, start, end, at, value).

    begun: (key, pos, cut, last, upto), one row for each series that a batch job has begun: the next position, the last cut, the last value and its time (as ts, in microseconds for time stamps). Equal
    elements (of one series, time and tie) should have equal values: they are taken as often as they come.
    """
    kind = elements.schema[key].dataType.simpleString()
    at = F.unix_micros(ts) if elements.schema[ts].dataType.typeName() == "timestamp" else F.col(ts).cast("bigint")
    # names that rows of a named tuple may have
    chosen = elements.select(key, at.alias("place_"), F.col(tie).cast("bigint").alias("tie_"), F.col(value).cast("double").alias("value_"))
    patience = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return chosen.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Series(key, threshold, min_len, late, patience), outputStructType=f"{key} {kind}, kind string, start bigint, end bigint, at bigint, value double", outputMode="Append", timeMode="ProcessingTime" if idle else "None",
        initialState=begun.select(key, "pos", "cut", "last", "upto").groupBy(key) if begun is not None else None,
    )
