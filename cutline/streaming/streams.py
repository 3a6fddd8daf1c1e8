"""The ledger and segments on unbounded input.

Progress: the best report of each unit, as a running maximum; late and repeated lines do no harm; net progress also takes back what a failed attempt had reported. Windows: fixed, sliding and by sessions, with the elements that come too late
for them beside. Projection: totals of the ledger as they grow. Segments: a
stateful processor that keeps of each series the last value, the last cut, the next position and the elements that may still be overtaken, emits segments as they close and late elements beside them, and
forgets a series that has been idle. Driver tables carry time stamps without
a zone, which watermarks refuse; ``stamped`` turns them into instants (the session's zone should be UTC).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cutline.functions.progress import finished


def stamped(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def progress(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Best finished count of each unit, for update mode. lines: keys, kind, line."""
    return lines.withColumn("done", finished(F.col("kind"), F.col("line"))).filter("done is not null").groupBy(*keys).agg(F.max("done").alias("done"))


def projection(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of finished units, for update or complete mode; ``operators.ledger.projection`` goes on top of a batch of them."""
    return ledger.groupBy(*keys).agg(F.sum("n_elements").alias("done_elements"), F.sum("size_bytes").alias("done_bytes"), F.count(F.lit(1)).alias("done_units"))


def windowed_counts(df: DataFrame, ts: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Elements a time window and key, for append mode: a window is closed when the watermark has passed it, later elements are dropped."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sliding_counts(df: DataFrame, ts: str, length: str, step: str, late: str, keys: list[str]) -> DataFrame:
    """Elements in each of the windows of a length that begin every step, for append mode."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, length, step), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of each key, for append mode: elements less than a gap apart; a session ends a gap after its last element and is closed when the watermark has passed that."""
    found = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def later_than_watermark(df: DataFrame, ts: str, late: str, buckets: int = 64) -> DataFrame:
    """The elements that windows drop, for append mode: those at or before the watermark when their batch begins. To be written beside what the windows give, from the same source.

    Nothing is kept in the state; elements are dealt by a hash into so many groups.
    """
    names = df.columns

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        for rows in batches:
            at = rows["_at"].to_numpy("int64")
            yield rows.loc[at <= passed, names]

    marked = df.withWatermark(ts, late).withColumn("_at", F.unix_micros(ts)).withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return marked.groupBy("_bucket").applyInPandasWithState(step, schema, "none int", "append", GroupStateTimeout.NoTimeout)


def net_progress(reports: DataFrame, key: str, order: str, done: str, failed: str) -> DataFrame:
    """(key, increment, net) when a unit is seen first and whenever its finished count changes, for append mode: by how much, and to what. A failure takes back what was reported before it; the increments add up to net.

    Batches may bring reports and failures in any order of theirs (order: a whole number, one row each). Of a unit the state holds the last failure, and those reports after it that no later
    one reaches: what a failure that is still to come may leave standing. Reports that grow leave one.
    """
    kind = reports.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.exists
        failure, told, places, counts = state.get if known else (None, 0, [], [])
        given = [(b["_order"].to_numpy("int64"), b["_done"].to_numpy(), b["_failed"].to_numpy(bool)) for b in batches]
        orders, dones, broken = (np.concatenate(c) for c in zip(*given, strict=True))
        if broken.any():
            failure = max([int(orders[broken].max()), *([failure] if failure is not None else [])])
        reported = ~broken & ~pd.isna(dones)
        orders = np.concatenate([np.array(places, "int64"), orders[reported]])
        dones = np.concatenate([np.array(counts, "int64"), dones[reported].astype("int64")])
        if failure is not None:
            orders, dones = orders[orders > failure], dones[orders > failure]
        back = np.lexsort((dones, orders))[::-1]  # from the last one back
        orders, dones = orders[back], dones[back]
        stands = np.ones(len(dones), bool)
        stands[1:] = dones[1:] > np.maximum.accumulate(dones)[:-1]
        orders, dones = orders[stands], dones[stands]
        net = max(0, int(dones[-1])) if len(dones) else 0
        state.update((failure, net, orders.tolist(), dones.tolist()))
        if net != told or not known:
            yield pd.DataFrame({key: [name[0]], "increment": [net - told], "net": [net]})

    chosen = reports.select(key, F.col(order).cast("bigint").alias("_order"), F.col(done).cast("bigint").alias("_done"), F.coalesce(F.col(failed), F.lit(False)).alias("_failed"))
    held = "failure bigint, told bigint, places array<bigint>, counts array<bigint>"
    return chosen.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, increment bigint, net bigint", held, "append", GroupStateTimeout.NoTimeout)


def segments(elements: DataFrame, key: str, ts: str, tie: str, value: str, threshold: float, min_len: int, late: int = 0, idle: str | None = None) -> DataFrame:
    """Closed segments of each series, and elements that came too late, for append mode: (key, kind, start, end, at, value), told apart by ``closed`` and ``late_elements``.

    A cut stands where the value jumps by threshold or more, min_len elements at least after the last. A series' elements are taken in the order of ts (a time stamp, or a whole number) and tie, whatever
    batches bring them: an element waits until the series has seen one ``late`` later (microseconds for time stamps), and one that is older than what has been taken is not put into a
    segment but handed out as late. With ``idle``, such as "24 hours", a series without elements for so long (processing time) is finished: what waits is taken, its last segment closed, its state dropped;
    a stream with a timeout never runs out of batches, so one that is run once over what is there takes none.
    """
    kind = elements.schema[key].dataType.simpleString()
    patience = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, cut, last, seen, upto, *waiting = state.get if state.exists else (0, 0, 0.0, False, None, [], [], [])
        rows = [np.array(c, d) for c, d in zip(waiting, ("int64", "int64", float), strict=True)]
        old = [c[:0] for c in rows]
        if not state.hasTimedOut:
            given = [(b["_ts"].to_numpy("datetime64[us]").astype("int64") if b["_ts"].dtype.kind == "M" else b["_ts"].to_numpy("int64"), b["_tie"].to_numpy(), b["_value"].to_numpy(float)) for b in batches]
            new = [np.concatenate(c) for c in zip(*given, strict=True)]
            if upto is not None:
                passed = new[0] < upto
                old, new = [c[passed] for c in new], [c[~passed] for c in new]
            rows = [np.concatenate(c) for c in zip(rows, new, strict=True)] if len(rows[0]) else new
        order = np.lexsort((rows[1], rows[0]))
        rows = [c[order] for c in rows]
        ripe = len(order) if state.hasTimedOut or not len(order) else int(np.searchsorted(rows[0], int(rows[0][-1]) - late, "right"))
        values, closed = rows[2][:ripe], []
        before = np.concatenate([[last if seen else np.nan], values[:-1]]) if len(values) else values
        for i in np.flatnonzero(np.abs(values - before) >= threshold).tolist():
            if pos + i - cut >= min_len:
                closed.append((cut, pos + i))
                cut = pos + i
        if len(values):
            pos, last, seen, upto = pos + len(values), float(values[-1]), True, int(rows[0][ripe - 1])
        if state.hasTimedOut:
            state.remove()
            closed += [(cut, pos)] if pos > cut else []
        else:
            state.update((pos, cut, last, seen, upto, *(c[ripe:].tolist() for c in rows)))
            if patience:
                state.setTimeoutDuration(patience)
        n, m = len(closed), len(old[0])
        if not n + m:
            return
        late_ones = np.arange(n + m) >= n
        whole = lambda some, absent: pd.arrays.IntegerArray(np.asarray(some, "int64"), absent)
        yield pd.DataFrame(
            {
                key: [name[0]] * (n + m), "kind": ["segment"] * n + ["late"] * m, "start": whole([a for a, _ in closed] + [0] * m, late_ones), "end": whole([b for _, b in closed] + [0] * m, late_ones),
                "at": whole([0] * n + old[0].tolist(), ~late_ones), "value": np.concatenate([np.full(n, np.nan), old[2]]),
            }
        )

    out = f"{key} {kind}, kind string, start bigint, end bigint, at bigint, value double"
    held = "pos bigint, cut bigint, last double, seen boolean, upto bigint, times array<bigint>, ties array<bigint>, waiting array<double>"
    chosen = elements.select(key, F.col(ts).alias("_ts"), F.col(tie).cast("bigint").alias("_tie"), F.col(value).cast("double").alias("_value"))
    return chosen.groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def closed(found: DataFrame) -> DataFrame:
    """The segments that ``segments`` wrote."""
    return found.filter("kind = 'segment'").drop("kind", "at", "value")


def late_elements(found: DataFrame) -> DataFrame:
    """The elements that came too late for their segment."""
    return found.filter("kind = 'late'").drop("kind", "start", "end")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append", latest_by: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now, and return what it wrote. Update mode keeps each batch; latest_by then picks a key's last row. A batch that is run again replaces what it wrote before."""
    spark = df.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, epoch int").parquet(path)
    if latest_by:
        others = [c for c in df.columns if c not in latest_by]
        return out.groupBy(*latest_by).agg(F.max_by(F.struct(*others), "epoch").alias("_r")).select(*latest_by, "_r.*")
    return out.drop("epoch")
