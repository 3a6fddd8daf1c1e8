"""One very long series or group, without one task that sorts it.

A series that is longer than a cell is cut into *cells* at places taken from a sample of its order column; the same places hold for every pass, so a lost task finds its rows again. What a
window would carry along the series goes from cell to cell instead: a first pass leaves one summary row a cell (count, sum, greatest, last, next), a window over that small table gives
each cell its carry, and a second pass runs windows inside cells and adds the carry. Series of one cell have no carry and no summary row.

At most ``MOST_CELLS`` cells are made in all (cells then hold more rows), so the tables of bounds and carries, which are broadcast, have that many rows and
twice that many values at most, whatever the input. Rows with the same value of the order column share a cell; rows whose order column is null stand in the first. Keys may be null.
Columns that begin with an underscore are for this module's own use.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline.session import sound_unions

#: Rows to a cell; most cells of a table; sampled rows to a cell.
CELL_ROWS, MOST_CELLS, SAMPLED = 500_000, 1 << 14, 24


def _same(keys: Sequence[str], other: str) -> Column:
    """Null-safe equality of keys with columns named by their place."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{other}{i}"))
    return same


def joined(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls are equal."""
    columns = [c for c in other.columns if c not in keys]
    renamed = other.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *columns)
    return df.join(renamed, _same(keys, "_k"), how).drop(*(f"_k{i}" for i in range(len(keys))))


@dataclass(frozen=True)
class Cells:
    """Where the cells of each long series begin: keys and ``_bounds``, ascending, of series with two cells and more."""

    keys: tuple[str, ...]
    bounds: DataFrame

    def place(self, df: DataFrame, order: Column) -> DataFrame:
        """df with ``_cell``, the number of bounds up to a row's place; null for series of one cell. A broadcast join and a binary search."""
        found = joined(df, F.broadcast(self.bounds), self.keys, "left")
        steps = F.array(*(F.lit(1 << k) for k in range(MOST_CELLS.bit_length() - 1, -1, -1)))
        reached = lambda at, step: (at + step <= F.size("_bounds")) & (F.get("_bounds", at + step - 1) <= order)
        search = F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))
        return found.withColumn("_cell", F.when(F.col("_bounds").isNotNull(), search)).drop("_bounds")


def cells(df: DataFrame, keys: Sequence[str], order: str | Column, rows: int = CELL_ROWS) -> Cells:
    """Cells of about so many rows. Counts df and samples it: about ``SAMPLED`` rows a cell reach the driver, ``SAMPLED * MOST_CELLS`` at most."""
    keys = list(keys)
    order = F.col(order) if isinstance(order, str) else order
    placed = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), order.alias("_o")).filter("_o is not null")
    rows = max(rows, -(-placed.count() // MOST_CELLS), 1)
    share = min(1.0, SAMPLED / rows)
    if isinstance(placed.schema["_o"].dataType, T.FloatType | T.DoubleType):
        placed = placed.filter(~F.isnan("_o"))
    found: dict[tuple, list] = {}
    for r in placed.sample(share, 17).collect() if share < 1 else placed.collect():
        found.setdefault(tuple(r[:-1]), []).append(r[-1])
    bounds = []
    for key, places in found.items():
        places.sort()
        parts = min(len(places), -(-int(len(places) / share) // rows))
        cut = sorted({places[i * len(places) // parts] for i in range(1, parts)} - {places[0]})
        if cut:
            bounds.append((*key, cut))
    kinds = [T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("_bounds", T.ArrayType(placed.schema["_o"].dataType))]
    return Cells(tuple(keys), df.sparkSession.createDataFrame(bounds, T.StructType(kinds)))


#: Kinds of running columns: what a cell leaves, and how cells' values are carried.
_SUMMARY = {
    "row": lambda v, o: F.count(F.lit(1)),
    "sum": lambda v, o: F.sum(v),
    "max_before": lambda v, o: F.max(v),
    "previous": lambda v, o: F.max_by(v, o),
    "next": lambda v, o: F.min_by(v, o),
    "last": lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], wants: dict[str, tuple], split: Cells | None = None) -> DataFrame:
    """df with running columns. wants: name to (kind, column); kinds:

    ``row`` (number of the row, from 1), ``sum`` (of all so far, nulls left out), ``max_before`` (greatest before the row), ``previous`` and ``next`` (of the neighbours), ``last`` (the last
    that is not null, up to the row). order must tell a series' rows apart; its first column is the one that cells are cut by. Without cells a series is one window.
    """
    keys, order = list(keys), list(order)
    values = {n: F.col(f"_v{i}") for i, n in enumerate(wants)}
    given = df.select("*", *((w[1] if len(w) > 1 else F.lit(1)).alias(f"_v{i}") for i, w in enumerate(wants.values())))
    given = split.place(given, F.col(order[0])) if split else given.withColumn("_cell", F.lit(None).cast("int"))
    w = Window.partitionBy(*keys, "_cell").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = {
        "row": lambda v: F.row_number().over(w),
        "sum": lambda v: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "max_before": lambda v: F.max(v).over(before),
        "previous": lambda v: F.lag(v).over(w),
        "next": lambda v: F.lead(v).over(w),
        "last": lambda v: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }
    inside = given.select("*", *(local[kind](values[n]).alias(f"_w{i}") for i, (n, (kind, *_)) in enumerate(wants.items())))
    at_end = {}
    if split:
        place = F.struct(*order)
        summary = given.filter("_cell is not null").groupBy(*keys, "_cell").agg(*(_SUMMARY[kind](values[n], place).alias(f"_s{i}") for i, (n, (kind, *_)) in enumerate(wants.items())))
        over = Window.partitionBy(*keys).orderBy("_cell")
        past = over.rowsBetween(Window.unboundedPreceding, -1)
        carry = {
            "row": lambda s: F.coalesce(F.sum(s).over(past), F.lit(0)),
            "sum": lambda s: F.sum(s).over(past),
            "max_before": lambda s: F.max(s).over(past),
            "previous": lambda s: F.lag(s).over(over),
            "next": lambda s: F.lead(s).over(over),
            "last": lambda s: F.last(s, ignorenulls=True).over(past),
        }
        carries = summary.select(*keys, "_cell", *(carry[kind](F.col(f"_s{i}")).alias(f"_c{i}") for i, (kind, *_) in enumerate(wants.values())))
        inside = joined(inside, F.broadcast(carries), [*keys, "_cell"], "left")
        size = Window.partitionBy(*keys, "_cell")
        at_end = {"first": F.row_number().over(w) == 1, "last": F.row_number().over(w) == F.count(F.lit(1)).over(size)}
        inside = inside.select("*", *(v.alias(f"_is_{k}") for k, v in at_end.items()))
    out = []
    for i, (n, (kind, *_)) in enumerate(wants.items()):
        mine, carried = F.col(f"_w{i}"), F.col(f"_c{i}")
        if not split:
            out.append(mine.alias(n))
        elif kind == "row":
            out.append((mine + F.coalesce(carried, F.lit(0))).alias(n))
        elif kind == "sum":
            out.append(F.coalesce(mine + carried, mine, carried).alias(n))
        elif kind == "max_before":
            out.append(F.greatest(mine, carried).alias(n))
        elif kind == "last":
            out.append(F.coalesce(mine, carried).alias(n))
        else:
            out.append(F.when(F.col("_is_first" if kind == "previous" else "_is_last"), carried).otherwise(mine).alias(n))
    return inside.select(*(c for c in df.columns if c not in wants), *out)


# Intervals by sweep


def swept(elements: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str = "pos", split: Cells | None = None) -> DataFrame:
    """elements with override_start, override_end and the columns of the interval that holds them, else nulls; intervals of a series must not overlap.

    One sweep over elements and beginnings of intervals in order: the last interval that began is the only one that can hold an element. No condition on a range, whatever the number of intervals.
    """
    keys = list(keys)
    columns = [c for c in intervals.columns if c not in (*keys, "start", "end")]
    kind = elements.schema[pos].dataType
    held = F.struct(F.col("start").alias("override_start"), F.col("end").alias("override_end"), *columns)
    opened = intervals.filter("end > start").select(*keys, F.col("start").cast(kind).alias("_at"), F.lit(0).cast("long").alias("_turn"), held.alias("_held"))
    named = F.struct(*(F.col(c) for c in elements.columns)).alias("_row")
    tie = F.monotonically_increasing_id()  # rows at one place: any order
    points = elements.select(*keys, F.col(pos).alias("_at"), (tie + 1).alias("_turn"), named)
    sound_unions(elements.sparkSession)
    both = opened.unionByName(points, allowMissingColumns=True)
    found = running(both, keys, ["_at", "_turn"], {"_open": ("last", F.col("_held"))}, split).filter("_row is not null")
    inside = F.col("_at") < F.col("_open.override_end")
    return found.select("_row.*", *(F.when(inside, F.col("_open")[c]).alias(c) for c in ("override_start", "override_end", *columns)))


# Least distances


def _next_ones(p: np.ndarray, least: int) -> np.ndarray:
    """The first candidate at least so far after each; len(p) for none."""
    return np.maximum(np.searchsorted(p, p + least, "left"), np.arange(1, len(p) + 1))


def _last_reached(succ: np.ndarray) -> np.ndarray:
    """Where the walk from each candidate ends within the cell, by pointer jumping."""
    n = len(succ)
    last, jump = np.arange(n), np.append(succ, n)
    while (jump[:n] < n).any():
        on = jump[:n] < n
        last[on] = last[jump[:n][on]]
        jump = jump[jump]
    return last


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys in sorted batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = [c[a].as_py() for c in columns]
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def spaced(cuts: DataFrame, keys: Sequence[str], split: Cells, min_len: str = "min_len", start: str = "scope_start") -> DataFrame:
    """Cuts that are at least min_len after the last accepted one, or after the start of their scope: what ``segments.spaced`` gives, for scopes of any length.

    cuts: keys (with the scope), pos, min_len and start; cells are those of keys and pos. What a cell accepts depends only on the least position that the cells before it leave. A first pass
    follows, in each cell, the pointers from every candidate that can be its first to where their walks end; they are as many as lie within min_len of the cell's begin. These few rows are
    followed from cell to cell, and a second pass walks each cell from the position it is left with.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in cuts.schema}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    at = F.col("pos").cast("long")
    possible = cuts.filter(at - F.col(start) >= F.col(min_len)).select(
        *dict.fromkeys([*keys, start]), at.alias("pos"), F.col(min_len).cast("long").alias("_least"), (F.col(start) + F.col(min_len)).cast("long").alias("_from")
    )
    placed = split.place(possible, F.col("pos")).withColumn("_cell", F.coalesce("_cell", F.lit(0)))
    dealt = placed.repartition(*keys, "_cell").sortWithinPartitions(*keys, "_cell", "pos")

    def firsts(batches):
        for rows in runs(batches, [*keys, "_cell"]):
            p, least = rows.column("pos").to_numpy(), rows.column("_least")[0].as_py()
            end = p[_last_reached(_next_ones(p, least))] + max(least, 0)
            can = np.flatnonzero(np.append(p[0] - 1, p[:-1]) < p[0] + max(least, 1))
            yield pa.RecordBatch.from_pydict(
                {k: pa.array([rows.column(k)[0].as_py()] * len(can), rows.schema.field(k).type) for k in [*keys, "_cell", "_from"]} | {"_first": pa.array(p[can]), "_leaves": pa.array(end[can])}
            )

    steps = dealt.mapInArrow(firsts, f"{named}, _cell int, _from long, _first long, _leaves long")

    def follow(batches):
        now, cell, left, entered, settled = None, None, 0, 0, False
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "_cell", "_from", "_first", "_leaves")]
            for i, (*key, c, begin, first, leaves) in enumerate(zip(*columns, strict=True)):
                if key != now:
                    now, cell, left = key, None, begin
                if c != cell:
                    cell, entered, settled = c, left, False
                    out.append((i, entered))
                if not settled and first >= entered:  # the first candidate from there on
                    left, settled = leaves, True
            rows = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_pydict({k: batch.column(k).take(rows) for k in [*keys, "_cell"]} | {"_enter": pa.array([t for _, t in out], pa.int64())})

    # a row a candidate near a cell's begin: small, one walk a scope
    entries = steps.repartition(*keys).sortWithinPartitions(*keys, "_cell", "_first").mapInArrow(follow, f"{named}, _cell int, _enter long")

    def walk(batches):
        for rows in runs(batches, [*keys, "_cell"]):
            p, least, enter = rows.column("pos").to_numpy(), rows.column("_least")[0].as_py(), rows.column("_enter")[0].as_py()
            succ, kept = _next_ones(p, least), []
            i = int(np.searchsorted(p, enter, "left"))
            while i < len(p):
                kept.append(i)
                i = int(succ[i])
            taken = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_pydict({k: rows.column(k).combine_chunks().take(taken) for k in keys} | {"pos": pa.array(p[kept])})

    entered = joined(placed, entries, [*keys, "_cell"]).repartition(*keys, "_cell").sortWithinPartitions(*keys, "_cell", "pos")
    return entered.mapInArrow(walk, f"{named}, pos long")


# Order statistics of huge groups


@dataclass(frozen=True)
class Brackets:
    """Where the asked elements of each large group are looked for: keys and bounds ``_b0``, ``_b1``, ... of values, null where there is none."""

    keys: tuple[str, ...]
    bounds: DataFrame
    n: int

    def place(self, df: DataFrame, value: Column) -> DataFrame:
        """df with ``_cell``, the number of bounds up to a row's value; null for groups without bounds. A few comparisons a row, whatever the input."""
        found = joined(df, F.broadcast(self.bounds.withColumn("_cut", F.lit(True))), self.keys, "left")
        names = [f"_b{i}" for i in range(self.n)]
        passed = sum((F.when(F.col(b) <= value, 1).otherwise(0) for b in names), F.lit(0))
        return found.withColumn("_cell", F.when(F.col("_cut"), passed)).drop(*names, "_cut")


def brackets(df: DataFrame, keys: Sequence[str], value: str, ranks, rows: int = CELL_ROWS, n: int | None = None) -> Brackets:
    """Bounds around the values that ranks (see ``selected``) ask for, of groups of about so many rows and more.

    From a sample of ``SAMPLED * MOST_CELLS`` rows at most, none of which reaches the driver: the asked element of a group's sample, five standard deviations of its place lower and higher. What lies between is a share of the group
    that falls with the root of its sample (0.8 % at most where a group has all of it). A sample that is off costs time only, as elements are counted exactly in all cells. n: df's rows, if known.
    """
    keys = list(keys)
    some = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    share = min(1.0, SAMPLED * MOST_CELLS / max(some.count() if n is None else n, 1))
    groups = (some.sample(share, 17) if share < 1 else some).groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_s")).withColumn("_m", F.size("_s").cast("long"))
    groups = groups.filter(F.col("_m") >= max(2.0 * SAMPLED, rows * share))  # so there are MOST_CELLS / 2 at most
    bounds = []
    for rank in ranks.values():
        at = F.least(F.greatest(rank(F.col("_m")).cast("long"), F.lit(0)), F.col("_m") - 1)
        p = (at + 0.5) / F.col("_m")
        off = (F.ceil(5 * F.sqrt(F.greatest(F.col("_m") * p * (1 - p), F.lit(1.0)))) + 1).cast("long")
        bounds += [F.get("_s", (at - off).cast("int")), F.get("_s", (at + off).cast("int"))]
    return Brackets(tuple(keys), groups.select(*keys, *(b.alias(f"_b{i}") for i, b in enumerate(bounds))), len(bounds))


def selected(df: DataFrame, keys: Sequence[str], value: str, ranks, split: Brackets | Cells) -> DataFrame:
    """(keys, _n, name, value) of the elements of each group that ranks asks for, without sorting a group.

    ranks: name to a function of the group's size (a column) that gives an element's place from 0. Elements are counted by ranges of their values (cells); the range that holds a rank is narrowed to its distinct values, counted
    beforehand, and only those are put in order. Nulls are left out.
    """
    keys = list(keys)
    placed = split.place(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x")), F.col("_x"))
    counts = placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_m"))
    group = Window.partitionBy(*keys)
    past = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select("*", F.sum("_m").over(group).alias("_n"), F.coalesce(F.sum("_m").over(past), F.lit(0)).alias("_before"))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("at")) for name, rank in ranks.items()))
    asks = ranges.select(*keys, "_cell", "_n", "_m", "_before", F.explode(asked).alias("_a")).filter("_a.at >= _before and _a.at < _before + _m")
    asks = asks.select(*keys, "_cell", "_n", F.col("_a.name").alias("name"), (F.col("_a.at") - F.col("_before")).alias("_at"))
    # groups of several cells are few, so their asked cells are broadcast; of the others all rows are asked for
    hits = asks.filter("_cell is not null").select(*keys, "_cell").distinct().withColumn("_asked", F.lit(True))
    narrowed = joined(placed, F.broadcast(hits), [*keys, "_cell"], "left").filter("_cell is null or _asked").groupBy(*keys, "_cell", "_x").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ordered = narrowed.withColumn("_upto", upto)
    hit = joined(ordered, asks, [*keys, "_cell"]).filter("_at < _upto and _at >= _upto - _m")
    return hit.select(*keys, "_n", "name", F.col("_x").alias("value"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float], plot: bool = False, prefix: str = "p", rows: int = CELL_ROWS) -> DataFrame:
    """What ``stats.percentiles`` gives, for groups of any size."""
    name = lambda p: f"{prefix}{p:g}".replace(".", "_")

    def rank(p: float):
        def at(n: Column) -> Column:
            wanted = F.floor((n - 1) * F.lit(p / 100.0)) if plot else F.floor(F.lit(p / 100.0) * n)
            return wanted if plot else F.when(wanted < n, wanted).otherwise(0)

        return at

    some = df.filter(F.col(value).isNotNull())
    ranks = {name(p): rank(p) for p in ps}
    found = selected(some, keys, value, ranks, brackets(some, keys, value, ranks, rows))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name(p), F.col("value"))).alias(name(p)) for p in ps))


def median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", rows: int = CELL_ROWS) -> DataFrame:
    """The mean of the two middle elements of each group, which are one where the size is odd."""
    some = df.filter(F.col(value).isNotNull())
    ranks = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}
    found = selected(some, keys, value, ranks, brackets(some, keys, value, ranks, rows))
    return found.groupBy(*keys).agg(F.avg(F.col("value").cast("double")).alias(out))


# Levels


def levels(df: DataFrame, keys: Sequence[str], value: str, p: float, rows: int = CELL_ROWS) -> DataFrame:
    """The percentile of value at each level of keys, from all of them to none: (keys, level, n, exact, estimate, low, high).

    exact is recomputed at each level by ranges of values. estimate comes from sketches (KLL) that are built once, at the finest level, and merged upwards; low and high are exact elements: those as far below and above the rank as the
    sketch's error bound for its size allows (``RANK_ERROR`` of n), between which the estimate must lie.
    """
    keys = list(keys)
    some = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    finest = some.groupBy(*keys).agg(F.expr("kll_sketch_agg_double(_x)").alias("_sketch"))
    share = p / 100.0
    held = lambda n, at: F.least(F.greatest(F.floor(at), F.lit(0)), n - 1)
    ranks = {
        "exact": lambda n: held(n, n * share),
        "low": lambda n: held(n, n * (share - RANK_ERROR) - 1),
        "high": lambda n: held(n, n * (share + RANK_ERROR) + 1),
    }
    out, n = None, some.count()
    for level in range(len(keys), -1, -1):
        own, dropped = keys[:level], keys[level:]
        split = brackets(some, own, "_x", ranks, rows, n)
        found = selected(some, own, "_x", ranks, split).groupBy(*own).agg(F.first("_n").alias("n"), *(F.max(F.when(F.col("name") == r, F.col("value"))).alias(r) for r in ranks))
        merged = finest.groupBy(*own).agg(F.expr("kll_merge_agg_double(_sketch)").alias("_sketch")).select(*own, F.expr(f"kll_sketch_get_quantile_double(_sketch, {share}D)").alias("estimate"))
        both = joined(found, merged, own).select(*own, *(F.lit(None).cast(df.schema[k].dataType).alias(k) for k in dropped), F.lit(level).alias("level"), "n", "exact", "estimate", "low", "high")
        out = both if out is None else out.unionByName(both)
    sound_unions(df.sparkSession)
    return out


#: Normalised rank error of a sketch of the default size (k = 200), at 99 % confidence, and as much again for the merges.
RANK_ERROR = 0.0266
