"""Cells against windows: the same rows, whatever the length of a series."""

import random

import pytest
from pyspark.sql import functions as F

from cutline.functions import stats
from cutline.operators import ledger, long, segments

KEYS = ["series", "kind"]


def rows_of(df):
    return sorted((tuple(map(repr, r)) for r in df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def series(spark):
    """One long series, one with a null key, short ones, gaps between positions, nulls and equal values."""
    rng = random.Random(1)
    rows, at = [], 0
    for _ in range(9000):
        at += rng.randrange(1, 4)
        rows.append((1, "a", at, rng.choice([None, 1.5, 2.5, rng.random() * 9])))
    rows += [(None, "b", 5 * k, float(k % 7)) for k in range(3000)]
    rows += [(s, None, k, float(k * s)) for s in range(2, 60) for k in range(s % 5)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "series int, kind string, pos long, value double").repartition(3).cache()


@pytest.fixture(scope="module")
def split(series):
    found = long.cells(series, KEYS, "pos", 700)
    sizes = {r.n for r in found.place(series, F.col("pos")).filter("_cell is not null").groupBy(*KEYS, "_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(sizes) < 3 * 700 and len(sizes) > 8
    return found


def test_running_columns(series, split):
    wants = {
        "row": ("row",), "sum": ("sum", F.col("value")), "best": ("max_before", F.col("value")), "before": ("previous", F.col("value")),
        "after": ("next", F.col("value")), "known": ("last", F.when(F.col("value") > 8, F.col("pos"))),
    }
    a, b = (long.running(series, KEYS, ["pos"], wants, s).withColumn("sum", F.round("sum", 6)) for s in (split, None))
    assert rows_of(a) == rows_of(b)


def test_functions_of_segments_and_ledger(spark, series, split):
    n = series.groupBy(*KEYS).agg((F.max("pos") + 3).alias("n_elements")).filter("series is not null and kind is not null")
    cuts = series.filter("pos % 5 = 0")
    for f in (
        lambda s: segments.from_cuts(cuts, n, KEYS, split=s),
        lambda s: segments.scalar_costs(series, KEYS, "pos", "value", F.lit(1.0), split=s),
        lambda s: ledger.increments(series, KEYS, ["pos"], "value", split=s),
        lambda s: segments.numbered(series.withColumnRenamed("pos", "start"), KEYS, s),
        lambda s: segments.gaps_filled(cuts.select(*KEYS, F.col("pos").alias("start"), (F.col("pos") + F.col("pos") % 3 + 1).alias("end")), n, KEYS, s),
        lambda s: segments.within_spans(cuts.select(*KEYS, F.col("pos").alias("start"), (F.col("pos") + 7).alias("end")), series.filter("pos % 30 = 0"), n, KEYS, s),
    ):
        assert rows_of(f(split)) == rows_of(f(None)) and f(None).count() > 100


def test_sweep_equals_range_join(series, split):
    known = series.filter("series is not null and kind is not null")
    intervals = known.filter("pos % 16 < 2").groupBy(*KEYS, F.floor(F.col("pos") / 16).alias("g")).agg(F.min("pos").alias("start"), F.max(F.col("value")).alias("own"))
    intervals = intervals.select(*KEYS, "start", (F.col("start") + F.col("g") % 11).alias("end"), "own")
    expected = rows_of(segments.attached(known, intervals.filter("end > start"), KEYS))
    for s in (split, None):
        assert rows_of(long.swept(known, intervals, KEYS, split=s)) == expected


@pytest.mark.parametrize("least", [0, 1, 2, 7, 40, 5000, 10**6])
def test_least_distances(series, split, least):
    cuts = series.filter("series is not null and kind is not null").select(*KEYS, "pos", F.lit(least).alias("min_len"), (F.col("series") % 2 * 50 - 3).alias("scope_start"))
    cuts = cuts.unionByName(cuts.filter("pos % 9 = 0"))  # repeated cuts
    assert rows_of(long.spaced(cuts, KEYS, split)) == rows_of(segments.spaced(cuts, KEYS))
    tiny = long.cells(cuts, KEYS, "pos", 5)
    assert rows_of(long.spaced(cuts, KEYS, tiny)) == rows_of(segments.spaced(cuts, KEYS))


def test_least_distances_of_scopes(spark):
    rng = random.Random(8)
    rows = [(s, 100 * s + rng.randrange(400), s % 4 + 1, 100 * s) for s in range(40) for _ in range(rng.randrange(200))]
    cuts = spark.createDataFrame(rows, "scope_start_key long, pos long, min_len int, scope_start long")
    keys = ["scope_start_key"]
    assert rows_of(long.spaced(cuts, keys, long.cells(cuts, keys, "pos", 30))) == rows_of(segments.spaced(cuts, keys))
    none = cuts.filter("pos < 0")
    assert long.spaced(none, keys, long.cells(none, keys, "pos", 30)).count() == 0


def test_order_statistics(series):
    ps = [0, 1, 33.3, 50, 99, 100]
    for plot in (False, True):
        expected = rows_of(stats.percentiles(series, KEYS, "value", ps, plot))
        for rows in (50, 10**6):
            assert rows_of(long.percentiles(series, KEYS, "value", ps, plot, rows=rows)) == expected
    assert rows_of(long.median(series, KEYS, "value", rows=100)) == rows_of(series.filter("value is not null").groupBy(*KEYS).agg(F.median("value").alias("median")))
    same = series.withColumn("value", F.lit(4.0))
    assert rows_of(long.percentiles(same, ["kind"], "value", [1, 50], rows=50)) == rows_of(stats.percentiles(same, ["kind"], "value", [1, 50]))
    assert long.percentiles(series.filter("pos < 0"), KEYS, "value", [5]).count() == 0


def test_levels(series):
    for p in (5, 50):
        found = long.levels(series, KEYS, "value", p, rows=300).collect()
        known = series.filter("value is not null")
        assert len(found) == known.select(*KEYS).distinct().count() + known.select("series").distinct().count() + 1
        assert all(r.low <= r.estimate <= r.high and r.low <= r.exact <= r.high for r in found)
        whole = next(r for r in found if r.level == 0)
        values = sorted(r.value for r in known.collect())
        assert (whole.n, whole.exact) == (len(values), values[int(len(values) * p / 100)])


def test_asked_values_are_looked_for_between_few_bounds(spark):
    """However many rows: two bounds an asked element, and what lies between them is a small share of a group."""
    ranks = {"fifth": lambda n: F.floor(n * 0.05), "last": lambda n: n - 1}
    df = spark.range(300_000).select((F.col("id") % 2).alias("k"), (F.xxhash64("id") / 1e9).alias("v"))
    found = long.brackets(df, ["k"], "v", ranks, 2_000)
    assert len(found.bounds.columns) == 5 and found.bounds.count() == 2
    sizes = {(r.k, r["_cell"]): r["count"] for r in found.place(df, F.col("v")).groupBy("k", "_cell").count().collect()}
    assert max(sizes[k, 1] for k in (0, 1)) < 2_000 and sum(sizes.values()) == 300_000
    rows = {(r.k, r.name): r.value for r in long.selected(df, ["k"], "v", ranks, found).collect()}
    for k in (0, 1):
        values = sorted(r.v for r in df.filter(F.col("k") == k).collect())
        assert (rows[k, "fifth"], rows[k, "last"]) == (values[7_500], values[-1])
