"""Statistics of a series' element scores, group by group.

Plain statistics are aggregate columns, so any number of them share one pass with partial aggregation. Order statistics
and the first mode need all scores of a group in order; they come as DataFrame functions with a window form, which spills and
has no bound on a group's size, and an array form for groups known to be small.

Scores of NaN are to be rejected beforehand (``reject_nan``); infinite scores are kept. Nulls are ignored, as SQL does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def reject_nan(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows to work on, rejects with a reason)."""
    bad = F.isnan(F.col(value))
    return df.filter(~bad | F.col(value).isNull()), df.filter(bad).withColumn("reject_reason", F.lit("score is NaN"))


# Aggregates


def mean(x: Column) -> Column:
    return F.avg(x)


def harmonic_mean(x: Column) -> Column:
    """n over the sum of reciprocals; 0 as soon as one score is 0, null where the reciprocals cancel out."""
    return F.try_divide(F.count(x).cast("double"), F.sum(F.when(x == 0, F.lit(INF)).otherwise(F.try_divide(F.lit(1.0), x))))


def median(x: Column) -> Column:
    return F.median(x)


def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def variance(x: Column) -> Column:
    return F.var_pop(x)


def deviation(x: Column) -> Column:
    return F.stddev_pop(x)


def clamped_sigma(x: Column, k: Column | float) -> Column:
    """Mean plus k deviations, held between the smallest and the greatest score."""
    return F.least(F.greatest(F.avg(x) + k * F.stddev_pop(x), F.min(x)), F.max(x))


# Channels


def weighted(y: Column, u: Column, v: Column) -> Column:
    """Linear weighting of three channels."""
    return (4.0 * y + u + v) / 6.0


def _power(x: Column) -> Column:
    return F.pow(F.lit(10.0), -x / 10.0)


def weighted_log(y: Column, u: Column, v: Column) -> Column:
    """Weighting in the log domain (decibels); without any error the result is infinite."""
    error = (4.0 * _power(y) + _power(u) + _power(v)) / 6.0
    return F.when(error <= 0, F.lit(INF)).otherwise(-10.0 * F.log10(error))


def lowest_channel(y: Column, u: Column, v: Column) -> Column:
    return F.least(y, u, v)


def or_infinite(x: Column) -> Column:
    """A missing channel counts as perfect."""
    return F.coalesce(x, F.lit(INF))


def channel_average(y: Column, u: Column, v: Column, how: str = "weighted") -> Column:
    """Aggregate: weighting (log domain) or minimum of the channels' averages, not average of the elements' weightings."""
    averages = (F.avg(y), F.avg(u), F.avg(v))
    return weighted_log(*averages) if how == "weighted" else F.least(*averages)


# Order statistics


def _at(place: Column, n: Column, p: float, plot: bool) -> Column:
    """Is this the element that percentile p names? place counts from 0."""
    wanted = F.floor((n - 1) * F.lit(p / 100.0)) if plot else F.floor(F.lit(p / 100.0) * n)
    return place == (wanted if plot else F.when(wanted < n, wanted).otherwise(0))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float], plot: bool = False, small_groups: bool = False, prefix: str = "p") -> DataFrame:
    """Floor-index percentiles of each group, one column for each of ps.

    The index is ``floor(p/100 * n)``; one beyond the last element names the smallest, so p = 100 gives the minimum. With plot the index is
    ``floor((n-1) * p/100)``. small_groups sorts each group in an array instead of a window.
    """
    name = lambda p: f"{prefix}{p:g}".replace(".", "_")
    rows = df.filter(F.col(value).isNotNull())
    if small_groups:
        sorted_scores = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s")).withColumn("_n", F.size("_s"))

        def pick(p: float) -> Column:
            i = F.floor((F.col("_n") - 1) * F.lit(p / 100.0)) if plot else F.floor(F.lit(p / 100.0) * F.col("_n"))
            i = i.cast("int")
            return F.coalesce(F.get("_s", i), F.get("_s", F.lit(0)))

        return sorted_scores.select(*keys, *(pick(p).alias(name(p)) for p in ps))
    group = Window.partitionBy(*keys)
    placed = rows.withColumn("_i", F.row_number().over(group.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    return placed.groupBy(*keys).agg(*(F.max(F.when(_at(F.col("_i"), F.col("_n"), p, plot), F.col(value))).alias(name(p)) for p in ps))


def first_mode(df: DataFrame, keys: Sequence[str], value: str, order: str, out: str = "mode") -> DataFrame:
    """The first score, in series order, of those whose whole-number bucket (half away from zero) is fullest.

    Buckets are counted with partial aggregation; among equally full ones the one seen first wins.
    """
    buckets = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.round(F.col(value)).alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(order).alias("pos"), F.col(value).alias("score"))).alias("_first"))
    )
    return buckets.groupBy(*keys).agg(F.max_by("_first", F.struct("_n", -F.col("_first.pos"))).alias("_f")).select(*keys, F.col("_f.score").alias(out))


# Statistic chosen by policy


def summarise(df: DataFrame, keys: Sequence[str], value: str, order: str, policy: DataFrame) -> DataFrame:
    """``result`` of each group by the statistic its policy names.

    policy: one row a group with keys, stat_name, stat_value, metric and scale_pos (place of the setting on its scale, 0 to 1).
    All plain statistics come from one pass; order statistics and modes are computed for the groups that ask for them only.
    ``auto``: first percentile for the metric vmaf; else the mean where scale_pos exceeds a quarter; else mean minus one deviation, held within the scores.
    """
    keys = list(keys)
    x = F.col(value)
    plain = df.groupBy(*keys).agg(
        mean(x).alias("mean"), harmonic_mean(x).alias("harmonic"), median(x).alias("median"), root_mean_square(x).alias("rms"),
        F.min(x).alias("low"), F.max(x).alias("high"), deviation(x).alias("sd"),
    )
    by_vmaf = (F.col("stat_name") == "auto") & (F.col("metric") == "vmaf")
    wanted = F.when(by_vmaf, 1).when(F.col("stat_name") == "percentile", F.col("stat_value").cast("int"))
    asks = policy.select(*keys, wanted.alias("_p")).filter("_p is not null")
    group = Window.partitionBy(*keys)
    ranked = df.filter(x.isNotNull()).join(asks, keys).withColumn("_i", F.row_number().over(group.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    index = F.floor(F.col("_p") / 100.0 * F.col("_n"))
    picked = ranked.filter(F.col("_i") == F.when(index < F.col("_n"), index).otherwise(0)).select(*keys, x.alias("percentile"))
    modes = first_mode(df.join(policy.filter("stat_name = 'mode'").select(*keys), keys, "left_semi"), keys, value, order)
    joined = policy.join(plain, keys).join(picked, keys, "left").join(modes, keys, "left")
    held = lambda k: F.least(F.greatest(F.col("mean") + k * F.col("sd"), F.col("low")), F.col("high"))
    name = F.col("stat_name")
    automatic = F.when(F.col("metric") == "vmaf", F.col("percentile")).when(F.col("scale_pos") > 0.25, F.col("mean")).otherwise(held(F.lit(-1.0)))
    result = (
        F.when(name == "auto", automatic)
        .when(name == "mean", F.col("mean")).when(name == "harmonic", F.col("harmonic")).when(name == "median", F.col("median"))
        .when(name == "mode", F.col("mode")).when(name == "minimum", F.col("low")).when(name == "maximum", F.col("high"))
        .when(name == "root-mean-square", F.col("rms")).when(name == "percentile", F.col("percentile"))
        .when(name == "standard-deviation", held(F.col("stat_value")))
    )
    return joined.select(*keys, "stat_name", "stat_value", result.alias("result"))
