"""Statistics of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions import settings, stats

from .tables import EVENTS_SQL, LINES_SQL, events, lines, table


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def stat_basic(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(x).alias("n"), _r(stats.mean(x), "mean"), _r(stats.median(x), "median"), F.min(x).alias("low"), F.max(x).alias("high"),
        _r(stats.variance(x), "variance"), _r(stats.deviation(x), "deviation"), _r(stats.root_mean_square(x), "rms"),
    )


def stat_harmonic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(_r(stats.harmonic_mean(F.col("l_quantity")), "of_quantity"), _r(stats.harmonic_mean(F.col("l_discount")), "of_discount"))


def stat_mode_first(spark: SparkSession, sf: str) -> DataFrame:
    return stats.first_mode(lines(spark, sf), ["l_partkey"], "l_quantity", "pos")


def stat_percentile_floor(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentiles(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity", [1, 25, 99, 100])


def stat_percentile_floor_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentiles(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity", [1, 25, 99, 100], small_groups=True)


def stat_plot_bands(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentiles(table(spark, sf, "events"), ["user_id"], "value", [1, 25, 50, 75], plot=True)


def stat_sigma_clamped(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").groupBy("user_id").agg(_r(stats.clamped_sigma(v, -0.25), "quarter_below"), _r(stats.clamped_sigma(v, 2.0), "two_above"), _r(stats.clamped_sigma(v, -9.0), "at_lowest"))


#: statistic, value, metric, setting and family of parts by key modulo 8.
_POLICIES = [
    (0, "auto", None, "vmaf", 30, "aom"), (1, "auto", None, "ssimulacra2", 40, "rav1e"), (2, "auto", None, "ssimulacra2", 40, "x264"), (3, "percentile", 25.0, "vmaf", 1, "vpx"),
    (4, "mode", None, "vmaf", 1, "x265"), (5, "standard-deviation", -0.5, "vmaf", 1, "aom"), (6, "harmonic", None, "vmaf", 1, "aom"), (7, "root-mean-square", None, "vmaf", 1, "svt-av1"),
]


def stat_policy_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    kinds = spark.createDataFrame(_POLICIES, "m int, stat_name string, stat_value double, metric string, setting int, family string")
    scaled = kinds.join(F.broadcast(settings.families(spark)), "family").select("m", "stat_name", "stat_value", "metric", settings.scale_position(F.col("setting"), F.col("scale")).alias("scale_pos"))
    parts = table(spark, sf, "lineitem").select("l_partkey").distinct().withColumn("m", (F.col("l_partkey") % 8).cast("int"))
    policy = parts.join(F.broadcast(scaled), "m").drop("m")
    found = stats.summarise(lines(spark, sf), ["l_partkey"], "l_quantity", "pos", policy)
    return found.select("l_partkey", "stat_name", _r(F.col("result"), "result"))


def channel_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Element weightings averaged, and weightings of averages; the third channel is missing where the tax is 0."""
    y, u = F.col("l_quantity"), 100 * F.col("l_discount")
    v = stats.or_infinite(F.when(F.col("l_tax") > 0, 100 * F.col("l_tax")))
    full = 100 * F.col("l_tax")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        _r(F.avg(stats.weighted(y, u, full)), "linear"), _r(F.avg(stats.weighted_log(y, u, v)), "logarithmic"), _r(F.avg(stats.lowest_channel(y, u, v)), "lowest"),
        _r(stats.channel_average(y, u, full), "of_averages"), _r(stats.channel_average(y, u, full, "minimum"), "lowest_average"),
    )


QUERIES = {
    f.__name__: f
    for f in (stat_basic, stat_harmonic, stat_mode_first, stat_percentile_floor, stat_percentile_floor_arrays, stat_plot_bands, stat_sigma_clamped, stat_policy_dispatch, channel_weighted)
}

_PERCENTILES = "SELECT l_partkey, " + ", ".join(
    f"s[CASE WHEN floor({p}::DOUBLE / 100 * len(s)) < len(s) THEN floor({p}::DOUBLE / 100 * len(s))::INT ELSE 0 END + 1] AS p{p}" for p in (1, 25, 99, 100)
) + " FROM (SELECT l_partkey, list_sort(list(l_quantity)) AS s FROM lineitem GROUP BY l_partkey)"

_HELD = "least(greatest({m} + {k} * {s}, {lo}), {hi})"

SQL = {
    "stat_basic": "SELECT l_partkey, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, min(l_quantity) AS low, max(l_quantity) AS high, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS deviation, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY l_partkey",
    "stat_harmonic": "SELECT l_partkey, round(count(*) / sum(1.0::DOUBLE / l_quantity), 6) AS of_quantity, CASE WHEN count(*) FILTER (WHERE l_discount = 0) > 0 THEN 0.0 ELSE round(count(*) / sum(1.0::DOUBLE / l_discount), 6) END::DOUBLE AS of_discount FROM lineitem GROUP BY l_partkey",
    "stat_mode_first": f"""WITH {LINES_SQL}, b AS (SELECT l_partkey, round(l_quantity) AS bucket, count(*) AS n, min(pos) AS pos FROM l GROUP BY ALL),
        f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, pos) AS rn FROM b) SELECT l_partkey, l.l_quantity AS mode FROM f JOIN l USING (l_partkey, pos) WHERE rn = 1""",
    "stat_percentile_floor": _PERCENTILES,
    "stat_percentile_floor_arrays": _PERCENTILES,
    "stat_plot_bands": "SELECT user_id, " + ", ".join(f"s[floor((len(s) - 1) * ({p}::DOUBLE / 100))::INT + 1] AS p{p}" for p in (1, 25, 50, 75)) + " FROM (SELECT user_id, list_sort(list(value)) AS s FROM events GROUP BY user_id)",
    "stat_sigma_clamped": "SELECT user_id, " + ", ".join(
        f"round({_HELD.format(m='avg(value)', k=k, s='stddev_pop(value)', lo='min(value)', hi='max(value)')}, 6) AS {n}" for k, n in ((-0.25, "quarter_below"), (2.0, "two_above"), (-9.0, "at_lowest"))
    ) + " FROM events GROUP BY user_id",
    "stat_policy_dispatch": f"""WITH {LINES_SQL}, p AS (SELECT l_partkey, l_partkey % 8 AS m, list_sort(list(l_quantity)) AS s, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi,
          count(*) / sum(1.0::DOUBLE / l_quantity) AS harmonic, sqrt(avg(l_quantity * l_quantity)) AS rms FROM l GROUP BY l_partkey),
        b AS (SELECT l_partkey, round(l_quantity) AS bucket, count(*) AS n, min(pos) AS pos FROM l GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, pos) AS rn FROM b),
        o AS (SELECT f.l_partkey, l.l_quantity AS mode FROM f JOIN l USING (l_partkey, pos) WHERE rn = 1)
        SELECT l_partkey, CASE m WHEN 0 THEN 'auto' WHEN 1 THEN 'auto' WHEN 2 THEN 'auto' WHEN 3 THEN 'percentile' WHEN 4 THEN 'mode' WHEN 5 THEN 'standard-deviation' WHEN 6 THEN 'harmonic' ELSE 'root-mean-square' END AS stat_name,
          round(CASE m WHEN 0 THEN s[floor(0.01::DOUBLE * len(s))::INT + 1] WHEN 1 THEN {_HELD.format(m='mean', k='-1', s='sd', lo='lo', hi='hi')} WHEN 2 THEN mean WHEN 3 THEN s[floor(0.25::DOUBLE * len(s))::INT + 1]
            WHEN 4 THEN mode WHEN 5 THEN {_HELD.format(m='mean', k='-0.5', s='sd', lo='lo', hi='hi')} WHEN 6 THEN harmonic ELSE rms END, 6) AS result FROM p JOIN o USING (l_partkey)""",
    "channel_weighted": """WITH c AS (SELECT l_partkey, l_quantity AS y, 100 * l_discount AS u, 100 * l_tax AS w, CASE WHEN l_tax > 0 THEN 100 * l_tax ELSE 'inf'::DOUBLE END AS v FROM lineitem)
        SELECT l_partkey, round(avg((4 * y + u + w) / 6), 6) AS linear, round(avg(-10 * log10((4 * pow(10, -y / 10) + pow(10, -u / 10) + CASE WHEN isinf(v) THEN 0 ELSE pow(10, -v / 10) END) / 6)), 6) AS logarithmic,
          round(avg(least(y, u, v)), 6) AS lowest, round(-10 * log10((4 * pow(10, -avg(y) / 10) + pow(10, -avg(u) / 10) + pow(10, -avg(w) / 10)) / 6), 6) AS of_averages, round(least(avg(y), avg(u), avg(w)), 6) AS lowest_average
        FROM c GROUP BY l_partkey""",
}
