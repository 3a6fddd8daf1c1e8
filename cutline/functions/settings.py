"""Settings, metrics and policies: scales, orientation, bands, rounding, and the texts that users write them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For each family the default setting limits, the full scale, and the step that settings come in.
FAMILIES = [
    ("aom", 15, 55, 64.0, 1.0),
    ("rav1e", 50, 140, 256.0, 1.0),
    ("vpx", 15, 55, 64.0, 1.0),
    ("svt-av1", 15, 50, 64.0, 1.0),
    ("x264", 15, 35, 52.0, 0.25),
    ("x265", 15, 35, 52.0, 0.25),
]
#: Metrics of which less is better; statistics; methods for three and for four points.
LOWER_IS_BETTER = ("butteraugli-inf", "butteraugli-3")
STATISTICS = ("auto", "mean", "harmonic", "root-mean-square", "median", "mode", "minimum", "maximum")
METHODS_3 = ("linear", "quadratic", "natural")
METHODS_4 = ("linear", "quadratic", "natural", "pchip", "catmull", "akima", "cubic")


def families(spark: SparkSession) -> DataFrame:
    """family, min_default, max_default, scale, step: six rows."""
    return spark.createDataFrame(FAMILIES, "family string, min_default int, max_default int, scale double, step double")


def with_default_range(policies: DataFrame, known: DataFrame, family: str = "family") -> DataFrame:
    """policies with ``min_q`` and ``max_q`` of their family where they have none of their own, and the family's ``step``; a policy of no known family keeps its nulls.

    known: ``families``, six rows, which are broadcast.
    """
    defaults = F.broadcast(known.select(F.col("family").alias("_family"), "min_default", "max_default", F.col("step").alias("_step")))
    joined = policies.drop("step").join(defaults, F.col(family) == F.col("_family"), "left")
    whole = F.col("min_q").isNull() | F.col("max_q").isNull()  # a range is given as a whole
    filled = joined.withColumn("_min", F.when(whole, F.col("min_default")).otherwise(F.col("min_q"))).withColumn("_max", F.when(whole, F.col("max_default")).otherwise(F.col("max_q")))
    return filled.drop("min_q", "max_q", "_family", "min_default", "max_default").withColumnsRenamed({"_min": "min_q", "_max": "max_q", "_step": "step"})


def scale_position(setting: Column, scale: Column) -> Column:
    """Place of a setting, cut to a whole number, on its family's scale: 0 to 1."""
    return F.least(F.greatest(setting.cast("int") / scale, F.lit(0.0)), F.lit(1.0))


def oriented(metric: Column, score: Column) -> Column:
    """Scores for which more is better."""
    return F.when(metric.isin(*LOWER_IS_BETTER), -score).otherwise(score)


def oriented_band(metric: Column, low: Column, high: Column) -> Column:
    turned = metric.isin(*LOWER_IS_BETTER)
    return F.struct(F.when(turned, -high).otherwise(low).alias("low"), F.when(turned, -low).otherwise(high).alias("high"))


def within(score: Column, low: Column, high: Column) -> Column:
    """Both ends belong to the band."""
    return score.between(low, high)


def snapped(x: Column, step: Column, low: Column, high: Column) -> Column:
    """To the nearest step, halves away from zero, and into the limits."""
    return F.least(F.greatest(F.round(x / step) * step, low), high)


def setting_text(setting: Column) -> Column:
    """Without trailing zeros, two decimals at most."""
    return F.regexp_replace(F.format_string("%.2f", setting.cast("double")), r"\.?0+$", "")


def unit_name(index: Column, extension: str | None = None) -> Column:
    name = F.format_string("%05d", index.cast("long"))
    return F.concat(name, F.lit(f".{extension}")) if extension else name


def rate(text: Column) -> Column:
    """"n/d" as a number; null if it is none or d is 0."""
    n, d = F.split(text, "/")[0].try_cast("double"), F.get(F.split(text, "/"), F.lit(1)).try_cast("double")
    return F.try_divide(n, d)


def length_limit(count: Column, seconds: Column, per_second: Column) -> Column:
    """Elements a segment may have: an explicit count beats seconds; 0 sets no limit (null)."""
    return F.when(count.isNotNull(), F.nullif(count.cast("long"), F.lit(0))).otherwise(F.nullif(F.round(per_second * seconds).cast("long"), F.lit(0)))


def model_name(large: Column, negative: Column) -> Column:
    """The quality model that two choices name."""
    return F.concat(F.when(large, "vmaf_4k_v0.6.1").otherwise("vmaf_v0.6.1"), F.when(negative, "neg").otherwise(""))


def transfer_curve(tokens: Column, source: Column) -> Column:
    """From an option list: a token naming the PQ curve wins over one naming an SDR curve; else what the source says."""
    some = lambda test: F.exists(tokens, lambda t: test(F.lower(t)))
    pq = some(lambda t: (t == "pq") | t.rlike("(?:=pq|smpte2084)$"))
    sdr = some(lambda t: t.rlike(r"(?:bt\.?709|bt\.?601)$|smpte240|smpte170"))
    return F.when(pq, "smpte2084").when(sdr, "bt1886").otherwise(source)


def version(text: Column) -> Column:
    """major, minor, patch of the first v1.2.3 in a text; null without one."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"v(\d+)\.(\d+)\.(\d+)", i), F.lit("")).cast("int")
    return F.when(text.rlike(r"v\d+\.\d+\.\d+"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def listed_after(text: Column, marker: str) -> Column:
    """Words after a marker on its line."""
    rest = F.trim(F.regexp_extract(text, rf"(?m){marker}([^\n]*)", 1))
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, r"[,\s]+"))


def positions(text: Column) -> Column:
    """Comma-separated whole numbers: struct<good array<long>, bad array<string>>; an empty text is an empty list."""
    items = F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, ","), lambda x: F.trim(x)))
    number = lambda x: F.when(x.rlike(r"^\d+$"), x.try_cast("bigint"))
    good = F.filter(F.transform(items, number), lambda x: x.isNotNull())
    return F.struct(good.alias("good"), F.filter(items, lambda x: number(x).isNull()).alias("bad"))


def normalised_policies(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(policies, rejects with a reason) of a table of texts.

    raw: any columns and target, limits, probes, statistic, methods, resolution as strings. Accepted: a band ``a-b`` (a < b) or one value, which
    means that value within one percent (0 counts as 0.001); limits ``a-b`` (a < b); a number of probes from 1 on (a warning below 4); a statistic, with
    ``=value`` for percentile (0 to 100) and standard-deviation; two methods ``m3-m4``; ``WxH``. Null keeps a default (null).
    """
    c = F.col
    band = F.regexp_extract(c("target"), r"^([0-9.]+)-([0-9.]+)$", 1).try_cast("double"), F.regexp_extract(c("target"), r"^([0-9.]+)-([0-9.]+)$", 2).try_cast("double")
    one = F.when(c("target").try_cast("double") == 0, 0.001).otherwise(c("target").try_cast("double"))
    ranged = c("target").contains("-")
    low = F.when(ranged, band[0]).otherwise(one - one * 0.01)
    high = F.when(ranged, band[1]).otherwise(one + one * 0.01)
    limit = lambda i: F.regexp_extract(c("limits"), r"^(\d+)-(\d+)$", i).try_cast("int")
    stat, value = F.lower(F.split("statistic", "=")[0]), F.get(F.split("statistic", "="), F.lit(1)).try_cast("double")
    parts = F.size(F.split("statistic", "="))
    takes = stat.isin("percentile", "standard-deviation")
    stat_ok = (stat.isin(*STATISTICS) & (parts == 1)) | (takes & (parts == 2) & value.isNotNull() & ((stat != "percentile") | value.between(0, 100)))
    methods = F.split("methods", "-")
    size = lambda i: F.regexp_extract(c("resolution"), r"^(\d+)x(\d+)$", i).try_cast("int")
    reason = (
        F.when(c("target").isNotNull() & (low.isNull() | high.isNull()), "target is no number or range")
        .when(c("target").isNotNull() & ranged & (low >= high), "target: min must be below max")
        .when(c("limits").isNotNull() & limit(1).isNull(), "limits must be min-max")
        .when(c("limits").isNotNull() & (limit(1) >= limit(2)), "limits: min must be below max")
        .when(c("probes").isNotNull() & F.coalesce(c("probes").try_cast("int") < 1, F.lit(True)), "probes must be 1 or more")
        .when(c("statistic").isNotNull() & ~F.coalesce(stat_ok, F.lit(False)), "unknown statistic")
        .when(c("methods").isNotNull() & ~F.coalesce((F.size(methods) == 2) & methods[0].isin(*METHODS_3) & F.get(methods, F.lit(1)).isin(*METHODS_4), F.lit(False)), "unknown methods")
        .when(c("resolution").isNotNull() & size(1).isNull(), "resolution must be WxH")
    )
    checked = raw.withColumn("reject_reason", reason)
    good = checked.filter("reject_reason is null").drop("reject_reason")
    warning = F.when(c("probes").try_cast("int") < 4, "fewer than 4 probes")
    added = good.select(
        "*", low.alias("low"), high.alias("high"), limit(1).alias("min_q"), limit(2).alias("max_q"), c("probes").try_cast("int").alias("n_probes"), warning.alias("warning"),
        stat.alias("stat_name"), value.alias("stat_value"), methods[0].alias("method_3"), F.get(methods, F.lit(1)).alias("method_4"), size(1).alias("width"), size(2).alias("height"),
    )
    return added, checked.filter("reject_reason is not null")
