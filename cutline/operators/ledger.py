"""The books around the work: progress, the ledger of finished units, resuming, projections, order and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import long


def increments(progress: DataFrame, keys: Sequence[str], order: Sequence[str], done: str = "done", split: long.Cells | None = None) -> DataFrame:
    """progress with ``increment``: by how much a report exceeds the best one before it; reports never take back."""
    best = long.running(progress, keys, order, {"_best": ("max_before", F.col(done))}, split)
    return best.withColumn("increment", F.greatest(F.coalesce(F.col(done), F.lit(0)) - F.coalesce("_best", F.lit(0)), F.lit(0))).drop("_best")


def net_progress(progress: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, done: str = "done") -> DataFrame:
    """progress with ``net``: elements finished so far over a unit's attempts. A failure takes back what its attempt had reported, and the next attempt counts from nothing; never below 0.

    failed: does this row report the failure of the attempt it stands in? Its own count is not read.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tried = progress.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_attempt", F.coalesce(F.sum(F.col("_failed").cast("long")).over(before), F.lit(0)))
    own = Window.partitionBy(*keys, "_attempt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    best = F.coalesce(F.max(F.when(~F.col("_failed"), F.col(done))).over(own), F.lit(0))
    return tried.withColumn("net", F.greatest(F.when(F.col("_failed"), F.lit(0)).otherwise(best), F.lit(0))).drop("_failed", "_attempt")


def totals(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """done_elements, done_bytes, done_units of each series."""
    return ledger.groupBy(*keys).agg(F.sum("n_elements").alias("done_elements"), F.sum("size_bytes").alias("done_bytes"), F.count(F.lit(1)).alias("done_units"))


def projection(done: DataFrame, rate: Column, total: Column, side_bytes: Column) -> DataFrame:
    """done with kbps, progress and estimated bytes of the whole; nothing where nothing is done."""
    some, seconds, share = F.col("done_elements") > 0, F.try_divide(F.col("done_elements"), rate), F.try_divide(F.col("done_elements"), total)
    return done.select(
        "*",
        F.when(some, F.try_divide(F.col("done_bytes") * 8 / 1000, seconds)).alias("kbps"),
        F.when(some, share).alias("progress"),
        F.when(some, F.try_divide(F.col("done_bytes"), share) + side_bytes).alias("estimated_bytes"),
    )


def speed(position: Column, resumed: Column, elapsed: Column, total: Column) -> Column:
    """struct<rate, text, eta>: elements a second since the resume, as shown (seconds an element below 1), and seconds left."""
    since = F.when(position < resumed, resumed).otherwise(position - resumed)
    known = (since > 0) & (elapsed > 0)
    rate = F.when(known, since / F.nullif(elapsed, F.lit(0)))
    text = F.when(rate.isNull(), "0 /s").when(rate < 1, F.format_string("%.2f s each", 1 / F.nullif(rate, F.lit(0.0)))).otherwise(F.format_string("%.2f /s", rate))
    return F.struct(F.coalesce(rate, F.lit(0.0)).alias("rate"), text.alias("text"), F.when(known, elapsed / F.nullif(since, F.lit(0)) * (total - position)).alias("eta"))


def unit_rate(n_elements: Column, began: Column, ended: Column) -> Column:
    """Elements a second of one unit; null for no time at all."""
    return F.try_divide(n_elements.cast("double"), ended.cast("double") - began.cast("double"))


def remaining(units: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units that are not in the ledger."""
    return units.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def resume_mode(series: DataFrame, queues: DataFrame, ledgers: DataFrame, key: str) -> DataFrame:
    """series with ``mode``: resume where both a saved queue and a ledger exist, else start over."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    joined = series.join(flag(queues, "_q"), key, "left").join(flag(ledgers, "_l"), key, "left")
    return joined.withColumn("mode", F.when(F.col("_q") & F.col("_l"), "resume").otherwise("start")).drop("_q", "_l")


def reconciled(expected: DataFrame, actual: DataFrame, keys: Sequence[str], ignore: bool = False) -> DataFrame:
    """Units whose expected and actual counts differ, or that stand on one side only. ignore keeps them out of the errors, flagged."""
    both = expected.select(*keys, F.col("n").alias("expected")).join(actual.select(*keys, F.col("n").alias("actual")), list(keys), "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn("error", F.lit(not ignore))


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series of which the two tables hold different numbers of elements."""
    count = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return reconciled(count(a), count(b), keys)


def attempts(tries: DataFrame, keys: Sequence[str], ok: Column, most: int) -> DataFrame:
    """Attempts of each unit, whether one succeeded, and whether it is given up."""
    out = tries.groupBy(*keys).agg(F.count(F.lit(1)).alias("tries"), F.max(ok.cast("int")).alias("_ok"), F.sum((~ok).cast("long")).alias("failures"))
    return out.withColumn("succeeded", F.col("_ok") == 1).withColumn("gave_up", ~F.col("succeeded") & (F.col("failures") >= most)).drop("_ok")


def work_order(units: DataFrame, length: Column, index: str, how: str = "long-to-short", seed: int = 0) -> list[Column]:
    """Sort columns: long-to-short, short-to-long, sequential, or random, which is the same for the same seed."""
    i = F.col(index)
    return {"long-to-short": [length.desc(), i.asc()], "short-to-long": [length.asc(), i.asc()], "sequential": [i.asc()], "random": [F.md5(F.concat(F.lit(f"{seed}:"), i.cast("string"))).asc(), i.asc()]}[how]


def stem_number(name: Column) -> Column:
    """The number before a file's extension."""
    return F.nullif(F.regexp_extract(name, r"(\d+)\.", 1), F.lit("")).try_cast("int")


def merge_groups(units: DataFrame, keys: Sequence[str], index: str, name: str, size: int = 100) -> DataFrame:
    """One row for each group of size units in order: group number, output name, member names in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1
    grouped = units.withColumn("_g", F.floor(place / size).cast("long"))
    out = grouped.groupBy(*keys, "_g").agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(name).alias("n")))).alias("_m"))
    return out.select(*keys, F.col("_g").alias("group_no"), F.format_string("group_output_%05d", F.col("_g")).alias("group_name"), F.transform("_m", lambda m: m["n"]).alias("members"))


def file_list(names: Column) -> Column:
    """A list of files for a concatenating tool, one to a line, with backslashes, blanks and quotes escaped."""
    escape = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), " ", r"\\ "), "'", r"\\'")
    return F.concat(F.array_join(F.transform(F.array_sort(names), lambda x: F.concat(F.lit("file "), escape(x))), "\n"), F.lit("\n"))


def merge_options(names: Column, output: Column, side: Column | None = None, rate: Column | None = None) -> Column:
    """The JSON list of options that a merging tool reads: output, side track if any, rate "n/d" if any, members in brackets."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    head = F.concat(F.lit('["-o", '), quoted(output))
    if side is not None:
        head = F.concat(head, F.when(side.isNotNull(), F.concat(F.lit(", "), quoted(F.coalesce(side, F.lit(""))))).otherwise(""))
    if rate is not None:
        head = F.concat(head, F.when(rate.isNotNull(), F.concat(F.lit(', "--default-duration", "0:'), F.coalesce(rate, F.lit("")), F.lit('fps"'))).otherwise(""))
    return F.concat(head, F.lit(', "["'), F.array_join(F.transform(names, lambda x: F.concat(F.lit(', "'), x, F.lit('"'))), ""), F.lit(',"]"]'))
