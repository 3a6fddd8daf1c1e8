"""Writers: scores, logs, segments, queues, ledgers, progress texts. JSON documents carry their series_id and stand one to a line, so that any number of series shares a few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(found: DataFrame, split: DataFrame, path: str, key: str = "series_id", buckets: int = 64) -> None:
    """Segments before and after the splits for length, as Parquet by step and by a hash of the series; rows of a series stand together."""
    both = split.withColumn("step", F.lit("split")).unionByName(found.withColumn("step", F.lit("found")), allowMissingColumns=True)
    placed = both.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
    placed.repartition("step", "bucket").sortWithinPartitions("step", "bucket", key, "start").write.partitionBy("step", "bucket").parquet(path)


def _document(key: str, *fields: Column) -> Column:
    return F.to_json(F.struct(F.col(key).cast("string").alias("series_id"), *fields)).alias("document")


def _listed(df: DataFrame, key: str, order: str, entry: Column, name: str) -> DataFrame:
    """One array of entries for each series, in order."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, entry.alias("e")))), lambda x: x["e"]).alias(name))


def scores_json(elements: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, document) of elements (key, pos, score), as the reader takes it."""
    entry = F.struct(F.struct(F.col("score").alias("vmaf")).alias("metrics"))
    return _listed(elements, key, "pos", entry, "frames").select(key, _document(key, F.col("frames")))


def segments_json(found: DataFrame, split: DataFrame, info: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, document): one JSON document for each series with both lists, as the reader takes it."""
    entry = F.struct(F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))
    joined = info.join(_listed(found, key, "start", entry, "scenes"), key).join(_listed(split, key, "start", entry, "split_scenes"), key)
    return joined.select(key, _document(key, F.col("n_elements").alias("frames"), F.col("scenes"), F.col("split_scenes")))


def documents(df: DataFrame, path: str) -> None:
    """A column ``document`` as text, one to a line."""
    df.select("document").write.text(path)


def channel_log(elements: DataFrame, path: str, key: str = "series_id") -> None:
    """Logs of elements (key, pos, y, u, v): a folder for each series, a line for each element in order, and at the end the averages, with the least of them.

    A long series stands in several files, in order of their names, as it is dealt out by ranges of positions.
    """
    shown = lambda c: F.when(c == float("inf"), "inf").otherwise(F.format_string("%.4f", c))
    parts = lambda names, gap: F.concat_ws(gap, *(F.concat(F.lit(f"{n}: "), shown(F.col(n))) for n in names))
    line = F.concat(F.format_string("n: %4d  ", F.col("pos") + 1), F.concat_ws("  ", *(F.concat(F.lit(f"XPSNR {n}: "), shown(F.col(n))) for n in "yuv")))
    means = elements.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in "yuv"))
    last = F.concat(F.format_string("XPSNR average, %d frames  ", "n"), parts("yuv", "  "), F.lit("  (minimum: "), shown(F.least("y", "u", "v")), F.lit(")"))
    rows = elements.select(F.col(key).alias("series_id"), F.lit(False).alias("ends"), F.col("pos").cast("long").alias("pos"), line.alias("value"))
    rows = rows.unionByName(means.select(F.col(key).alias("series_id"), F.lit(True).alias("ends"), F.col("n").alias("pos"), last.alias("value")))
    order = ["series_id", "ends", "pos"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("series_id", "value").write.partitionBy("series_id").text(path)


def progress_lines(lines: DataFrame, path: str) -> None:
    """Lines (series_id, line) as progress texts, each ended by a carriage return: a folder for each series."""
    lines.select("series_id", F.col("line").alias("value")).write.partitionBy("series_id").option("lineSep", "\r").text(path)


def queue(units: DataFrame, path: str) -> None:
    """Units of work, to be read by ``readers.queue``."""
    units.write.parquet(path)


def append_ledger(units: DataFrame, path: str) -> None:
    """Finished units are added; ``latest`` tells which report of a unit counts."""
    units.write.mode("append").parquet(path)


def latest(ledger: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last report of each unit."""
    others = [c for c in ledger.columns if c not in (*keys, at)]
    row = F.max_by(F.struct(*others), F.struct(at, *others)).alias("_r")
    return ledger.groupBy(*keys).agg(row, F.max(at).alias(at)).select(*keys, at, "_r.*")


def ledger_json(units: DataFrame, total: int, key: str = "series_id") -> DataFrame:
    """(key, document) in the form that the ledger reader takes."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("unit").alias("key"), F.struct(F.col("n_elements").alias("frames"), "size_bytes").alias("value")))))
    return units.groupBy(key).agg(entries.alias("done")).select(key, _document(key, F.lit(total).alias("frames"), F.col("done"), F.lit(False).alias("audio_done")))
