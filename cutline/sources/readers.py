"""Readers of the files around a series: score files, logs, probe results, segments, overrides, ledgers. Explicit schemas, no inference.

The series of a file is its name without extension; of a file in a folder ``series_id=...`` it is that folder's. JSON documents stand one to a file, or, with ``lines``, one to a line with
their ``series_id`` inside, which is the form for very many series. Bad rows go to a table of rejects with a reason, instead of ending the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = "frames array<struct<metrics:struct<vmaf:double>>>"
PROBE = "streams array<struct<width:int,height:int,pix_fmt:string,color_transfer:string,avg_frame_rate:string,nb_frames:string>>"
KEYS = "frames array<struct<key_frame:int>>"
LEDGER = "frames bigint, done map<string,struct<frames:bigint,size_bytes:bigint>>, audio_done boolean"
_SCENE = "struct<start_frame:bigint,end_frame:bigint,zone_overrides:struct<extra_splits_len:bigint,min_scene_len:bigint>>"
SEGMENTS = f"frames bigint, scenes array<{_SCENE}>, split_scenes array<{_SCENE}>"
QUEUE = "series_id string, unit_idx int, start bigint, end bigint, rate double, passes int, params array<string>, setting double"

_INFINITE_OR = r"([0-9\.]+|inf)"
#: An element's line, and the line of averages, of a channel log.
ELEMENT_LINE = rf"XPSNR y: *{_INFINITE_OR} *XPSNR u: *{_INFINITE_OR} *XPSNR v: *{_INFINITE_OR}"
AVERAGE_LINE = rf"XPSNR average, \d+ frames  y: *{_INFINITE_OR}  u: *{_INFINITE_OR}  v: *{_INFINITE_OR}  \(minimum: *{_INFINITE_OR}\)"


def _series() -> Column:
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/series_id=([^/]*)/[^/]*$", 1))
    return F.when(folder != "", folder).otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """series_id and the fields of JSON documents, one to a file or to a line."""
    fields = [f.name for f in T.StructType.fromDDL(schema)]
    if lines:
        return spark.read.schema(f"series_id string, {schema}").json(path)
    return spark.read.schema(schema).option("multiLine", True).json(path).select(_series().alias("series_id"), *fields)


def element_scores(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(series_id, pos, score) of JSON score files; order is the array's."""
    rows = _json(spark, path, SCORES, lines).select("series_id", F.posexplode("frames").alias("pos", "f"))
    return rows.select("series_id", F.col("pos").cast("bigint").alias("pos"), F.col("f.metrics.vmaf").alias("score"))


def zipped_channels(y: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """Three channels' element scores by position, weighted 4 to 1 to 1; the shortest channel ends a series."""
    named = lambda df, n: df.select("series_id", "pos", F.col("score").alias(n))
    joined = named(y, "y").join(named(u, "u"), ["series_id", "pos"]).join(named(v, "v"), ["series_id", "pos"])
    return joined.select("series_id", "pos", ((4.0 * F.col("y") + F.col("u") + F.col("v")) / 6.0).alias("score"))


def number_or_infinite(text: Column) -> Column:
    """inf, and what is no number, counts as infinite."""
    return F.coalesce(F.when(text == "inf", F.lit(float("inf"))).otherwise(text.try_cast("double")), F.lit(float("inf")))


def channels(line: Column, pattern: str = ELEMENT_LINE) -> Column:
    """struct<y, u, v> of a log line; null if it is none."""
    part = lambda i: number_or_infinite(F.regexp_extract(line, pattern, i))
    return F.when(line.rlike(pattern), F.struct(part(1).alias("y"), part(2).alias("u"), part(3).alias("v")))


def channel_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, averages, rejects) of text logs; a log without its line of averages is rejected.

    Files are read line by line and may be split, and a series may have several files: the file, a split's start in it and the order within it place a line. Nothing is sorted: a split's elements have
    consecutive numbers, and a small table of the splits tells how many elements of their series come before.
    """
    piece = ["series_id", "file", "block"]
    texts = spark.read.text(path).select(_series().alias("series_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = texts.select("series_id", F.struct("file", "block", F.monotonically_increasing_id().alias("line")).alias("at"), "line")
    numbered = texts.filter(F.col("line").rlike(ELEMENT_LINE)).withColumn("_id", F.monotonically_increasing_id())
    splits = numbered.groupBy(*piece).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    past = Window.partitionBy("series_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*piece, (F.coalesce(F.sum("_n").over(past), F.lit(0)) - F.col("_first")).alias("_add"))
    elements = numbered.join(F.broadcast(splits), piece).withColumn("pos", F.col("_id") + F.col("_add"))
    averages = lines.filter(F.col("line").contains("XPSNR average")).groupBy("series_id").agg(F.min_by("line", "at").alias("line"))
    found = averages.withColumn("c", channels(F.col("line"), AVERAGE_LINE)).filter("c is not null").select("series_id", "c.*")
    rejects = lines.select("series_id").distinct().join(found, "series_id", "left_anti").withColumn("reject_reason", F.lit("no line of averages"))
    return elements.select("series_id", F.col("pos").cast("bigint").alias("pos"), channels(F.col("line")).alias("c")).select("series_id", "pos", "c.*"), found, rejects


def series_info(probe: Column, counted: Column) -> Column:
    """struct of a probe result in JSON: size, format, rate as two whole numbers, transfer, and the number of elements, or counted where the probe has none."""
    s = F.get(F.from_json(probe, PROBE)["streams"], F.lit(0))
    part = lambda i: F.get(F.split(s["avg_frame_rate"], "/"), F.lit(i)).try_cast("bigint")
    return F.struct(
        F.coalesce(s["nb_frames"].try_cast("bigint"), counted).alias("n_elements"), part(0).alias("rate_num"), part(1).alias("rate_den"), s["width"].alias("width"), s["height"].alias("height"),
        s["pix_fmt"].alias("fmt"), F.when(s["color_transfer"] == "smpte2084", "smpte2084").otherwise("bt1886").alias("transfer"),
    )


def key_positions(text: Column) -> Column:
    """Positions flagged as keys in a JSON list of elements."""
    flags = F.from_json(text, KEYS)["frames"]
    return F.filter(F.transform(flags, lambda f, i: F.when(f["key_frame"] > 0, i.cast("bigint"))), lambda i: i.isNotNull())


def constant(series: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(series that keep their size and rate and have elements, rejects). series: keys, width, height, rate_num, rate_den for each element."""
    counts = series.groupBy(*keys).agg(F.count("width").alias("n"), F.count_distinct("width", "height").alias("sizes"), F.count_distinct("rate_num", "rate_den").alias("rates"))
    reason = F.when(F.col("n") == 0, "no elements").when(F.col("sizes") > 1, "size changes").when(F.col("rates") > 1, "rate changes")
    marked = counts.withColumn("reject_reason", reason)
    return marked.filter("reject_reason is null").select(*keys, "n"), marked.filter("reject_reason is not null").select(*keys, "reject_reason")


KINDS = ("aom", "rav1e", "x264", "x265", "vpx", "svt-av1")


def override_line(line: Column, n_elements: Column) -> Column:
    """struct of an override line ``start end kind [reset] [options]``; end -1 is the end of the series; null fields where it can't be read.

    options: map from option name to its value, which follows after a blank or an equals sign.
    """
    pattern = rf"^(\d+) +(-1|\d+) +({'|'.join(KINDS)})( +reset)?(?: +(.*))?$"
    part = lambda i: F.regexp_extract(F.trim(line), pattern, i)
    end = F.when(part(2) == "-1", n_elements).otherwise(part(2).try_cast("bigint"))
    pairs = F.regexp_extract_all(part(5), F.lit(r"--?[^= ]+(?:[ =][^- ][^ ]*|[ =]-\d[^ ]*)?"), F.lit(0))
    entry = lambda x: F.struct(F.regexp_extract(x, "^(--?[^= ]+)", 1).alias("key"), F.nullif(F.regexp_extract(x, "^--?[^= ]+[ =](.*)$", 1), F.lit("")).alias("value"))
    unique = F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, x: F.concat(F.filter(acc, lambda e: e["key"] != entry(x)["key"]), F.array(entry(x)))))
    ok = F.trim(line).rlike(pattern)
    return F.struct(
        F.when(ok, part(1).try_cast("bigint")).alias("start"), F.when(ok, end).alias("end"), F.when(ok, part(3)).alias("kind"), F.when(ok, part(4) != "").alias("reset"), F.when(ok, unique).alias("options"),
    )


def overrides(lines: DataFrame, n_elements: Column, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a table of override lines; blank lines are skipped."""
    read = lines.filter(F.trim(F.col(line)) != "").withColumn("_o", override_line(F.col(line), n_elements))
    good = read.filter("_o.kind is not null").select("*", "_o.*").drop("_o")
    return good, read.filter("_o.kind is null").drop("_o").withColumn("reject_reason", F.lit("invalid syntax"))


def segments(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(series_id, seg_idx, start, end, max_len, min_len) of segment files; an old file's only list counts as the split one."""
    rows = _json(spark, path, SEGMENTS, lines).select("series_id", F.posexplode(F.coalesce("split_scenes", "scenes")).alias("seg_idx", "s"))
    return rows.select("series_id", "seg_idx", F.col("s.start_frame").alias("start"), F.col("s.end_frame").alias("end"), F.col("s.zone_overrides.extra_splits_len").alias("max_len"), F.col("s.zone_overrides.min_scene_len").alias("min_len"))


def queue(spark: SparkSession, path: str) -> DataFrame:
    """A saved queue of work units."""
    return spark.read.schema(QUEUE).parquet(path)


def ledger(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(units, totals) of ledger files; a stored total of 0 is computed anew."""
    files = _json(spark, path, LEDGER, lines)
    units = files.select("series_id", F.explode("done").alias("unit", "d")).select("series_id", "unit", F.col("d.frames").alias("n_elements"), F.col("d.size_bytes").alias("size_bytes"))
    summed = F.aggregate(F.map_values("done"), F.lit(0).cast("bigint"), lambda s, d: s + d["frames"])
    return units, files.select("series_id", F.when(F.coalesce("frames", F.lit(0)) == 0, summed).otherwise(F.col("frames")).alias("total"), "audio_done")


def progress_lines(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, line) of progress texts, whose lines end with a carriage return."""
    return spark.read.option("lineSep", "\r").text(path).select(_series().alias("series_id"), F.col("value").alias("line"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, length) of a folder's own files, not of folders in it, or of the one file named. Contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    depth = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().count("/") + 1
    below = F.regexp_count(F.regexp_replace("path", r"^[A-Za-z0-9+.-]+:(?://[^/]*)?", ""), F.lit("/"))
    listed = listed.filter(below <= depth)  # folders named like partitions would be read too
    return listed.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def paired(first: DataFrame, second: DataFrame, order: str) -> DataFrame:
    """The i-th of one list with the i-th of another; where the other is shorter, with its first. Lists of inputs: one row an input."""
    numbered = lambda df, n: df.select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(order).alias(n))
    b = numbered(second, "second")
    head = F.broadcast(b.filter("i = 1").select(F.col("second").alias("_head")))
    return numbered(first, "first").join(b, "i", "left").join(head, F.lit(True), "left").select("i", "first", F.coalesce("second", "_head").alias("second"))
