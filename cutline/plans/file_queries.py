"""Files around a series, written from the given tables in the shared folder and read again by our readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions import settings
from cutline.functions.progress import finished
from cutline.operators import segments
from cutline.sources import growing, readers, writers
from cutline.staging import temporary
from cutline.streaming import streams

from .ledger_queries import _rendered
from .segment_queries import _SEGMENTS, USER, _info, _segments
from .tables import EVENTS_SQL, LINES_SQL, events, lines, table


def _folder(spark: SparkSession, name: str) -> str:
    return temporary(spark, f"{name}-{uuid.uuid4().hex}")


def scores_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities as element scores by part, in JSON."""
    folder = _folder(spark, "scores")
    elements = lines(spark, sf).select(F.col("l_partkey").cast("string").alias("series_id"), "pos", F.col("l_quantity").alias("score"))
    writers.documents(writers.scores_json(elements), folder)
    return readers.element_scores(spark, folder, lines=True)


def channel_log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as elements of three channels by return flag and status: the averages as the logs print them (four decimals), and each series' number of elements and of infinite ones as the logs have them."""
    folder = _folder(spark, "log")
    series = F.concat_ws(" & ", "l_returnflag", "l_linestatus")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    endless = F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.col("l_discount") * 100)
    rows = table(spark, sf, "lineitem").select(series.alias("series_id"), order.alias("pos"), F.col("l_quantity").alias("y"), endless.alias("u"), (F.col("l_tax") * 1000).alias("v"))
    placed = rows.withColumn("pos", F.xxhash64("pos"))  # lines need an order, which need not be numbered from 0
    writers.channel_log(placed, folder)
    elements, averages, rejects = readers.channel_log(spark, folder)
    counts = elements.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("u") == float("inf")).cast("long")).alias("endless"), F.round(F.sum("y"), 4).alias("sum_y"), F.max("pos").alias("last_pos"))
    return counts.join(averages.select("series_id", F.col("y").alias("mean_y"), F.col("v").alias("mean_v")), "series_id").join(rejects.select("series_id"), "series_id", "left_anti")


def key_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as key elements, in a JSON list of each user's elements."""
    flag = F.struct(F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("key_frame"))
    listed = events(spark, sf).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", flag.alias("f")))), lambda x: x["f"]).alias("frames"))
    texts = listed.select("user_id", F.to_json(F.struct("frames")).alias("document"))
    return texts.select("user_id", F.explode(readers.key_positions(F.col("document"))).alias("pos"))


def segments_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Segments before and after even splits: both lists in JSON, whose reader takes the split ones, and both as a table by step and bucket."""
    folder, tables = _folder(spark, "segments"), _folder(spark, "segment-table")
    e = events(spark, sf)
    found = _segments(e)
    split = segments.even_splits(found, USER, F.lit(3)).select("user_id", "seg_idx", "start", "end")
    writers.documents(writers.segments_json(found, split, _info(e), "user_id"), folder)
    writers.segments(found, split, tables, "user_id")
    stored = spark.read.parquet(tables).groupBy("user_id").agg(F.count(F.when(F.col("step") == "found", 1)).alias("found"), F.count(F.when(F.col("step") == "split", 1)).alias("split"))
    read = readers.segments(spark, folder, lines=True).select(F.col("series_id").cast("long").alias("user_id"), "seg_idx", "start", "end")
    return read.join(stored, "user_id")


def queue_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Even splits as a queue of units with parameters, saved and read; its longest unit and number of units by user."""
    folder = _folder(spark, "queue")
    units = segments.even_splits(_segments(events(spark, sf)), USER, F.lit(3))
    queued = units.select(
        F.col("user_id").cast("string").alias("series_id"), F.col("seg_idx").cast("int").alias("unit_idx"), "start", "end", F.lit(24.0).alias("rate"), F.lit(1).alias("passes"),
        F.array(F.lit("--speed"), (F.col("seg_idx") % 4).cast("string")).alias("params"), F.when(F.col("seg_idx") % 2 == 0, F.lit(30.25)).alias("setting"),
    )
    writers.queue(queued, folder)
    back = readers.queue(spark, folder)
    return back.groupBy("series_id").agg(F.count(F.lit(1)).alias("units"), F.max(F.col("end") - F.col("start")).alias("longest"), F.count("setting").alias("set"), F.max(F.element_at("params", 2)).alias("fastest"))


def ledger_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as finished units by customer, reported twice: the last report of each is kept, written as JSON and read, with totals that are computed anew."""
    log, folder = _folder(spark, "ledger-log"), _folder(spark, "ledger")
    unit = lambda at, size: table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("series_id"), F.format_string("%09d", "o_orderkey").alias("unit"), F.lit(at).alias("at"), (F.col("o_orderkey") % 9 + 1).alias("n_elements"), size.cast("long").alias("size_bytes"))
    writers.append_ledger(unit(1, F.lit(7)), log)
    writers.append_ledger(unit(2, F.floor("o_totalprice")), log)
    kept = writers.latest(spark.read.parquet(log), ["series_id", "unit"], "at")
    writers.documents(writers.ledger_json(kept, 0), folder)
    units, totals = readers.ledger(spark, folder, lines=True)
    done = units.groupBy("series_id").agg(F.count(F.lit(1)).alias("units"), F.sum("size_bytes").alias("bytes"), F.min("unit").alias("first_unit"))
    return done.join(totals, "series_id")


def progress_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Progress texts of the six kinds, a folder each, lines ended by carriage returns: lines read, lines that report a count, and their sum."""
    folder = _folder(spark, "progress-text")
    writers.progress_lines(_rendered(table(spark, sf, "events")).select(F.col("kind").alias("series_id"), "line"), folder)
    read = readers.progress_lines(spark, folder).withColumn("done", finished(F.col("series_id"), F.col("line")))
    return read.groupBy("series_id").agg(F.count(F.lit(1)).alias("lines"), F.count("done").alias("reports"), F.sum("done").alias("done"))


def _growing(spark: SparkSession, sf: str) -> str:
    """Progress texts of the six kinds, as a worker would leave them."""
    growing.register(spark)
    folder = _folder(spark, "growing")
    writers.progress_lines(_rendered(table(spark, sf, "events")).select(F.col("kind").alias("series_id"), "line"), folder)
    return folder


def _counted_lines(read: DataFrame) -> DataFrame:
    series = F.regexp_extract("file", "series_id=([^/]+)", 1)
    done = read.select(series.alias("series_id"), finished(series, F.col("line")).alias("done"))
    return done.groupBy("series_id").agg(F.count(F.lit(1)).alias("lines"), F.count("done").alias("reports"), F.sum("done").alias("done"))


def growing_log_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of ``progress_roundtrip`` read at once by ranges of bytes."""
    read = spark.read.format(growing.NAME).option("lineSep", "\r").option("rangeBytes", 1 << 14).load(_growing(spark, sf))
    return _counted_lines(read)


def growing_log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream."""
    read = spark.readStream.format(growing.NAME).option("lineSep", "\r").option("rangeBytes", 1 << 14).load(_growing(spark, sf))
    folder = _folder(spark, "growing-read")
    return _counted_lines(streams.run_once(read, f"{folder}/out", f"{folder}/checkpoint"))


def files_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names written by brand, a folder for each: the files of these folders, not of folders in them, and their bytes."""
    folder = _folder(spark, "listed")
    names = table(spark, sf, "part").select(F.col("p_brand").alias("series_id"), F.col("p_name").alias("value"))
    names.repartition("series_id").write.partitionBy("series_id").text(folder)
    top = readers.files(spark, folder).count()  # the folder itself holds folders only
    found = readers.files(spark, f"{folder}/*")
    brand = F.url_decode(F.regexp_extract("path", r"/series_id=([^/]*)/", 1))
    return found.groupBy(brand.alias("p_brand")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).withColumn("top", F.lit(top))


def listed_after(spark: SparkSession, sf: str) -> DataFrame:
    """Words after a marker on its line of a text made of each part; every third has nothing there, every fifth no such line."""
    k = F.col("p_partkey")
    rest = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" x"), F.col("p_size").cast("string")))
    text = F.concat(F.lit("tool v1.2.3\n"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("features:"), rest, F.lit("\n"))), F.lit("other: none\n"))
    words = settings.listed_after(text, "features:")
    return table(spark, sf, "part").select("p_partkey", F.size(words).alias("n"), F.concat_ws("|", words).alias("words"))


QUERIES = {
    f.__name__: f
    for f in (scores_roundtrip, channel_log_roundtrip, key_positions, segments_roundtrip, queue_roundtrip, ledger_roundtrip, progress_roundtrip, growing_log_batch, growing_log_stream, files_listed, listed_after)
}

_SPLITS = f"""WITH {EVENTS_SQL}, i AS (SELECT user_id, count(*) AS n_elements FROM e GROUP BY user_id), {_SEGMENTS}, k AS (SELECT *, "end" - start AS n, CASE WHEN "end" - start > 3 THEN ("end" - start) // 3 + 1 ELSE 1 END AS k FROM s),
        x AS (SELECT *, unnest(range(1, k + 1)) AS j FROM k),
        y AS (SELECT user_id, (start + floor(n * ((j - 1)::DOUBLE / k)))::BIGINT AS start, CASE WHEN j = k THEN "end" ELSE (start + floor(n * (j::DOUBLE / k)))::BIGINT END AS "end" FROM x),
        z AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS seg_idx, start, "end" FROM y)"""

SQL = {
    "scores_roundtrip": f"WITH {LINES_SQL} SELECT l_partkey::VARCHAR AS series_id, pos, l_quantity AS score FROM l",
    "channel_log_roundtrip": """SELECT l_returnflag || ' & ' || l_linestatus AS series_id, count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS endless, round(sum(l_quantity), 4) AS sum_y, count(*) - 1 AS last_pos,
        round(avg(l_quantity), 4) AS mean_y, round(avg(l_tax * 1000), 4) AS mean_v FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "key_positions": f"WITH {EVENTS_SQL} SELECT user_id, pos FROM e WHERE event_type = 'purchase'",
    "segments_roundtrip": f"""{_SPLITS}, fs AS (SELECT user_id, count(*) AS found FROM s GROUP BY user_id), zs AS (SELECT user_id, count(*) AS split FROM z GROUP BY user_id)
        SELECT z.user_id, seg_idx, start, "end", found, split FROM z JOIN fs ON fs.user_id = z.user_id JOIN zs ON zs.user_id = z.user_id""",
    "queue_roundtrip": f"""{_SPLITS} SELECT user_id::VARCHAR AS series_id, count(*) AS units, max("end" - start) AS longest, count(*) FILTER (WHERE seg_idx % 2 = 0) AS "set", max((seg_idx % 4)::VARCHAR) AS fastest FROM z GROUP BY user_id""",
    "ledger_roundtrip": """SELECT 'c' || o_custkey AS series_id, count(*) AS units, sum(floor(o_totalprice))::BIGINT AS bytes, printf('%09d', min(o_orderkey)) AS first_unit, sum(o_orderkey % 9 + 1)::BIGINT AS total, false AS audio_done FROM orders GROUP BY o_custkey""",
    **dict.fromkeys(("progress_roundtrip", "growing_log_batch", "growing_log_stream"), """WITH k AS (SELECT event_id, ['aom', 'rav1e', 'svt-av1', 'x264', 'x265', 'vpx'][(event_id % 6 + 1)::INT] AS kind, CASE WHEN event_id % 6 IN (3, 4) AND event_id % 4 = 1 THEN NULL ELSE event_id % 1000 END AS done FROM events)
        SELECT kind AS series_id, count(*) AS lines, count(done) AS reports, sum(done)::BIGINT AS done FROM k GROUP BY kind"""),
    "files_listed": "SELECT p_brand, 1 AS files, sum(length(p_name) + 1)::BIGINT AS bytes, 0 AS top FROM part GROUP BY p_brand",
    "listed_after": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 0 ELSE len(string_split(p_name, ' ')) + 1 END AS n,
        CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN '' ELSE replace(p_name, ' ', '|') || '|x' || p_size END AS words FROM part""",
}
