"""Streams over the events' files, run over what is there, with what a batch would give as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.staging import temporary
from cutline.streaming import streams, waiting

from .ledger_queries import _rendered
from .tables import EVENTS_SQL, table


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema  # the pattern below stands for one file or a folder of files
    return streams.stamped(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"))


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    folder = temporary(spark, f"{name}-{uuid.uuid4().hex}")
    return f"{folder}/out", f"{folder}/checkpoint"


def _by_halves(rows: DataFrame, name: str, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream writes over the rows of even ids, a first batch, and over the others, which come when it is started again, a second."""
    spark, places = rows.sparkSession, _folders(rows.sparkSession, name)
    folder, found = temporary(spark, f"{name}-in-{uuid.uuid4().hex}"), None
    for part in (0, 1):  # files as tasks leave them: one file a half would be one task's work
        rows.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(folder)
        found = streams.run_once(query(spark.readStream.schema(rows.schema).parquet(folder)), *places)
    return found


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    best = streams.progress(_rendered(_stream(spark, sf)), ["user_id"])
    return streams.run_once(best, *_folders(spark, "progress"), mode="update", latest_by=["user_id"])


def stream_projection(spark: SparkSession, sf: str) -> DataFrame:
    units = _stream(spark, sf).select("event_type", (F.col("event_id") % 10).alias("n_elements"), F.floor("value").cast("long").alias("size_bytes"))
    return streams.run_once(streams.projection(units, ["event_type"]), *_folders(spark, "projection"), mode="update", latest_by=["event_type"])


#: Microseconds that an element waits for earlier ones of its series.
LATE = 2 * 3600 * 1_000_000


def stream_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of each user's events, closed by those that two hours of the user's own time have passed."""
    found = streams.segments(_stream(spark, sf).select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id", "value", 60.0, 3, LATE)
    return streams.closed(streams.run_once(found, *_folders(spark, "segments")))


def stream_segments_map(spark: SparkSession, sf: str) -> DataFrame:
    """The same with waiting elements as entries of the state store."""
    found = waiting.segments(_stream(spark, sf).select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id", "value", 60.0, 3, LATE)
    before = waiting.use_rocksdb(spark)
    try:
        return streams.closed(streams.run_once(found, *_folders(spark, "segments-map")))
    finally:
        spark.conf.set(waiting.PROVIDER, before) if before else spark.conf.unset(waiting.PROVIDER)


def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """The events, those of even ids first and the others as a second batch: elements that came too late for their user's segments, as nothing waits."""
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    found = _by_halves(rows, "late", lambda stream: streams.segments(stream, "user_id", "ts", "event_id", "value", 60.0, 3))
    return streams.late_elements(found).select("user_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "value")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type in windows of six hours that the watermark, an hour behind, has passed."""
    counts = streams.windowed_counts(_stream(spark, sf), "ts", "6 hours", "1 hour", ["event_type"])
    return streams.run_once(counts, *_folders(spark, "windows")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type in windows of six hours that begin every two."""
    counts = streams.sliding_counts(_stream(spark, sf), "ts", "6 hours", "2 hours", "1 hour", ["event_type"])
    return streams.run_once(counts, *_folders(spark, "sliding")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user's events, eight hours apart."""
    found = streams.run_once(streams.sessions(_stream(spark, sf), "ts", "8 hours", "1 hour", ["user_id"]), *_folders(spark, "sessions"))
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("done"))


def stream_too_late(spark: SparkSession, sf: str) -> DataFrame:
    """Events of odd ids, which come as a second batch, that windows with a watermark an hour behind drop."""
    found = _by_halves(_events(spark, sf), "too-late", lambda stream: streams.later_than_watermark(stream.select("event_id", "ts"), "ts", "1 hour"))
    return found.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def stream_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Events as reports of a unit, errors as failures, in batches that don't keep the order: what is finished in the end, and the sum of all increments."""
    rows = _events(spark, sf).withColumn("failed", F.col("event_type") == "error")
    found = _by_halves(rows, "rollback", lambda stream: streams.net_progress(stream, "user_id", "event_id", "done", "failed"))
    return found.groupBy("user_id").agg(F.sum("increment").alias("net"))


QUERIES = {f.__name__: f for f in (stream_progress, stream_projection, stream_segments, stream_segments_map, stream_late, stream_windows, stream_sliding, stream_sessions, stream_too_late, stream_rollback)}

SQL = {
    "stream_progress": "SELECT user_id, max(CASE WHEN event_id % 6 IN (3, 4) AND event_id % 4 = 1 THEN NULL ELSE event_id % 1000 END) AS done FROM events GROUP BY user_id HAVING max(CASE WHEN event_id % 6 IN (3, 4) AND event_id % 4 = 1 THEN NULL ELSE event_id % 1000 END) IS NOT NULL",
    "stream_projection": "SELECT event_type, sum(event_id % 10)::BIGINT AS done_elements, sum(floor(value))::BIGINT AS done_bytes, count(*) AS done_units FROM events GROUP BY event_type",
    "stream_windows": "WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM w WHERE window_start + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)",
    "stream_sliding": "WITH w AS (SELECT time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') - to_hours(2 * k) AS window_start, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL) SELECT * FROM w WHERE window_start + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)",
    "stream_sessions": """WITH m AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '8 hours' AS new FROM events), s AS (SELECT user_id, ts, sum(coalesce(new, true)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '8 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL '8 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
    "stream_too_late": "SELECT event_id, ts FROM events WHERE event_id % 2 = 1 AND ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 hour' FROM events WHERE event_id % 2 = 0)",
    "stream_rollback": """WITH f AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'error') AS last, bool_or(floor(value) > 0 OR event_type = 'error') AS some FROM events GROUP BY user_id)
        SELECT f.user_id, greatest(coalesce(max(floor(value)::BIGINT) FILTER (WHERE event_type <> 'error' AND event_id > coalesce(last, -1)), 0), 0) AS net FROM events e JOIN f ON f.user_id = e.user_id GROUP BY f.user_id""",
    "stream_segments": f"""WITH RECURSIVE {EVENTS_SQL.replace("FROM events)", "FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) - INTERVAL '2 hours' AS passed FROM events) WHERE ts <= passed)")}, j AS (SELECT user_id, pos, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS d FROM e), k AS (SELECT user_id, pos FROM j WHERE d >= 60),
        r AS (SELECT DISTINCT user_id, 0::BIGINT AS last FROM e UNION ALL SELECT user_id, next FROM (SELECT r.user_id, min(k.pos) AS next FROM r JOIN k ON k.user_id = r.user_id AND k.pos >= r.last + 3 GROUP BY r.user_id, r.last)),
        s AS (SELECT user_id, last AS start, lead(last) OVER (PARTITION BY user_id ORDER BY last) AS "end" FROM r) SELECT * FROM s WHERE "end" IS NOT NULL""",
    "stream_late": "WITH m AS (SELECT user_id, max(ts) AS upto FROM events WHERE event_id % 2 = 0 GROUP BY user_id) SELECT e.user_id, e.ts, e.value FROM events e JOIN m ON m.user_id = e.user_id WHERE event_id % 2 = 1 AND e.ts < m.upto",
}
SQL["stream_segments_map"] = SQL["stream_segments"]
