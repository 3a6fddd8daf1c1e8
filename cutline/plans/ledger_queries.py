"""Progress, ledger, order and manifests over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutline.functions import settings
from cutline.functions.progress import finished
from cutline.operators import ledger

from .tables import EVENTS_SQL, VECTORS_SQL, events, table, vectors


def _rendered(e: DataFrame) -> DataFrame:
    """Events as progress lines of the six kinds; the finished count is made from position and id."""
    n = F.col("event_id") % 1000
    kind = F.element_at(F.array(*map(F.lit, ("aom", "rav1e", "svt-av1", "x264", "x265", "vpx"))), (F.col("event_id") % 6 + 1).cast("int"))
    text = n.cast("string")
    line = (
        F.when(kind.isin("aom", "vpx"), F.concat(F.lit("Pass 1/2 frame   12/"), text, F.lit("      48213B   31744 us 61.75 fps")))
        .when(kind == "rav1e", F.concat(F.lit("encoded "), text, F.lit(" frames, 73.905 fps, 240.11 Kb/s")))
        .when(kind == "svt-av1", F.concat(F.lit("\x1b[33mEncoding:  "), text, F.lit("/1200 Frames\x1b[0m @ 37.02 fps")))
        .when(F.col("event_id") % 4 == 0, F.concat(F.lit("[87.1%] "), text, F.lit("/640 frames, 18.30 fps")))
        .when(F.col("event_id") % 4 == 1, F.lit("x265 [info]: no lookahead"))
        .otherwise(F.concat(text, F.lit(" frames: 55.60 fps")))
    )
    return e.select("event_id", "user_id", "ts", kind.alias("kind"), line.alias("line"))


def parse_progress(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(table(spark, sf, "events")).select("event_id", "kind", finished(F.col("kind"), F.col("line")).alias("done"))


def progress_increments(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("done", F.floor(F.col("value")).cast("long"))
    return ledger.increments(e, ["user_id"], ["pos"]).select("user_id", "pos", "done", "increment")


def progress_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Events as reports of a unit, errors as failures of an attempt: what stands as finished after each."""
    e = events(spark, sf).withColumn("done", F.floor(F.col("value")).cast("long"))
    return ledger.net_progress(e, ["user_id"], ["pos"], F.col("event_type") == "error").select("user_id", "pos", "net")


def size_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as units by customer: their lines as elements, their price as bytes, final status as done."""
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_elements"))
    units = table(spark, sf, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "n_elements", F.col("o_totalprice").alias("size_bytes"), (F.col("o_orderstatus") == "F").alias("finished"))
    done = ledger.totals(units.filter("finished"), ["o_custkey"])
    whole = units.groupBy("o_custkey").agg(F.sum("n_elements").alias("total")).join(done, "o_custkey", "left").fillna(0, ["done_elements", "done_bytes", "done_units"])
    found = ledger.projection(whole, F.lit(24.0), F.col("total"), F.lit(1000.0))
    speed = ledger.speed(F.col("done_elements"), F.lit(3), F.lit(10.0), F.col("total"))
    return found.select("o_custkey", "total", "done_elements", *(F.round(c, 4).alias(c) for c in ("kbps", "progress", "estimated_bytes")), F.round(speed["rate"], 4).alias("rate"), speed["text"].alias("shown"), F.round(speed["eta"], 4).alias("eta"))


def unit_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Users as units, their events as elements: events a second between the first and the last."""
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("ts").cast("timestamp")).alias("began"), F.max(F.col("ts").cast("timestamp")).alias("ended"))
    return spans.select("user_id", F.round(ledger.unit_rate(F.col("n"), F.col("began"), F.col("ended")), 9).alias("rate"))


def resume_remaining(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    left = ledger.remaining(orders, orders.filter("o_orderstatus = 'F'"), ["o_orderkey"])
    modes = ledger.resume_mode(orders.select("o_custkey").distinct(), orders.filter("o_orderkey % 3 = 0"), orders.filter("o_orderstatus = 'F'"), "o_custkey")
    return left.join(modes, "o_custkey").select("o_custkey", "o_orderkey", "mode")


def reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    """An order's key modulo 7 plus 1 is how many lines it is expected to have."""
    expected = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("n"))
    actual = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return ledger.reconciled(expected, actual, ["o_orderkey"])


def series_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose lines bought and lines returned differ in number."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")
    return ledger.parity(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"), ["l_partkey"])


def attempts_report(spark: SparkSession, sf: str) -> DataFrame:
    """Users as units: purchases are successes, errors failures; fifteen failures are too many."""
    tries = table(spark, sf, "events").filter("event_type in ('error', 'purchase')")
    return ledger.attempts(tries, ["user_id"], F.col("event_type") == "purchase", 15)


def work_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each customer by number of lines, in three orders."""
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    units = table(spark, sf, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "n")
    place = lambda how: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*ledger.work_order(units, F.col("n"), "o_orderkey", how)))
    return units.select("o_custkey", "o_orderkey", place("long-to-short").alias("longest"), place("short-to-long").alias("shortest"), place("sequential").alias("in_order"))


def work_order_random(spark: SparkSession, sf: str) -> DataFrame:
    """The same shuffled, alike on every run."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*ledger.work_order(orders, F.lit(0), "o_orderkey", "random", 5)))
    return orders.select("o_custkey", "o_orderkey", place.alias("place"))


def merge_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines of each return flag as units of a merge, numbered by their key: groups of 100."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_orderkey", "l_suppkey", "l_partkey")
    units = lines.groupBy("l_returnflag", F.col("l_partkey").alias("unit_idx")).agg(F.count(F.lit(1)).alias("n")).withColumn("name", settings.unit_name(F.col("unit_idx"), "ivf"))
    units = units.filter(ledger.stem_number(F.col("name")) == F.col("unit_idx"))
    grouped = ledger.merge_groups(units, ["l_returnflag"], "unit_idx", "name")
    return grouped.select("l_returnflag", "group_no", "group_name", F.concat_ws(" ", "members").alias("members"))


def merge_options(spark: SparkSession, sf: str) -> DataFrame:
    """Option documents and file lists of each region's nations."""
    units = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    side = F.when(F.col("n_regionkey") % 2 == 0, "side track.mka")
    return units.select("n_regionkey", ledger.merge_options(F.col("names"), F.lit("output.mkv"), side, F.lit("30/1")).alias("options"), ledger.file_list(F.col("names")).alias("files"))


def aligned_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's vectors against the next label's, position by position."""
    v = vectors(spark, sf)
    other = v.select((F.col("label") - 1).alias("label"), "pos", F.col("vec_id").alias("other_id"))
    return v.select("label", "pos", "vec_id").join(other, ["label", "pos"])


QUERIES = {
    f.__name__: f
    for f in (
        parse_progress, progress_increments, progress_rollback, size_projection, unit_rates, resume_remaining, reconcile_counts, series_parity, attempts_report, work_order, work_order_random, merge_manifest, merge_options, aligned_pairs,
    )
}

_COUNTS = "c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)"

SQL = {
    "parse_progress": "SELECT event_id, ['aom', 'rav1e', 'svt-av1', 'x264', 'x265', 'vpx'][(event_id % 6 + 1)::INT] AS kind, CASE WHEN event_id % 6 IN (3, 4) AND event_id % 4 = 1 THEN NULL ELSE event_id % 1000 END AS done FROM events",
    "progress_increments": f"WITH {EVENTS_SQL} SELECT user_id, pos, floor(value)::BIGINT AS done, greatest(floor(value)::BIGINT - coalesce(max(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS increment FROM e",
    "progress_rollback": f"""WITH {EVENTS_SQL}, a AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS attempt FROM e),
        b AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END) OVER (PARTITION BY user_id, attempt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM a)
        SELECT user_id, pos, greatest(CASE WHEN event_type = 'error' THEN 0 ELSE coalesce(best, 0) END, 0)::BIGINT AS net FROM b""",
    "work_order_random": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('5:' || o_orderkey), o_orderkey) AS place FROM orders",
    "size_projection": f"""WITH {_COUNTS}, u AS (SELECT o_custkey, sum(n) AS total, coalesce(sum(n) FILTER (WHERE o_orderstatus = 'F'), 0) AS d, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS b FROM orders JOIN c ON o_orderkey = l_orderkey GROUP BY o_custkey),
        s AS (SELECT *, CASE WHEN d < 3 THEN 3 ELSE d - 3 END AS since FROM u)
        SELECT o_custkey, total::BIGINT AS total, d::BIGINT AS done_elements, CASE WHEN d > 0 THEN round(b * 8 / 1000 / (d / 24.0::DOUBLE), 4) END AS kbps, CASE WHEN d > 0 THEN round(d::DOUBLE / total, 4) END AS progress, CASE WHEN d > 0 THEN round(b / (d::DOUBLE / total) + 1000, 4) END AS estimated_bytes,
          round(since / 10.0::DOUBLE, 4) AS rate, CASE WHEN since = 0 THEN '0 /s' WHEN since < 10 THEN printf('%.2f s each', 10.0::DOUBLE / since) ELSE printf('%.2f /s', since / 10.0::DOUBLE) END AS shown, CASE WHEN since > 0 THEN round(10.0::DOUBLE / since * (total - d), 4) END AS eta FROM s""",
    "unit_rates": "SELECT user_id, round(count(*) / nullif(epoch_us(max(ts)) / 1e6::DOUBLE - epoch_us(min(ts)) / 1e6::DOUBLE, 0), 9) AS rate FROM events GROUP BY user_id",
    "resume_remaining": "SELECT o_custkey, o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'resume' ELSE 'start' END AS mode FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "reconcile_counts": f"WITH {_COUNTS} SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, o_orderkey % 7 + 1 AS expected, n AS actual, true AS error FROM orders FULL JOIN c ON o_orderkey = l_orderkey WHERE (o_orderkey % 7 + 1) IS DISTINCT FROM n",
    "series_parity": "WITH r AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) SELECT coalesce(r.l_partkey, a.l_partkey) AS l_partkey, r.n AS expected, a.n AS actual, true AS error FROM r FULL JOIN a ON r.l_partkey = a.l_partkey WHERE r.n IS DISTINCT FROM a.n",
    "attempts_report": "SELECT user_id, count(*) AS tries, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'purchase') > 0 AS succeeded, count(*) FILTER (WHERE event_type = 'purchase') = 0 AND count(*) FILTER (WHERE event_type = 'error') >= 15 AS gave_up FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id",
    "work_order": f"WITH {_COUNTS} SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderkey) AS longest, row_number() OVER (PARTITION BY o_custkey ORDER BY n, o_orderkey) AS shortest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS in_order FROM orders JOIN c ON o_orderkey = l_orderkey",
    "merge_manifest": """WITH u AS (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem), p AS (SELECT *, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) - 1) // 100 AS g FROM u)
        SELECT l_returnflag, g AS group_no, printf('group_output_%05d', g) AS group_name, string_agg(printf('%05d', l_partkey) || '.ivf', ' ' ORDER BY l_partkey) AS members FROM p GROUP BY l_returnflag, g""",
    "merge_options": """SELECT n_regionkey, '["-o", "output.mkv"' || CASE WHEN n_regionkey % 2 = 0 THEN ', "side track.mka"' ELSE '' END || ', "--default-duration", "0:30/1fps", "["' || string_agg(', "' || n_name || '"', '' ORDER BY n_name) || ',"]"]' AS options,
        string_agg('file ' || replace(n_name, ' ', '\\ ') || chr(10), '' ORDER BY n_name) AS files FROM nation GROUP BY n_regionkey""",
    "aligned_pairs": f"WITH {VECTORS_SQL} SELECT a.label, a.pos, a.vec_id, b.vec_id AS other_id FROM v a JOIN v b ON b.label - 1 = a.label AND b.pos = a.pos",
}
