"""Cutting the given series into segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutline.operators import segments

from .tables import EVENTS_SQL, LINES_SQL, VECTORS_SQL, events, lines, table, vectors

USER = ["user_id"]
#: Overrides of every third user, where the series is long enough: start, end, max_len, min_len, noise, reset.
OVERRIDES = [(5, 15, 4, 2, None, False), (20, 30, None, 3, 8, True), (30, 38, 3, 1, 9, False)]
#: Forced cuts of every user.
FORCED = (3, 11, 25, 60, 5000)


def _info(e: DataFrame) -> DataFrame:
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_elements"))


def _overrides(spark: SparkSession, info: DataFrame) -> DataFrame:
    rows = spark.createDataFrame(OVERRIDES, "start long, end long, max_len long, min_len long, noise int, reset boolean")
    return info.filter("user_id % 3 = 0").join(F.broadcast(rows), F.col("end") <= F.col("n_elements")).drop("n_elements")


def options_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Options of parts: inherited ones, replaced by an override's own, and dropped where it resets them; some parts have none of either."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    base = F.when(key % 7 != 0, F.create_map(F.lit("--speed"), text(size % 10), F.lit("--cq"), text(size)))
    own = F.when(key % 3 == 0, F.create_map(F.lit("--cq"), text(size + 1), F.lit("--grain"), F.lit("4")))
    merged = table(spark, sf, "part").select("p_partkey", segments.merged_options(base, own, key % 5 == 0).alias("m"))
    return merged.select("p_partkey", F.size("m").alias("n"), *(F.try_element_at("m", F.lit(f"--{k}")).alias(k) for k in ("speed", "cq", "grain")))


def _errors(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'error'").select("user_id", "pos")


def _segments(e: DataFrame) -> DataFrame:
    return segments.from_cuts(_errors(e), _info(e), USER)


def cuts_to_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(events(spark, sf)).withColumn("n", F.col("end") - F.col("start"))


def sample_every_n(spark: SparkSession, sf: str) -> DataFrame:
    """Every third element of positions 2 to 30."""
    return segments.every_nth(segments.between(lines(spark, sf), 2, 30), 3, start=2).select("l_partkey", "pos", "l_quantity")


def override_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    info = _info(events(spark, sf))
    return segments.gaps_filled(_overrides(spark, info), info, USER).select("user_id", "start", "end", "max_len", "min_len")


def override_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals made from nation keys, some of which overlap."""
    made = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("series"), (F.col("n_nationkey") * 7 % 40).cast("long").alias("start"))
    return segments.overlaps(made.withColumn("end", F.col("start") + 6), ["series"])


def _attached(spark: SparkSession, sf: str, width: int | None) -> DataFrame:
    e = events(spark, sf)
    found = segments.attached(e.select("user_id", "pos", "event_id"), _overrides(spark, _info(e)), USER, width=width)
    noise, low = F.lit(4), F.lit(10)
    layered = segments.layered(found, {"max_len": F.lit(100), "min_len": low, "noise": noise}, {"max_len": F.lit(0), "min_len": F.lit(1), "noise": F.lit(0)}, kept=("max_len", "min_len"))
    return layered.select("user_id", "pos", "override_start", "effective_max_len", "effective_min_len", "effective_noise")


def override_attach(spark: SparkSession, sf: str) -> DataFrame:
    return _attached(spark, sf, None)


def override_attach_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _attached(spark, sf, 8)


def concat_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as parts, laid end to end within their number modulo 50; durations of the parts summed."""
    parts = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).withColumn("tape", F.pmod(F.col("conv_id"), F.lit(50)))
    placed = segments.concat_offsets(parts, ["tape"], "conv_id", "last_turn")
    total = F.sum(F.coalesce(F.col("last_turn") + 1, F.lit(0))).over(Window.partitionBy("tape"))
    return placed.select("tape", "conv_id", "offset", total.alias("total"))


def contiguity_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as segments [turn, turn + 1) with a gap wherever the user's turn was left out."""
    turns = table(spark, sf, "conversations").filter("role <> 'user' or turn % 3 <> 0").select("conv_id", F.col("turn").cast("long").alias("start"), (F.col("turn") + 1).cast("long").alias("end"))
    return segments.breaks(turns, ["conv_id"])


def forced_cuts(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    places = _info(e).select("user_id", F.explode(F.array(*(F.lit(p).cast("long") for p in FORCED))).alias("pos"))
    return segments.forced(_segments(e), places, USER)[0].select("user_id", "seg_idx", "start", "end")


def forced_cuts_outside(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    places = _info(e).select("user_id", F.explode(F.array(*(F.lit(p).cast("long") for p in FORCED))).alias("pos"))
    return segments.forced(_segments(e), places, USER)[1]


def even_splits(spark: SparkSession, sf: str) -> DataFrame:
    return segments.even_splits(_segments(events(spark, sf)), USER, F.lit(3)).select("user_id", "seg_idx", "start", "end")


def _costs(e: DataFrame) -> DataFrame:
    return segments.scalar_costs(e, USER, "pos", "value", F.lit(60.0))


def score_guided_splits(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return segments.guided_splits(_segments(e), _costs(e), USER, F.lit(4)).select("user_id", "seg_idx", "start", "end")


def change_points_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return segments.candidates(_costs(events(spark, sf))).select("user_id", "pos", F.round("inter_cost", 6).alias("inter_cost"))


def change_points_vector(spark: SparkSession, sf: str) -> DataFrame:
    costs = segments.vector_costs(vectors(spark, sf), ["label"], "pos", "embedding", F.lit(0.0))
    return costs.filter("inter_cost is not null").select("label", "pos", F.round("inter_cost", 4).alias("inter_cost"))


def min_length_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts at errors, at least 4 elements apart, and overrides' own least lengths within them."""
    e = events(spark, sf)
    info = _info(e)
    costs = e.select("user_id", "pos", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("inter_cost"), F.lit(1.0).alias("threshold"))
    return segments.detected(costs, info, USER, 4, _overrides(spark, info)).select("user_id", "seg_idx", "start", "end")


def segment_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    info = _info(e)
    places = info.select("user_id", F.lit(11).cast("long").alias("pos"))
    before, after = segments.segment(info, USER, _costs(e), 2, 6, _overrides(spark, info), places)
    return after.withColumn("step", F.lit("split")).unionByName(before.withColumn("step", F.lit("found")))


def keys_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments at errors inside the spans between purchases at which a segment starts, re-based."""
    e = events(spark, sf)
    found = _segments(e)
    marks = e.filter("pos % 7 = 0 or event_type = 'error'").select("user_id", "pos")
    return segments.within_spans(found, segments.key_starts(marks, found, USER), _info(e), USER).select("user_id", "start", "end", "span_start", "rel_start", "rel_end")


QUERIES = {
    f.__name__: f
    for f in (
        options_merged, cuts_to_segments, sample_every_n, override_gap_fill, override_overlaps, override_attach, override_attach_cells, concat_offsets, contiguity_violations, forced_cuts,
        forced_cuts_outside, even_splits, score_guided_splits, change_points_scalar, change_points_vector, min_length_cuts, segment_pipeline, keys_in_segments,
    )
}

_sql = lambda v: "NULL" if v is None else str(v)
_INFO = "i AS (SELECT user_id, count(*) AS n_elements FROM e GROUP BY user_id)"
_OVERRIDES = f"o AS (SELECT user_id, start, \"end\", max_len, min_len, noise, reset FROM i, (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in OVERRIDES)}) v(start, \"end\", max_len, min_len, noise, reset) WHERE user_id % 3 = 0 AND \"end\" <= n_elements)"
_SEGMENTS = """b AS (SELECT user_id, pos AS start FROM e WHERE event_type = 'error' AND pos > 0 UNION SELECT user_id, 0 FROM i),
  s AS (SELECT user_id, row_number() OVER w - 1 AS seg_idx, start, coalesce(lead(start) OVER w, n_elements) AS "end" FROM b JOIN i USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY start))"""
_BASE = f"WITH {EVENTS_SQL}, {_INFO}, "
_COSTS = "c AS (SELECT user_id, pos, inter_cost, inter_cost / 60.0::DOUBLE AS score FROM (SELECT user_id, pos, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS inter_cost FROM e) WHERE inter_cost IS NOT NULL)"


def _guided_sql(name: str, source: str, limit: str) -> str:
    """A recursive table (user_id, first, cur, "end", lim): of each segment of source longer than limit the places where its pieces begin, the last one that is short enough included."""
    middle = "greatest((\"end\" - cur) // ((\"end\" - cur) // lim + 1), 1)"
    return f"""{name} AS (SELECT user_id, start AS first, start AS cur, "end", ({limit})::BIGINT AS lim FROM {source} WHERE ({limit}) > 0 AND "end" - start > ({limit})
      UNION ALL
      SELECT user_id, first, cur + coalesce(max(floor(score * (1 - abs(middle - (pos - cur))::DOUBLE / greatest(least(lim, middle + middle // 2) - middle // 2, 1)) * 10000 + 0.5)::BIGINT * 1000000 + (pos - cur)) % 1000000, any_value(middle)) AS cur, "end", lim
      FROM (SELECT x.*, c.pos, c.score FROM (SELECT *, {middle} AS middle FROM {name} WHERE "end" - cur > lim) x
        LEFT JOIN c ON c.user_id = x.user_id AND c.pos >= x.cur + greatest(x.middle // 2, 1) AND c.pos <= x.cur + least(x.lim, x.middle + x.middle // 2)) GROUP BY user_id, first, cur, "end", lim)"""


def _numbered_sql(source: str) -> str:
    return f"""SELECT user_id, row_number() OVER w - 1 AS seg_idx, start, coalesce(lead(start) OVER w, n_elements) AS "end" FROM {source} JOIN i USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY start)"""


#: Stretches of a series: overrides, and what lies between, before and after them (max_len null there, own false), with a least length of its own or the default.
_STRETCHES = """p AS (SELECT user_id, start, "end", coalesce(max("end") OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM o),
  g AS (SELECT user_id, start, "end", min_len FROM o UNION ALL SELECT user_id, q, start, 2 FROM p WHERE start > q
    UNION ALL SELECT i.user_id, coalesce(m, 0), n_elements, 2 FROM i LEFT JOIN (SELECT user_id, max("end") AS m FROM o GROUP BY user_id) USING (user_id) WHERE coalesce(m, 0) < n_elements)"""
_PIPELINE = f"""WITH RECURSIVE {EVENTS_SQL}, {_INFO}, {_OVERRIDES}, {_COSTS}, {_STRETCHES},
  k AS (SELECT g.user_id, g.start, g.min_len, pos FROM g JOIN c ON c.user_id = g.user_id AND pos > g.start AND pos < g."end" AND inter_cost >= 60),
  r AS (SELECT user_id, start, min_len, start AS last FROM g
    UNION ALL SELECT user_id, start, min_len, next FROM (SELECT r.user_id, r.start, r.min_len, min(k.pos) AS next FROM r JOIN k ON k.user_id = r.user_id AND k.start = r.start AND k.pos >= r.last + r.min_len GROUP BY r.user_id, r.start, r.min_len, r.last)),
  b AS (SELECT user_id, last AS start FROM r UNION SELECT user_id, 0 FROM i UNION SELECT user_id, 11 FROM i WHERE n_elements > 11),
  f AS ({_numbered_sql("b")}),
  l AS (SELECT f.user_id, f.start, f."end", CASE WHEN o.start IS NULL THEN 6 ELSE o.max_len END AS lim0 FROM f LEFT JOIN o ON o.user_id = f.user_id AND o.start <= f.start AND f.start < o."end"),
  {_guided_sql("z", "l", "coalesce(lim0, 0)")},
  y AS (SELECT user_id, cur AS start FROM z UNION SELECT user_id, start FROM f),
  h AS ({_numbered_sql("y")})
  SELECT user_id, seg_idx, start, "end", 'found' AS step FROM f UNION ALL SELECT user_id, seg_idx, start, "end", 'split' FROM h"""
_ATTACH = f"""{_BASE}{_OVERRIDES} SELECT e.user_id, pos, o.start AS override_start, coalesce(max_len, 100) AS effective_max_len, coalesce(min_len, 10) AS effective_min_len,
  coalesce(noise, CASE WHEN coalesce(reset, false) THEN NULL ELSE 4 END, 0) AS effective_noise FROM e LEFT JOIN o ON e.user_id = o.user_id AND o.start <= pos AND pos < o."end" """
_FORCED = ", ".join(f"({p})" for p in FORCED)

SQL = {
    "options_merged": """WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE (p_size % 10)::VARCHAR END AS speed,
        CASE WHEN p_partkey % 3 = 0 THEN (p_size + 1)::VARCHAR WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE p_size::VARCHAR END AS cq, CASE WHEN p_partkey % 3 = 0 THEN '4' END AS grain FROM part)
        SELECT *, (speed IS NOT NULL)::INT + (cq IS NOT NULL)::INT + (grain IS NOT NULL)::INT AS n FROM m""",
    "cuts_to_segments": f'{_BASE}{_SEGMENTS} SELECT *, "end" - start AS n FROM s',
    "sample_every_n": f"WITH {LINES_SQL} SELECT l_partkey, pos, l_quantity FROM l WHERE pos >= 2 AND pos < 30 AND (pos - 2) % 3 = 0",
    "override_gap_fill": f"""{_BASE}{_OVERRIDES}, p AS (SELECT user_id, start, "end", coalesce(max("end") OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM o)
        SELECT user_id, start, "end", max_len, min_len FROM o UNION ALL SELECT user_id, q, start, NULL, NULL FROM p WHERE start > q
        UNION ALL SELECT i.user_id, coalesce(m, 0), n_elements, NULL, NULL FROM i LEFT JOIN (SELECT user_id, max("end") AS m FROM o GROUP BY user_id) USING (user_id) WHERE coalesce(m, 0) < n_elements""",
    "override_overlaps": 'WITH m AS (SELECT n_regionkey::BIGINT AS series, (n_nationkey * 7 % 40)::BIGINT AS start, (n_nationkey * 7 % 40)::BIGINT + 6 AS "end" FROM nation), x AS (SELECT *, lead(start) OVER (PARTITION BY series ORDER BY start, "end") AS next_start FROM m) SELECT * FROM x WHERE "end" > next_start',
    "override_attach": _ATTACH,
    "override_attach_cells": _ATTACH,
    "concat_offsets": """WITH p AS (SELECT conv_id, max(turn) AS last_turn, conv_id % 50 AS tape FROM conversations GROUP BY conv_id)
        SELECT tape, conv_id, coalesce(sum(last_turn + 1) OVER (PARTITION BY tape ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", (sum(last_turn + 1) OVER (PARTITION BY tape))::BIGINT AS total FROM p""",
    "contiguity_violations": """WITH t AS (SELECT conv_id, turn AS start, turn + 1 AS "end", lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_start FROM conversations WHERE role <> 'user' OR turn % 3 <> 0) SELECT * FROM t WHERE "end" <> next_start""",
    "forced_cuts": f"""{_BASE}{_SEGMENTS}, k AS (SELECT user_id, start FROM s UNION SELECT user_id, p FROM i, (VALUES {_FORCED}) v(p) WHERE p < n_elements)
        SELECT user_id, row_number() OVER w - 1 AS seg_idx, start, coalesce(lead(start) OVER w, n_elements) AS "end" FROM k JOIN i USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY start)""",
    "forced_cuts_outside": f"{_BASE}x AS (SELECT 1) SELECT user_id, p AS pos, 'outside the series' AS reject_reason FROM i, (VALUES {_FORCED}) v(p) WHERE p >= n_elements",
    "even_splits": f"""{_BASE}{_SEGMENTS}, k AS (SELECT *, "end" - start AS n, CASE WHEN "end" - start > 3 THEN ("end" - start) // 3 + 1 ELSE 1 END AS k FROM s), x AS (SELECT *, unnest(range(1, k + 1)) AS j FROM k),
        y AS (SELECT user_id, (start + floor(n * ((j - 1)::DOUBLE / k)))::BIGINT AS a, CASE WHEN j = k THEN "end" ELSE (start + floor(n * (j::DOUBLE / k)))::BIGINT END AS z FROM x)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS seg_idx, a AS start, z AS "end" FROM y""",
    "score_guided_splits": f"""WITH RECURSIVE {EVENTS_SQL}, {_INFO}, {_SEGMENTS}, {_COSTS}, {_guided_sql("z", "s", "4")}, y AS (SELECT user_id, cur AS start FROM z UNION SELECT user_id, start FROM s) {_numbered_sql("y")}""",
    "segment_pipeline": _PIPELINE,
    "change_points_scalar": f"WITH {EVENTS_SQL}, c AS (SELECT user_id, pos, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)) AS inter_cost FROM e) SELECT user_id, pos, round(inter_cost, 6) AS inter_cost FROM c WHERE inter_cost >= 60",
    "change_points_vector": f"WITH {VECTORS_SQL}, c AS (SELECT label, pos, list_distance(embedding::DOUBLE[], (lag(embedding) OVER (PARTITION BY label ORDER BY pos))::DOUBLE[]) AS inter_cost FROM v) SELECT label, pos, round(inter_cost, 4) AS inter_cost FROM c WHERE inter_cost IS NOT NULL",
    "min_length_cuts": f"""WITH RECURSIVE {EVENTS_SQL}, {_INFO}, {_OVERRIDES}, p AS (SELECT user_id, start, "end", coalesce(max("end") OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM o),
        g AS (SELECT user_id, start, "end", min_len FROM o UNION ALL SELECT user_id, q, start, 4 FROM p WHERE start > q
          UNION ALL SELECT i.user_id, coalesce(m, 0), n_elements, 4 FROM i LEFT JOIN (SELECT user_id, max("end") AS m FROM o GROUP BY user_id) USING (user_id) WHERE coalesce(m, 0) < n_elements),
        k AS (SELECT g.user_id, g.start, g.min_len, pos FROM g JOIN e ON e.user_id = g.user_id AND pos > g.start AND pos < g."end" AND event_type = 'error'),
        r AS (SELECT user_id, start, min_len, start AS last FROM g
          UNION ALL SELECT user_id, start, min_len, next FROM (SELECT r.user_id, r.start, r.min_len, min(k.pos) AS next FROM r JOIN k ON k.user_id = r.user_id AND k.start = r.start AND k.pos >= r.last + r.min_len GROUP BY r.user_id, r.start, r.min_len, r.last)),
        u AS (SELECT DISTINCT user_id, last FROM r)
        SELECT user_id, row_number() OVER w - 1 AS seg_idx, last AS start, coalesce(lead(last) OVER w, n_elements) AS "end" FROM u JOIN i USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY last)""",
    "keys_in_segments": f"""{_BASE}{_SEGMENTS}, m AS (SELECT e.user_id, pos FROM e JOIN s ON s.user_id = e.user_id AND s.start = pos WHERE pos % 7 = 0 OR event_type = 'error'),
        t AS (SELECT m.user_id, pos AS span_start, coalesce(lead(pos) OVER (PARTITION BY m.user_id ORDER BY pos), n_elements) AS span_end FROM m JOIN i USING (user_id))
        SELECT s.user_id, start, "end", span_start, start - span_start AS rel_start, "end" - span_start AS rel_end FROM s JOIN t ON s.user_id = t.user_id AND start >= span_start AND "end" <= span_end""",
}
