"""Steering every segment to its target band: what to measure next, a whole search against known curves, the final choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import curves

from . import long


def recommend_next(measurements: DataFrame, policies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """policies with ``next_setting``.

    measurements: keys, setting, score (more is better). policies: keys, low_limit, high_limit, target, step and, if wanted, method_3, method_4.
    """
    keys = list(keys)
    gathered = measurements.groupBy(*keys).agg(curves.points().alias("_p"))
    joined = policies.join(gathered, keys, "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<struct<score:double,setting:double>>")))
    method = lambda name, default: F.col(name) if name in policies.columns else default
    chosen = curves.recommended(F.col("_p"), F.col("low_limit"), F.col("high_limit"), F.col("target"), F.col("step"), method("method_3", "natural"), method("method_4", "pchip"))
    return joined.withColumn("next_setting", chosen).drop("_p")


def nearest(points: Column, wanted: Column) -> Column:
    """struct<d, setting, score> of the point (of an array of structs setting, score) whose setting is nearest to wanted: the lower of two as near."""
    return F.array_min(F.transform(points, lambda x: F.struct(F.abs(x["setting"] - wanted).alias("d"), x["setting"].alias("setting"), x["score"].alias("score"))))


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def search(curve: DataFrame, policies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Search every group's curve for a setting in the band; settings are those measured nearest to the predicted ones.

    curve: keys, setting, score (more is better, falling in setting). policies: keys, min_q, max_q, low, high (the band), step, probes. A group's curve is gathered once, an array of as
    many points as there are settings; its whole search is then one expression in its row, a fold over the rounds: predict, look up the nearest measured setting, move a limit.
    So the search adds no shuffle, table or action to the plan, whatever the number of probes.
    Returns keys, history (array of setting, score in the order measured), reason, low, high. Reasons: within band, limit reached, too high, too low (it ended on a limit
    with the score beyond the band), none (the setting had been measured before). A group without a curve is left out.
    """
    keys = list(keys)
    double = lambda c: F.col(c).cast("double").alias(c)
    gathered = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(double("setting"), double("score")))).alias("_curve"))
    asked = policies.select(*keys, double("min_q"), double("max_q"), double("low"), double("high"), double("step"), F.col("probes").cast("int").alias("probes")).join(gathered, keys)
    low, high, step, probes = (F.col(c) for c in ("low", "high", "step", "probes"))
    empty = F.array().cast("array<struct<setting:double,score:double>>")
    begin = F.struct(F.col("min_q").alias("lo"), F.col("max_q").alias("hi"), empty.alias("history"), F.lit(None).cast("string").alias("reason"))

    def advanced(s: Column, m: Column) -> Column:
        """The state after measuring m."""
        at, score, seen = m["setting"], m["score"], s["history"]
        again = F.exists(seen, lambda h: h["setting"] == at)
        last = F.element_at(seen, -1)["score"]
        ended = F.when(F.size(seen) == 0, "none").when(last > high, "too high").when(last < low, "too low").otherwise("none")
        over = F.when(again, ended).when(score.between(low, high), "within band").when(F.size(seen) + 1 >= probes, "limit reached")
        return F.struct(
            F.when(~again & (score > high), F.least(at + step, s["hi"])).otherwise(s["lo"]).alias("lo"),
            F.when(~again & (score < low), F.greatest(at - step, s["lo"])).otherwise(s["hi"]).alias("hi"),
            F.when(again, seen).otherwise(F.concat(seen, F.array(F.struct(at.alias("setting"), score.alias("score"))))).alias("history"),
            over.alias("reason"),
        )

    def played(s: Column) -> Column:
        points = F.array_sort(F.transform(s["history"], lambda h: F.struct(h["score"].alias("score"), h["setting"].alias("setting"))))
        wanted = _let(points, lambda p: curves.recommended(p, s["lo"], s["hi"], (low + high) / 2.0, step))
        return _let(wanted, lambda w: _let(nearest(F.col("_curve"), w), lambda m: advanced(s, m)))

    rounds = F.sequence(F.lit(0), F.greatest(probes, F.lit(0)))
    state = F.aggregate(rounds, begin, lambda s, _: F.when(s["reason"].isNotNull(), s).otherwise(played(s)))
    return asked.withColumn("_s", state).select(*keys, "_s.history", "_s.reason", "low", "high")


def final_choice(measurements: DataFrame, policies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, setting, score: the greatest setting whose score is in the band; without one, the measurement nearest the band's middle, the first of ties.

    measurements: keys, probe_no, setting, score. policies: keys, low, high.
    """
    keys = list(keys)
    both = measurements.join(policies.select(*keys, "low", "high"), keys)
    inside = F.col("score").between(F.col("low"), F.col("high"))
    pair = F.struct("setting", "score")
    chosen = both.groupBy(*keys).agg(
        F.max_by(F.when(inside, pair), F.when(inside, F.struct("setting", -F.col("probe_no")))).alias("_in"),
        F.min_by(pair, F.struct(F.abs(F.col("score") - (F.col("low") + F.col("high")) / 2.0), "probe_no")).alias("_near"),
    )
    return chosen.select(*keys, F.coalesce("_in", "_near").alias("_c"), F.col("_in").isNotNull().alias("in_band")).select(*keys, "_c.setting", "_c.score", "in_band")


def reusable(units: DataFrame) -> Column:
    """Can a measurement serve as the final result? Full sampling, the same parameters, no filter and no second input."""
    return (F.col("sampling_rate") == 1) & F.col("measured_params").eqNullSafe(F.col("final_params")) & F.col("filter").isNull() & F.col("second_input").isNull()


def report(found: DataFrame, keys: Sequence[str], metric: Column) -> DataFrame:
    """A row for each group of a search (keys, history, reason, low, high): what was measured, by setting, with the metric's own sign, the number of
    measurements, the reason, and the final choice: of the settings in the band the greatest, else the one nearest the band's middle, the first of ties.
    """
    turned = metric.isin("butteraugli-inf", "butteraugli-3")
    own = lambda score: F.when(turned, -score).otherwise(score)
    low, high = F.col("low"), F.col("high")
    inside = F.filter("history", lambda h: h["score"].between(low, high))
    away = F.transform("history", lambda h, i: F.struct(F.abs(h["score"] - (low + high) / 2.0).alias("d"), i.alias("i"), h["setting"].alias("setting"), h["score"].alias("score")))
    best, near = F.array_max(inside), F.array_min(away)
    final = lambda c: F.coalesce(best[c], near[c])
    measured = F.array_sort(F.transform("history", lambda h: F.struct(h["setting"].alias("setting"), own(h["score"]).alias("score"))))
    return found.select(*keys, measured.alias("measured"), F.size("history").alias("n"), "reason", final("setting").alias("final_setting"), own(final("score")).alias("final_score"))


def spline_moments(x: Column, y: Column) -> Column:
    """Half second derivatives of the natural cubic spline through points (arrays of three and more, x ascending): one fold forward, which leaves each row's upper element and value, and one fold back."""
    n = F.size(x)
    h = lambda i: F.get(x, i + 1) - F.get(x, i)
    slope = lambda i: (F.get(y, i + 1) - F.get(y, i)) / h(i)

    def forward(done: Column, i: Column) -> Column:
        last = F.get(done, i - 1)
        pivot = 2.0 * (h(i - 1) + h(i)) - h(i - 1) * last["upper"]
        value = (3.0 * (slope(i) - slope(i - 1)) - h(i - 1) * last["value"]) / pivot
        return F.concat(done, F.array(F.struct((h(i) / pivot).alias("upper"), value.alias("value"))))

    zero = F.lit(0.0)
    swept = F.aggregate(F.sequence(F.lit(1), n - 2), F.array(F.struct(zero.alias("upper"), zero.alias("value"))), forward)

    def back(rows: Column) -> Column:
        def step(done: Column, i: Column) -> Column:
            row = F.get(rows, i)
            return F.concat(F.array(row["value"] - row["upper"] * F.get(done, F.lit(0))), done)

        return F.concat(F.array(zero), F.aggregate(F.sequence(n - 2, F.lit(1), F.lit(-1)), F.array(zero), step))

    return F.transform(F.array(swept), back)[0]


def natural_splines(measured: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """asked (keys, target) with ``setting``, through any number (3 or more) of measured points of each group.

    A group's points are gathered in one row, sorted, and their tridiagonal system is solved there by two folds; no Python. Null outside the scores, and where scores repeat or are null, or points are fewer.
    """
    keys = list(keys)
    points = measured.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("score").cast("double").alias("x"), F.col("setting").cast("double").alias("y")))).alias("_p"))
    lists = points.select(*keys, F.transform("_p", lambda p: p["x"]).alias("_x"), F.transform("_p", lambda p: p["y"]).alias("_y"))
    sound = (F.size("_x") >= 3) & (F.size(F.array_distinct("_x")) == F.size("_x")) & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v))
    curve = lists.withColumn("_m", F.when(sound, spline_moments(F.col("_x"), F.col("_y"))))
    met = long.joined(asked.select(*keys, "target"), curve, keys, "left")
    t = F.col("target").cast("double")
    k = F.greatest(F.least(F.size(F.filter("_x", lambda v: v < t)) - 1, F.size("_x") - 2), F.lit(0))
    placed = met.withColumn("_k", F.when(F.col("_m").isNotNull(), k))
    of = lambda name, more=0: F.get(name, F.col("_k") + more)
    u, h = t - of("_x"), of("_x", 1) - of("_x")
    value = of("_y") + ((of("_y", 1) - of("_y")) / h - h * (2.0 * of("_m") + of("_m", 1)) / 3.0) * u + of("_m") * u * u + (of("_m", 1) - of("_m")) / (3.0 * h) * u * u * u
    inside = (t >= F.get("_x", F.lit(0))) & (t <= F.element_at("_x", -1))
    out = placed.withColumn("setting", F.when(F.col("_m").isNotNull() & inside, value))
    return out.select(*keys, "target", F.when(~F.isnan("setting"), F.col("setting")).alias("setting"))
