"""Inverting response curves: the seven methods, recommendations, searches and final choices.

A brand's curve is met at a few settings, as a search would have measured it; targets lie inside and outside the measured scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions import curves, settings
from cutline.operators import search

from .tables import CURVES_SQL, brand_curves, table

#: Settings at which a curve counts as measured, and the scores that are asked for.
MEASURED = {2: (10, 40), 3: (10, 25, 40), 4: (5, 20, 35, 45)}
KNOWN = [(1, 30.0), *((n, float(x)) for n in (2, 3, 4) for x in MEASURED[n]), *((5, float(x)) for x in (5, 20, 30, 35, 45))]
TARGETS = (15.0, 40.0, 62.5, 85.0)


def _points(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return brand_curves(spark, sf).filter(F.col("setting").isin(*MEASURED[n])).groupBy("p_brand").agg(curves.points().alias("p")).filter(F.size("p") == n)


def _interpolated(method: str, n: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        asked = _points(spark, sf, n).select("p_brand", "p", F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
        return asked.select("p_brand", "target", F.round(curves.METHODS[method](F.col("p"), F.col("target")), 6).alias("setting"))

    query.__name__ = f"interp_{method}"
    return query


def interp_natural_many(spark: SparkSession, sf: str) -> DataFrame:
    """Splines through all of a brand's points."""
    curve = brand_curves(spark, sf)
    asked = curve.select("p_brand").distinct().select("p_brand", F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
    found = search.natural_splines(curve, asked.toDF("p_brand", "target"), ["p_brand"])
    return found.withColumn("setting", F.round("setting", 6))


def metric_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Is a measured score inside the band 39 to 41, for a metric of which more is better and one of which less is?"""
    curve = brand_curves(spark, sf).withColumn("metric", F.when(F.col("setting").cast("int") % 2 == 0, "butteraugli-3").otherwise("ssimulacra2"))
    band = settings.oriented_band(F.col("metric"), F.lit(39.0), F.lit(41.0))
    score = settings.oriented(F.col("metric"), F.col("score"))
    return curve.select("p_brand", "setting", "metric", band["low"].alias("low"), band["high"].alias("high"), settings.within(score, band["low"], band["high"]).alias("inside"))


def recommend_next(spark: SparkSession, sf: str) -> DataFrame:
    """As if 0 to 5 settings of each brand had been measured, by the brand's number."""
    curve = brand_curves(spark, sf).withColumn("number", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 6)
    measured = curve.join(F.broadcast(spark.createDataFrame(KNOWN, "number int, setting double")), ["number", "setting"])
    policies = curve.select("p_brand").distinct().select("p_brand", F.lit(1.0).alias("low_limit"), F.lit(50.0).alias("high_limit"), F.lit(40.0).alias("target"), F.lit(1.0).alias("step"))
    return search.recommend_next(measured, policies, ["p_brand"]).select("p_brand", "next_setting")


def _policies(curve: DataFrame) -> DataFrame:
    return curve.select("p_brand").distinct().select("p_brand", F.lit(1).alias("min_q"), F.lit(50).alias("max_q"), F.lit(39.0).alias("low"), F.lit(41.0).alias("high"), F.lit(1.0).alias("step"), F.lit(4).alias("probes"))


def curve_search(spark: SparkSession, sf: str) -> DataFrame:
    curve = brand_curves(spark, sf)
    found = search.search(curve, _policies(curve), ["p_brand"])
    return found.select("p_brand", F.size("history").alias("probes"), F.concat_ws(",", F.transform("history", lambda h: h["setting"].cast("int").cast("string"))).alias("settings"), "reason")


def unit_report(spark: SparkSession, sf: str) -> DataFrame:
    """The search's report by brand, as if less were better for every second brand: measured settings in order, scores with their own sign."""
    curve = brand_curves(spark, sf)
    metric = F.when(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 2 == 0, "butteraugli-3").otherwise("ssimulacra2")
    found = search.report(search.search(curve, _policies(curve), ["p_brand"]), ["p_brand"], metric)
    shown = F.concat_ws(",", F.transform("measured", lambda m: F.concat(m["setting"].cast("int").cast("string"), F.lit(":"), F.round(m["score"] * 1000).cast("long").cast("string"))))
    return found.select("p_brand", "n", "reason", shown.alias("measured"), "final_setting", F.round("final_score", 6).alias("final_score"))


#: Families as the six kinds name them, by the brand's number; texts of limits that some policies have.
RANGES = ("10-50", None, "20-35", None)


def policy_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as policies of a family, every second without limits of its own: the family's default range, and the part's price in hundreds snapped to the family's step and held in the range."""
    kinds = F.element_at(F.array(*(F.lit(f[0]) for f in settings.FAMILIES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    limit = lambda i: F.element_at(F.array(*(F.lit(int(r.split("-")[i]) if r else None).cast("int") for r in RANGES)), (F.col("p_size") % 4 + 1).cast("int"))
    raw = table(spark, sf, "part").select("p_partkey", kinds.alias("family"), limit(0).alias("min_q"), limit(1).alias("max_q"), (F.col("p_retailprice") / 37.0).alias("wanted"))
    ranged = settings.with_default_range(raw, settings.families(spark))
    return ranged.select("p_partkey", "family", "min_q", "max_q", settings.snapped(F.col("wanted"), F.col("step"), F.col("min_q"), F.col("max_q")).alias("setting"))


def final_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting of a curve as a measurement, in an order of its own."""
    curve = brand_curves(spark, sf)
    measured = curve.withColumn("probe_no", (F.col("setting") * 7 % 51).cast("int"))
    return search.final_choice(measured, _policies(curve), ["p_brand"]).select("p_brand", "setting", F.round("score", 6).alias("score"), "in_band")


def reuse_measurement(spark: SparkSession, sf: str) -> DataFrame:
    """Which measurements can stand as final results, by made-up parameters of each setting."""
    s = F.col("setting").cast("int")
    units = brand_curves(spark, sf).select(
        "p_brand", s.alias("setting"), (s % 3 + 1).alias("sampling_rate"), F.when(s % 5 != 0, F.concat(F.lit("--speed "), (s % 2).cast("string"))).alias("measured_params"),
        F.when(s % 10 != 0, "--speed 1").alias("final_params"), F.when(s % 7 == 0, "crop").alias("filter"), F.lit(None).cast("string").alias("second_input"),
    )
    return units.filter(search.reusable(units)).select("p_brand", "setting")


QUERIES = {f"interp_{m}": _interpolated(m, n) for m, n in (("linear", 2), ("quadratic", 3), ("natural", 4), ("pchip", 4), ("catmull", 4), ("akima", 4), ("cubic", 4))}
QUERIES["interp_natural_3"] = _interpolated("natural", 3)
QUERIES |= {f.__name__: f for f in (interp_natural_many, metric_bands, recommend_next, curve_search, unit_report, policy_defaults, final_choice, reuse_measurement)}


def _measured_sql(n: int) -> str:
    """Points x0..., y0... of each brand (null where the curve lacks them), and the targets."""
    values = ", ".join(map(str, MEASURED[n]))
    xs = ", ".join(f"s[{i + 1}].score AS x{i}, s[{i + 1}].setting AS y{i}" for i in range(n))
    targets = ", ".join(f"({t}::DOUBLE)" for t in TARGETS)
    return f"""WITH {CURVES_SQL}, g AS (SELECT p_brand, list_sort(list({{'score': score, 'setting': setting}})) AS s FROM c WHERE setting IN ({values}) GROUP BY p_brand),
        p AS (SELECT p_brand, target AS t, {xs} FROM g, (VALUES {targets}) v(target) WHERE len(s) = {n})"""


def _lagrange_sql(n: int) -> str:
    return " + ".join(f"y{i}" + "".join(f" * (t - x{j}) / (x{i} - x{j})" for j in range(n) if j != i) for i in range(n))


def _hermite_sql(k: int, d0: str, d1: str) -> str:
    u, h = f"((t - x{k}) / (x{k + 1} - x{k}))", f"(x{k + 1} - x{k})"
    return f"((2 * {u}^3 - 3 * {u}^2 + 1) * y{k} + ({u}^3 - 2 * {u}^2 + {u}) * {h} * {d0} + (3 * {u}^2 - 2 * {u}^3) * y{k + 1} + ({u}^3 - {u}^2) * {h} * {d1})"


def _pieces_sql(pieces: list[str]) -> str:
    whens = " ".join(f"WHEN t BETWEEN x{k} AND x{k + 1} THEN {p}" for k, p in enumerate(pieces))
    return f"CASE {whens} ELSE {pieces[0]} END"


def _query_sql(n: int, value: str, low: str | None = None, high: str | None = None, more: str = "", measured: str = "", digits: int = 6) -> str:
    rising = " AND ".join(f"x{i} < x{i + 1}" for i in range(n - 1))
    ranged = f" AND t BETWEEN {low} AND {high}" if low else ""
    return f"{measured or _measured_sql(n)}{more} SELECT p_brand, t AS target, round(CASE WHEN {rising}{ranged} THEN {value} END, {digits}) AS setting FROM {'q' if more else 'p'}"


_SLOPES = ", q AS (SELECT *, (y1 - y0) / (x1 - x0) AS s0, (y2 - y1) / (x2 - x1) AS s1, (y3 - y2) / (x3 - x2) AS s2, x1 - x0 AS h0, x2 - x1 AS h1, x3 - x2 AS h2 FROM p)"
_SPLINE4 = (
    ", q0 AS (SELECT *, (y1 - y0) / (x1 - x0) AS s0, (y2 - y1) / (x2 - x1) AS s1, (y3 - y2) / (x3 - x2) AS s2, x1 - x0 AS h0, x2 - x1 AS h1, x3 - x2 AS h2 FROM p), "
    "q AS (SELECT *, 0.0::DOUBLE AS m0, (3 * (s1 - s0) * 2 * (h1 + h2) - h1 * 3 * (s2 - s1)) / (4 * (h0 + h1) * (h1 + h2) - h1 * h1) AS m1, "
    "(2 * (h0 + h1) * 3 * (s2 - s1) - h1 * 3 * (s1 - s0)) / (4 * (h0 + h1) * (h1 + h2) - h1 * h1) AS m2, 0.0::DOUBLE AS m3 FROM q0)"
)
_SPLINE3 = (
    ", q0 AS (SELECT *, (y1 - y0) / (x1 - x0) AS s0, (y2 - y1) / (x2 - x1) AS s1, x1 - x0 AS h0, x2 - x1 AS h1 FROM p), "
    "q AS (SELECT *, 0.0::DOUBLE AS m0, 3 * (s1 - s0) / (2 * (h0 + h1)) AS m1, 0.0::DOUBLE AS m2 FROM q0)"
)
_spline = lambda k: f"(y{k} + (s{k} - h{k} * (2 * m{k} + m{k + 1}) / 3) * (t - x{k}) + m{k} * (t - x{k})^2 + (m{k + 1} - m{k}) / (3 * h{k}) * (t - x{k})^3)"


def _pchip_sql(measured: str = "", digits: int = 6) -> str:
    inner = lambda i: f"CASE WHEN s{i - 1} * s{i} <= 0 THEN 0 ELSE (3 * h{i} + 3 * h{i - 1}) / ((2 * h{i} + h{i - 1}) / s{i - 1} + (h{i} + 2 * h{i - 1}) / s{i}) END"
    stage = _SLOPES.replace(", q AS", ", r AS") + f", r0 AS (SELECT *, s0 AS d0, {inner(1)} AS d1, {inner(2)} AS d2, s2 AS d3 FROM r)"
    for i in range(3):
        tau = f"((d{i} / s{i})^2 + (d{i + 1} / s{i})^2)"
        new = lambda j, i=i, tau=tau: f"CASE WHEN s{i} = 0 THEN 0 WHEN {tau} > 9 THEN 3 / sqrt({tau}) * d{j} ELSE d{j} END AS d{j}"
        stage += f", {'q' if i == 2 else f'r{i + 1}'} AS (SELECT * REPLACE ({new(i)}, {new(i + 1)}) FROM r{i})"
    return _query_sql(4, _pieces_sql([_hermite_sql(k, f"d{k}", f"d{k + 1}") for k in range(3)]), more=stage, measured=measured, digits=digits)


def _linear_sql(measured: str = "", digits: int = 6) -> str:
    return _query_sql(2, "y0 + (t - x0) * (y1 - y0) / (x1 - x0)", measured=measured, digits=digits)


def _natural_3_sql(measured: str = "", digits: int = 6) -> str:
    return _query_sql(3, _pieces_sql([_spline(k) for k in range(2)]), "x0", "x2", _SPLINE3, measured, digits)


def _points_sql(n: int, source: str, where: str = "true") -> str:
    """A WITH clause: the points s of source (p_brand, t, s) in columns."""
    xs = ", ".join(f"s[{i + 1}].score AS x{i}, s[{i + 1}].setting AS y{i}" for i in range(n))
    return f"WITH p AS (SELECT p_brand, t, {xs} FROM {source} WHERE {where})"


def _recommend_sql() -> str:
    known = ", ".join(f"({n}, {x}::DOUBLE)" for n, x in KNOWN)
    forms = {2: _linear_sql, 3: _natural_3_sql, 4: _pchip_sql}
    found = " UNION ALL ".join(f"SELECT p_brand, setting FROM ({f(_points_sql(n, 'g', f'len(s) = {n}'), 12)})" for n, f in forms.items())
    return rf"""WITH {CURVES_SQL}, b AS (SELECT DISTINCT p_brand, regexp_extract(p_brand, '(\d+)', 1)::INT % 6 AS number FROM c),
        g AS (SELECT c.p_brand, 40.0::DOUBLE AS t, list_sort(list({{'score': c.score, 'setting': c.setting}})) AS s FROM c JOIN b ON b.p_brand = c.p_brand JOIN (VALUES {known}) k(number, setting) ON k.number = b.number AND k.setting = c.setting GROUP BY c.p_brand),
        f AS ({found})
        SELECT b.p_brand, least(greatest(round(coalesce(f.setting, 25.5)), 1), 50)::DOUBLE AS next_setting FROM b LEFT JOIN f ON f.p_brand = b.p_brand"""


def _search_sql() -> str:
    """The four rounds of a search for scores of 39 to 41 as tables s0 (nothing measured) to s4; q and z are the settings and scores in the order measured."""
    text = f"WITH {CURVES_SQL}, s0 AS (SELECT DISTINCT p_brand, 1.0::DOUBLE AS lo, 50.0::DOUBLE AS hi, NULL::VARCHAR AS reason FROM c)"
    for k in range(4):
        seen = [f"q{i}" for i in range(k)]
        held = "".join(f", q{i}, z{i}" for i in range(k))
        points = "list_sort([" + ", ".join(f"{{'score': z{i}, 'setting': q{i}}}" for i in range(k)) + "])" if k else "NULL"
        text += f", o{k} AS (SELECT p_brand, lo, hi{held}, 40.0::DOUBLE AS t, {points} AS s FROM s{k} WHERE reason IS NULL)"
        value = {2: _linear_sql, 3: _natural_3_sql}.get(k)
        found = value(_points_sql(k, f"o{k}"), 12) if value else f"SELECT p_brand, NULL::DOUBLE AS setting FROM o{k}"
        text += f", w{k} AS (SELECT o.*, least(greatest(round(coalesce(f.setting, (lo + hi) / 2)), lo), hi) AS w FROM o{k} o JOIN ({found}) f ON f.p_brand = o.p_brand)"
        text += f", n{k} AS (SELECT w.*, c.setting AS a, c.score AS y, row_number() OVER (PARTITION BY w.p_brand ORDER BY abs(c.setting - w), c.setting) AS rn FROM w{k} w JOIN c ON c.p_brand = w.p_brand)"
        again = f"a IN ({', '.join(seen)})" if seen else "false"
        last = f"CASE WHEN z{k - 1} > 41 THEN 'too high' WHEN z{k - 1} < 39 THEN 'too low' ELSE 'none' END" if k else "'none'"
        text += f""", s{k + 1} AS (SELECT p_brand, CASE WHEN NOT {again} AND y > 41 THEN least(a + 1, hi) ELSE lo END AS lo, CASE WHEN NOT {again} AND y < 39 THEN greatest(a - 1, lo) ELSE hi END AS hi{held},
            CASE WHEN {again} THEN NULL ELSE a END AS q{k}, CASE WHEN {again} THEN NULL ELSE y END AS z{k}, CASE WHEN {again} THEN {last} WHEN y BETWEEN 39 AND 41 THEN 'within band' WHEN {k + 1} >= 4 THEN 'limit reached' END AS reason FROM n{k} WHERE rn = 1)"""
    columns = lambda k: ", ".join(f"{c}{i}" if i < k else f"NULL::DOUBLE AS {c}{i}" for c in "qz" for i in range(4))
    return text + ", found AS (" + " UNION ALL ".join(f"SELECT p_brand, reason, {columns(k)} FROM s{k} WHERE reason IS NOT NULL" for k in range(1, 5)) + ")"


def _report_sql() -> str:
    each = " UNION ALL ".join(f"SELECT p_brand, reason, {i} AS i, q{i} AS q, z{i} AS z FROM found WHERE q{i} IS NOT NULL" for i in range(4))
    sign = r"CASE WHEN regexp_extract(p_brand, '(\d+)', 1)::INT % 2 = 0 THEN -1 ELSE 1 END"
    return f"""{_search_sql()}, e AS (SELECT *, z BETWEEN 39 AND 41 AS ok, {sign} AS sign FROM ({each})),
        b AS (SELECT p_brand, q, z, row_number() OVER (PARTITION BY p_brand ORDER BY ok DESC, CASE WHEN ok THEN -q END, abs(z - 40), i) AS rn FROM e)
        SELECT e.p_brand, count(*)::INT AS n, any_value(reason) AS reason, string_agg(e.q::INT || ':' || round(e.z * sign * 1000)::BIGINT, ',' ORDER BY e.q) AS measured, any_value(b.q) AS final_setting, any_value(round(b.z * sign, 6)) AS final_score
        FROM e JOIN b ON b.p_brand = e.p_brand AND b.rn = 1 GROUP BY e.p_brand"""


def _spline_sql() -> str:
    targets = ", ".join(f"({t}::DOUBLE)" for t in TARGETS)
    return f"""WITH RECURSIVE {CURVES_SQL}, d AS (SELECT p_brand, score AS x, setting AS y, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n, lead(score) OVER w - score AS h,
          (lead(setting) OVER w - setting) / (lead(score) OVER w - score) AS s FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY score)),
        u AS (SELECT p_brand, 0::BIGINT AS k, 0.0::DOUBLE AS upper, 0.0::DOUBLE AS v, h, s FROM d WHERE k = 0
          UNION ALL SELECT d.p_brand, d.k, d.h / (2 * (u.h + d.h) - u.h * u.upper), (3 * (d.s - u.s) - u.h * u.v) / (2 * (u.h + d.h) - u.h * u.upper), d.h, d.s FROM u JOIN d ON d.p_brand = u.p_brand AND d.k = u.k + 1 WHERE d.k < d.n - 1),
        m AS (SELECT p_brand, k, 0.0::DOUBLE AS m FROM d WHERE k = n - 1 UNION ALL SELECT u.p_brand, u.k, CASE WHEN u.k = 0 THEN 0 ELSE u.v - u.upper * m.m END FROM m JOIN u ON u.p_brand = m.p_brand AND u.k = m.k - 1),
        q AS (SELECT d.*, a.m AS m0, b.m AS m1 FROM d JOIN m a ON a.p_brand = d.p_brand AND a.k = d.k JOIN m b ON b.p_brand = d.p_brand AND b.k = d.k + 1),
        e AS (SELECT q.p_brand, t, y + (s - h * (2 * m0 + m1) / 3) * (t - x) + m0 * (t - x)^2 + (m1 - m0) / (3 * h) * (t - x)^3 AS setting FROM q, (VALUES {targets}) v(t) WHERE t <= x + h AND (t > x OR (k = 0 AND t = x)))
        SELECT b.p_brand, v.t AS target, round(e.setting, 6) AS setting FROM (SELECT DISTINCT p_brand FROM c) b CROSS JOIN (VALUES {targets}) v(t) LEFT JOIN e ON e.p_brand = b.p_brand AND e.t = v.t"""


def _defaults_sql() -> str:
    rows = ", ".join(f"({i}, '{f}', {low}, {high}, {step}::DOUBLE)" for i, (f, low, high, _, step) in enumerate(settings.FAMILIES))
    limit = lambda i: "CASE p_size % 4 " + " ".join(f"WHEN {k} THEN {r.split('-')[i]}" for k, r in enumerate(RANGES) if r) + " END"
    return f"""WITH p AS (SELECT p_partkey, family, coalesce({limit(0)}, low)::INT AS min_q, coalesce({limit(1)}, high)::INT AS max_q, p_retailprice / 37 AS wanted, step FROM part JOIN (VALUES {rows}) f(i, family, low, high, step) ON i = p_partkey % 6)
        SELECT p_partkey, family, min_q, max_q, least(greatest(round(wanted / step) * step, min_q), max_q)::DOUBLE AS setting FROM p"""


SQL = {
    "metric_bands": f"""WITH {CURVES_SQL}, m AS (SELECT *, setting::INT % 2 = 0 AS less FROM c) SELECT p_brand, setting, CASE WHEN less THEN 'butteraugli-3' ELSE 'ssimulacra2' END AS metric,
        CASE WHEN less THEN -41 ELSE 39 END::DOUBLE AS low, CASE WHEN less THEN -39 ELSE 41 END::DOUBLE AS high, score BETWEEN 39 AND 41 AS inside FROM m""",
    "interp_linear": _linear_sql(),
    "interp_natural_many": _spline_sql(),
    "recommend_next": _recommend_sql(),
    "curve_search": f"""{_search_sql()} SELECT p_brand, ((q0 IS NOT NULL)::INT + (q1 IS NOT NULL)::INT + (q2 IS NOT NULL)::INT + (q3 IS NOT NULL)::INT) AS probes, concat_ws(',', q0::INT, q1::INT, q2::INT, q3::INT) AS settings, reason FROM found""",
    "unit_report": _report_sql(),
    "policy_defaults": _defaults_sql(),
    "interp_quadratic": _query_sql(3, _lagrange_sql(3), "x0", "x2"),
    "interp_cubic": _query_sql(4, _lagrange_sql(4), "x0", "x3"),
    "interp_natural": _query_sql(4, _pieces_sql([_spline(k) for k in range(3)]), "x0", "x3", _SPLINE4),
    "interp_natural_3": _natural_3_sql(),
    "interp_catmull": _query_sql(4, _hermite_sql(1, "(0.5 * (y2 - y0) / (x2 - x0))", "(0.5 * (y3 - y1) / (x3 - x1))"), "x1", "x2"),
    "interp_akima": _query_sql(4, _pieces_sql([_hermite_sql(0, "s0", "((s0 + s1) / 2)"), _hermite_sql(1, "((s0 + s1) / 2)", "((s1 + s2) / 2)"), _hermite_sql(2, "((s1 + s2) / 2)", "s2")]), "x0", "x3", _SLOPES),
    "interp_pchip": _pchip_sql(),
    "final_choice": f"""WITH {CURVES_SQL}, m AS (SELECT *, (setting * 7 % 51)::INT AS probe_no, score BETWEEN 39 AND 41 AS ok FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ok DESC, CASE WHEN ok THEN -setting END, abs(score - 40), probe_no) AS rn FROM m)
        SELECT p_brand, setting, round(score, 6) AS score, ok AS in_band FROM r WHERE rn = 1""",
    "reuse_measurement": f"""WITH {CURVES_SQL} SELECT p_brand, setting::INT AS setting FROM c WHERE setting::INT % 3 = 0 AND setting::INT % 7 <> 0
        AND (CASE WHEN setting::INT % 5 <> 0 THEN '--speed ' || (setting::INT % 2) END) IS NOT DISTINCT FROM (CASE WHEN setting::INT % 10 <> 0 THEN '--speed 1' END)""",
}
