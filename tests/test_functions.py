"""Golden values of statistics, curves, settings, progress lines and manifests."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cutline.functions import curves, settings, stats
from cutline.functions.progress import finished
from cutline.operators import ledger, match, search

CURVES = {
    "c2a": ([82.502861, 87.600777], [20, 10]), "c2b": ([78.737953, 89.179634], [15, 5]),
    "c3a": ([72.812233, 78.517479, 84.872162], [30, 20, 10]), "c3b": ([72.134048, 80.161186, 84.864449], [35, 25, 15]),
    "c4a": ([72.9709, 80.5088, 85.7452, 92.4354], [35, 25, 15, 5]), "c4b": ([37.303120, 50.740498, 57.916622, 66.699707], [55, 50, 45, 40]), "c4flat": ([4.944567, 5.270722, 5.345044, 5.575547], [65, 66, 64, 63]),
}


def value(spark, method, scores, sets, target):
    rows = [(float(a), float(b)) for a, b in zip(scores, sets, strict=True)]
    p = F.array(*(F.struct(F.lit(a).alias("score"), F.lit(b).alias("setting")) for a, b in rows))
    return spark.range(1).select(curves.METHODS[method](p, F.lit(float(target))).alias("v")).first().v


@pytest.mark.parametrize(
    ("curve", "target", "method", "expected"),
    [
        ("c2a", 84.0, "linear", 17.063233289838426), ("c3a", 75.0, "quadratic", 26.051038785143348), ("c3a", 75.0, "natural", 26.0862745524861),
        ("c3a", 81.0, "quadratic", 15.95061813797397), ("c3a", 81.0, "natural", 15.978507559396048), ("c3a", 65.0, "quadratic", None), ("c3a", 90.0, "quadratic", None),
        ("c4a", 76.0, "natural", 31.51053424593822), ("c4a", 76.0, "pchip", 31.16800050265631), ("c4a", 76.0, "catmull", None), ("c4a", 76.0, "akima", 31.19377513750522), ("c4a", 76.0, "cubic", 32.154942200750845),
        ("c4a", 83.0, "natural", 20.29376515880263), ("c4a", 83.0, "pchip", 20.326932721519192), ("c4a", 83.0, "catmull", 20.348493170069055), ("c4a", 83.0, "akima", 20.31322362515388), ("c4a", 83.0, "cubic", 20.271243347339997),
        ("c4a", 89.0, "pchip", 9.971441412562381), ("c4a", 89.0, "akima", 9.956898326603213), ("c4a", 70.0, "akima", None), ("c4a", 95.0, "akima", None),
    ],
)
def test_curve_values(spark, curve, target, method, expected):
    got = value(spark, method, *CURVES[curve], target)
    assert got is None if expected is None else math.isclose(got, expected, abs_tol=1e-9)


@pytest.mark.parametrize("curve", sorted(CURVES))
def test_nodes_are_met(spark, curve):
    scores, sets = CURVES[curve]
    methods = {2: ["linear"], 3: ["quadratic", "natural"], 4: ["natural", "pchip", "akima", "cubic", "catmull"]}[len(scores)]
    p = F.array(*(F.struct(F.lit(float(a)).alias("score"), F.lit(float(b)).alias("setting")) for a, b in zip(scores, sets, strict=True)))
    inner = {"catmull": scores[1:3]}
    columns = [curves.METHODS[m](p, F.lit(s)).alias(f"{m}{i}") for m in methods for i, s in enumerate(inner.get(m, scores))]
    expected = [float(b) for m in methods for a, b in zip(scores, sets, strict=True) if a in inner.get(m, scores)]
    assert spark.range(1).select(*columns).first() == pytest.approx(expected, abs=1e-9)


def test_scores_must_rise(spark):
    for method in ("quadratic", "natural", "pchip", "akima", "catmull", "cubic"):
        n = 3 if method in ("quadratic", "natural") else 4
        assert value(spark, method, [72.9709, 88.0, 85.7452, 92.4354][:n], [4, 3, 2, 1][:n], 86.0) is None


def test_searches_end_in_the_band(spark):
    cases = {
        1: [(35, 80.08)], 2: [(17, 80.03), (35, 65.73)], 3: [(17, 83.15), (22, 80.02), (35, 71.94)], 4: [(17, 85.81), (30, 80.92), (32, 80.01), (35, 78.05)],
        5: [(35, 83.31), (53, 81.22), (55, 80.03), (61, 73.56), (64, 67.56)], 6: [(35, 86.99), (53, 84.41), (57, 82.47), (59, 81.14), (60, 80.09), (61, 78.58), (69, 68.57), (70, 64.90)],
    }
    expected = {1: [35], 2: [35, 17], 3: [35, 17, 22], 4: [35, 17, 30, 32], 5: [35, 53, 64, 61, 55], 6: [35, 53, 70, 69, 61, 57, 59, 60]}
    curve = spark.createDataFrame([(k, float(a), b) for k, v in cases.items() for a, b in v], "case int, setting double, score double")
    policy = spark.createDataFrame([(k, 1, 70, 79.5, 80.5, 1.0, 10) for k in cases], "case int, min_q int, max_q int, low double, high double, step double, probes int")
    for row in search.search(curve, policy, ["case"]).collect():
        assert [h.setting for h in row.history] == expected[row.case]
        assert row.reason == "within band" and 79.5 <= row.history[-1].score <= 80.5


def test_final_choice_falls_back_to_the_nearest(spark):
    rows = [("in", 0, 10.0, 50.0), ("in", 1, 20.0, 41.0), ("in", 2, 15.0, 40.0), ("out", 0, 10.0, 50.0), ("out", 1, 30.0, 30.0), ("out", 2, 12.0, 50.0)]
    measured = spark.createDataFrame(rows, "k string, probe_no int, setting double, score double")
    policy = spark.createDataFrame([("in", 39.0, 41.0), ("out", 39.0, 41.0)], "k string, low double, high double")
    got = {r.k: (r.setting, r.score, r.in_band) for r in search.final_choice(measured, policy, ["k"]).collect()}
    assert got == {"in": (20.0, 41.0, True), "out": (10.0, 50.0, False)}


def test_statistics_at_the_edges(spark):
    df = spark.createDataFrame([("a", 0, 2.4), ("a", 1, 2.6), ("a", 2, 3.4), ("a", 3, 0.0), ("b", 0, 7.0)], "g string, pos int, x double")
    got = {r.g: r for r in df.groupBy("g").agg(stats.harmonic_mean(F.col("x")).alias("h"), stats.clamped_sigma(F.col("x"), 9.0).alias("s")).collect()}
    assert got["a"].h == 0.0 and got["b"].h == 7.0 and got["a"].s == 3.4 and got["b"].s == 7.0
    assert {r.g: r.mode for r in stats.first_mode(df, ["g"], "x", "pos").collect()} == {"a": 2.6, "b": 7.0}  # 2.6 and 3.4 share the bucket 3
    for form in (False, True):
        p = {r.g: r for r in stats.percentiles(df, ["g"], "x", [1, 99, 100], small_groups=form).collect()}
        assert (p["a"].p1, p["a"].p99, p["a"].p100) == (0.0, 3.4, 0.0)


def test_nan_is_rejected_and_infinity_kept(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    good, bad = stats.reject_nan(df, "x")
    assert good.count() == 2 and bad.count() == 1
    row = spark.range(1).select(stats.weighted_log(F.lit(float("inf")), F.lit(float("inf")), F.lit(float("inf"))).alias("w")).first()
    assert row.w == float("inf")


@pytest.mark.parametrize(
    ("kind", "line", "expected"),
    [
        ("rav1e", "encoded 12207 frames, 126.416 fps, 16.32 Kb/s, elap. time: 1m 36s", 12207), ("rav1e", "encoded xxxx frames, 126.416 fps", None), ("rav1e", "invalid", None),
        ("x264", "2448732 frames: 39.11 fps, 14.60 kb/s", 2448732), ("x265", "[42.5%] 121/285 frames, 2.47 fps, 1445.28 kb/s, eta 0:01:06", 121),
        ("svt-av1", "Encoding frame 53298734 1.08 kbps 2.00 fps", 53298734), ("svt-av1", "Encoding:   55 Frames @ 7.05 fps | 681.56 kb/s", 55), ("svt-av1", "\x1b[33mEncoding:  \x1b[0m24/171 Frames", 24),
        ("aom", "Pass 1/1 frame    3/2       2131B    5997 us 500.25 fps [ETA  unknown]", 2), ("vpx", "Pass 1/1 frame 1022621/1022611 136473850B  131502 ms", 1022611), ("aom", "", None), ("x264", "nothing", None),
    ],
)
def test_progress_lines(spark, kind, line, expected):
    assert spark.range(1).select(finished(F.lit(kind), F.lit(line)).alias("n")).first().n == expected


def test_increments_never_take_back(spark):
    random.seed(3)
    rows = [("u", i, random.randint(0, 50)) for i in range(200)]
    got = ledger.increments(spark.createDataFrame(rows, "u string, i int, done int"), ["u"], ["i"]).agg(F.sum("increment"), F.max("done")).first()
    assert got[0] == got[1]


def test_projection_of_nothing_is_nothing(spark):
    done = spark.createDataFrame([(0, 0)], "done_elements long, done_bytes long")
    row = ledger.projection(done, F.lit(24.0), F.lit(100), F.lit(5.0)).first()
    assert row.kbps is None and row.progress is None and row.estimated_bytes is None


def test_manifests(spark):
    names = F.array(F.lit("00000.ivf"), F.lit("00001.ivf"))
    row = spark.range(1).select(
        ledger.merge_options(names, F.lit("output.mkv"), None, F.lit("30/1")).alias("plain"), ledger.merge_options(names, F.lit("output.mkv"), F.lit("audio.mkv"), F.lit("30/1")).alias("side"),
        ledger.file_list(F.array(F.lit("b c"), F.lit("a'x"))).alias("files"), settings.unit_name(F.lit(1)).alias("one"), settings.unit_name(F.lit(123456)).alias("many"),
    ).first()
    assert row.plain == '["-o", "output.mkv", "--default-duration", "0:30/1fps", "[", "00000.ivf", "00001.ivf","]"]'
    assert row.side == '["-o", "output.mkv", "audio.mkv", "--default-duration", "0:30/1fps", "[", "00000.ivf", "00001.ivf","]"]'
    assert row.files == "file a\\'x\nfile b\\ c\n" and row.one == "00001" and row.many == "123456"


def test_versions(spark):
    texts = ["SVT-AV1 v0.8.7-333-g010c1881 (release)", "v0.9.0-dirty", "v3.2.11", "invalid"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(settings.version(F.col("t")).alias("v")).collect()
    assert [tuple(r.v) if r.v else None for r in got] == [(0, 8, 7), (0, 9, 0), (3, 2, 11), None]


def test_option_names(spark):
    helps = [
        ("x265", "-m/--level <n> -w/--[no-]weight  --[no-]-hrd text --crf=<f> -"), ("vpx", "--rate- --target=<arg> -- --two-pass"), ("aom", "  -o <arg>, --output=<arg>  -: --good"),
    ]
    got = match.vocabulary(spark.createDataFrame(helps, "kind string, help string")).collect()
    by = {k: {r.param for r in got if r.kind == k} for k in ("x265", "vpx", "aom")}
    assert by["x265"] == {"-m", "--level", "-w", "--weight", "--no-weight", "--hrd", "--no-hrd", "--crf"}
    assert by["vpx"] == {"--rate", "--target", "--two-pass"} and by["aom"] == {"-o", "--output", "--good"}


def test_option_names_word_by_word(spark):
    """Names as words give them one after the other, with dashes and signs in all places."""
    rng = random.Random(3)
    texts = [(k, "".join(rng.choice("--ab_9!=é \t\n") for _ in range(rng.randrange(40)))) for k in ("aom", "vpx", "other") for _ in range(400)] + [("vpx", None)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, kind string, help string")
    for r in df.select("i", match.option_names(F.col("help"), F.col("kind")).alias("n")).collect():
        kind, text = texts[r.i]
        if text is None:
            assert r.n is None
            continue
        want = []
        for w in re.split(r"[ \t\n\r\f]+", text):
            head = re.match("[-_0-9A-Za-z]*", w)[0]
            if w.startswith("-") and w not in ("-", "--") and (head == w or len(head) > 1):
                want.append(re.sub("-$", "", w) if head == w and kind == "vpx" else head)
        assert r.n == list(dict.fromkeys(want)), (kind, text)


def test_names_are_found_in_one_pass(spark):
    """One expression over a text, not some for each of its words, but for the kind whose words name two options."""
    plan = spark.range(1).select(match.option_names(F.col("id").cast("string"), F.lit("aom")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan


def test_nearest_known_name(spark):
    used = spark.createDataFrame([("--speeed",), ("--qqq",)], "param string")
    known = spark.createDataFrame([("--speed",), ("--spread",), ("--tune",)], "param string")
    got = match.suggestions(match.unknown(used, known, ["param"]), known, "param").collect()
    assert [(r.param, r.suggestion) for r in got] == [("--speeed", "--speed")]
    pairs = [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("crf", "xrf", 0.7778), ("abcd", "abcdefghij", 0.88), ("a", "b", 0.0), ("", "", 1.0), ("", "x", 0.0)]
    got = match.jaro_winkler(match._codes([p[0] for p in pairs]), match._codes([p[1] for p in pairs]))
    assert got == pytest.approx([p[2] for p in pairs], abs=1e-4)
    first = match.suggestions(spark.createDataFrame([("--xrf",), ("zpeed",), (None,)], "param string"), spark.createDataFrame([("--crf",), ("speed",), (None,)], "param string"), "param")
    assert {(r.param, r.suggestion) for r in first.collect()} == {("--xrf", "--crf"), ("zpeed", "speed")}


def test_splines_of_any_length(spark):
    random.seed(2)
    rows = []
    for k, n in enumerate((2, 3, 4, 9, 25)):
        x = sorted(random.sample(range(200), n))
        rows += [(k, float(a), random.random() * 50) for a in x]
    measured = spark.createDataFrame(rows, "k int, score double, setting double")
    asked = spark.createDataFrame([(k, float(t)) for k in range(5) for t in range(0, 200, 7)] + [(r[0], r[1]) for r in rows], "k int, target double")
    got = {(r.k, r.target): r.setting for r in search.natural_splines(measured, asked, ["k"]).collect()}
    points = {k: [(s, y) for kk, s, y in rows if kk == k] for k in range(5)}
    assert all(v is None for (k, _), v in got.items() if k == 0)
    for k in (1, 2):  # the closed forms
        for (kk, t), v in got.items():
            if kk == k:
                want = value(spark, "natural", *zip(*points[k], strict=True), t)
                assert (v is None and want is None) or v == pytest.approx(want, abs=1e-9)
    for k in (3, 4):
        assert all(got[k, s] == pytest.approx(y, abs=1e-9) for s, y in points[k])


def test_policies(spark):
    raw = spark.createDataFrame([("80-85", "10-50", "3", "percentile=1", "linear-akima", "1280x720"), ("90", None, None, None, None, None), ("85-80", None, None, None, None, None)], "target string, limits string, probes string, statistic string, methods string, resolution string")
    good, bad = settings.normalised_policies(raw)
    rows = {r.target: r for r in good.collect()}
    assert rows["80-85"].warning == "fewer than 4 probes" and rows["80-85"].method_4 == "akima" and (rows["80-85"].width, rows["80-85"].height) == (1280, 720)
    assert (rows["90"].low, rows["90"].high) == pytest.approx((89.1, 90.9)) and bad.count() == 1
