"""Golden lists and properties of segments; brute-force twins of the folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import segments as s
from cutline.sources import readers

TEN = [0, 150, 460, 728, 822, 876, 890, 1100, 1399, 1709, 2000]


def table(spark, borders, limits=None):
    rows = [("a", i, b, e, (limits or {}).get(b)) for i, (b, e) in enumerate(zip(borders, borders[1:], strict=False))]
    return spark.createDataFrame(rows, "k string, seg_idx int, start long, end long, own long")


@pytest.mark.parametrize(
    ("borders", "limit", "own", "expected"),
    [
        ([0, 300], 240, {}, [0, 150]),
        (TEN, 130, {}, [0, 75, 150, 253, 356, 460, 549, 638, 728, 822, 876, 890, 995, 1100, 1199, 1299, 1399, 1502, 1605, 1709, 1806, 1903]),
        (TEN, 130, {460: 50, 1399: 130}, [0, 75, 150, 253, 356, 460, 504, 549, 594, 638, 683, 728, 822, 876, 890, 995, 1100, 1199, 1299, 1399, 1502, 1605, 1709, 1806, 1903]),
        ([0, 300], 0, {}, [0]),
    ],
)
def test_even_splits(spark, borders, limit, own, expected):
    got = s.even_splits(table(spark, borders, own), ["k"], F.coalesce("own", F.lit(limit))).orderBy("start").collect()
    assert [r.start for r in got] == expected and [r.end for r in got] == [*expected[1:], borders[-1]]
    assert [r.seg_idx for r in got] == list(range(len(expected)))


def test_spacing_agrees_with_a_loop(spark):
    random.seed(1)
    rows = [(k, p, random.choice([3]), 0) for k in range(6) for p in random.sample(range(1, 200), 60)]
    df = spark.createDataFrame(rows, "k int, pos long, min_len long, scope_start long")
    expected = set()
    for k in range(6):
        last = 0
        for p in sorted(r[1] for r in rows if r[0] == k):
            if p - last >= 3:
                expected.add((k, p))
                last = p
    assert {tuple(r) for r in s.spaced(df, ["k"]).collect()} == expected


def guided(start, end, limit, scores):
    at = sorted(scores)
    return s.guided_cuts(start, end, limit, np.array(at, np.int64), np.array([scores[p] for p in at], float))


def test_guided_cuts():
    assert guided(0, 10, 4, {}) == [3, 6]  # even pieces where nothing is scored
    assert guided(0, 8, 4, {2: 1.0, 4: 0.9})[0] in (2, 4)
    assert guided(0, 10, 6, {4: 1.0, 6: 1.0}) == [6]  # as good: the larger piece
    assert guided(0, 6, 4, {2: 0.000076, 3: 0.00004}) == [2]  # in units of a ten-thousandth, halves up: 1 and 0
    cuts = guided(0, 1000, 7, {p: random.random() for p in range(1000)})
    borders = [0, *cuts, 1000]
    assert all(0 < b - a <= 7 for a, b in zip(borders, borders[1:], strict=False))


def test_guided_splits_walk_over_segments(spark):
    """Many series in few partitions, scores on borders, thresholds of 0, against the cuts of each segment alone."""
    random.seed(3)
    segments, costs, expected = [], [], set()
    for k in range(12):
        borders = sorted({0, *random.sample(range(1, 200), 5), 200})
        scores = {p: random.choice([0.0, 0.5, 1.0, random.random()]) for p in range(1, 200) if random.random() < 0.6}
        costs += [(k, p, x, 1.0) for p, x in scores.items()] + [(k, 7, 1.0, 0.0), (k, 8, None, 1.0)]
        for i, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
            segments.append((k, i, a, b))
            expected |= {(k, p) for p in [a, *guided(a, b, 9, {p: x for p, x in scores.items() if a < p < b})]}
    df = spark.createDataFrame(segments, "k int, seg_idx int, start long, end long")
    scored = spark.createDataFrame([r for r in costs if (r[1] != 7 or r[3] == 0.0) and (r[1] != 8 or r[2] is None)], "k int, pos long, inter_cost double, threshold double")
    expected = set()
    usable = {(r[0], r[1]): r[2] for r in scored.collect() if r[2] is not None and r[3]}
    for k, _, a, b in segments:
        expected |= {(k, p) for p in [a, *guided(a, b, 9, {p: x for (j, p), x in usable.items() if j == k and a < p < b})]}
    assert {(r.k, r.start) for r in s.guided_splits(df, scored, ["k"], F.lit(9)).collect()} == expected


def test_pipeline_covers_and_bounds(spark):
    random.seed(5)
    lengths = {k: random.randint(1, 120) for k in range(20)}
    info = spark.createDataFrame(list(lengths.items()), "k int, n_elements long")
    costs = spark.createDataFrame([(k, p, random.random(), 0.8) for k, n in lengths.items() for p in range(1, n)] or [], "k int, pos long, inter_cost double, threshold double")
    overrides = spark.createDataFrame([(k, 5, 12, 3, 2) for k, n in lengths.items() if n > 12], "k int, start long, end long, max_len long, min_len long")
    found, split = s.segment(info, ["k"], costs, 4, 10, overrides)
    for df, most in ((found, None), (split, 10)):
        by = {}
        for r in df.collect():
            by.setdefault(r.k, []).append((r.start, r.end))
        assert set(by) == set(lengths)
        for k, spans in by.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == lengths[k]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
            assert most is None or all(e - b <= most for b, e in spans)


def test_forced_cuts_on_borders_and_outside(spark):
    seg = table(spark, [0, 10, 20])
    cuts = spark.createDataFrame([("a", 10), ("a", 15), ("a", 15), ("a", 99), ("b", 1)], "k string, pos long")
    good, bad = s.forced(seg, cuts, ["k"])
    assert [(r.start, r.end) for r in good.orderBy("start").collect()] == [(0, 10), (10, 15), (15, 20)]
    assert {(r.k, r.pos) for r in bad.collect()} == {("a", 99), ("b", 1)}


def test_options_are_merged(spark):
    df = spark.createDataFrame([({"--cq": "40", "--speed": "0"}, {"--cq": "20"}, False), ({"--cq": "40"}, {"--q": "1"}, True), (None, None, None)], "b map<string,string>, o map<string,string>, r boolean")
    got = [r.m for r in df.select(s.merged_options(F.col("b"), F.col("o"), F.col("r")).alias("m")).collect()]
    assert got == [{"--cq": "20", "--speed": "0"}, {"--q": "1"}, {}]


def test_override_lines(spark):
    lines = [
        "45 729 aom --cq-level=20 --photon-noise 4 -x 60 --min-scene-len 12", "45 729 rav1e reset --speed 6 --photon-noise 4", "5000 -1 x264 reset", "729 1337 rav1e -s 3 -q 45", "2459 5000 rav1e",
        "5000 -1 rav1e reset", "", "nonsense", "0 -1 svt-av1 reset --preset 3 --probe-res 1280x720 --interp-method natural-cubic",
    ]
    df = spark.createDataFrame([("s", x) for x in lines], "series string, line string")
    good, bad = readers.overrides(df, F.lit(6900).cast("long"))
    assert [r.line for r in bad.collect()] == ["nonsense"]
    rows = {r.line: r for r in good.collect()}
    assert rows[lines[0]].options == {"--cq-level": "20", "--photon-noise": "4", "-x": "60", "--min-scene-len": "12"} and rows[lines[0]].end == 729
    assert rows[lines[5]].end == 6900 and rows[lines[5]].reset and rows[lines[5]].options == {}
    assert rows[lines[8]].options["--interp-method"] == "natural-cubic"
    info = df.select("series", F.lit(6900).cast("long").alias("n_elements")).distinct()
    formats = F.create_map(*(F.lit(x) for k in readers.KINDS for x in (k, "annexb" if k in ("x264", "x265") else "ivf")))
    _, rejected = s.checked(good, info, ["series"], F.lit("aom"), formats)
    assert {r.line: r.reject_reason for r in rejected.collect()} == {
        "5000 -1 x264 reset": "incompatible format", "729 1337 rav1e -s 3 -q 45": "change of kind without reset", "2459 5000 rav1e": "change of kind without reset",
    }


def test_attach_with_and_without_cells(spark):
    e = spark.createDataFrame([("a", p) for p in range(40)] + [("b", 3)], "k string, pos long")
    o = spark.createDataFrame([("a", 5, 9, 1), ("a", 9, 30, 2)], "k string, start long, end long, x int")
    want = sorted((("a", p, 1 if 5 <= p < 9 else 2 if 9 <= p < 30 else -1) for p in range(40))) + [("b", 3, -1)]
    for width in (None, 7):
        got = s.attached(e, o, ["k"], width=width).select("k", "pos", F.coalesce("x", F.lit(-1))).collect()
        assert sorted(map(tuple, got)) == want


def test_empty_tables(spark):
    info = spark.createDataFrame([], "k string, n_elements long")
    cuts = spark.createDataFrame([], "k string, pos long")
    assert s.from_cuts(cuts, info, ["k"]).count() == 0
    assert s.even_splits(s.from_cuts(cuts, info, ["k"]), ["k"], F.lit(3)).count() == 0
