"""Streams fed file by file, against what one batch gives."""

import random

import pandas as pd
from pyspark.sql import functions as F

from cutline.operators import ledger
from cutline.plans import stream_queries
from cutline.streaming import streams


def feed(spark, rows, schema, folder, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_segments_over_several_batches(spark, tmp_path):
    random.seed(4)
    rows = [(k, i, float(random.choice([0, 0, 0, 50]))) for i in range(60) for k in ("a", "b")]
    stream = feed(spark, rows, "k string, t int, v double", tmp_path / "in", 3)
    got = streams.closed(streams.run_once(streams.segments(stream, "k", "t", "t", "v", 40.0, 4), str(tmp_path / "out"), str(tmp_path / "cp")))
    want = set()
    for k in ("a", "b"):
        values, cut = [v for kk, _, v in rows if kk == k], 0
        for i in range(1, len(values)):
            if abs(values[i] - values[i - 1]) >= 40 and i - cut >= 4:
                want.add((k, cut, i))
                cut = i
    assert {tuple(r) for r in got.collect()} == want


def test_elements_wait_for_earlier_ones(spark, tmp_path):
    """Batches bring elements up to five steps out of order: with patience for them nothing is late, and the segments are those of the whole order; without, late ones stand aside."""
    rng = random.Random(9)
    values = [float(rng.choice([0, 0, 50])) for _ in range(80)]
    shuffled = sorted(range(80), key=lambda i: i + rng.randint(0, 5))
    rows = [("a", i, values[i]) for i in shuffled]
    for patience in (6, 0):
        stream = feed(spark, rows, "k string, t long, v double", tmp_path / f"in{patience}", 4)
        out = streams.run_once(streams.segments(stream, "k", "t", "t", "v", 40.0, 4, patience), str(tmp_path / f"out{patience}"), str(tmp_path / f"cp{patience}"))
        late, upto = [], -1
        for batch in (rows[i : i + 20] for i in range(0, 80, 20)):
            late += [t for _, t, _ in batch if t < upto]
            upto = max(upto, max(t for _, t, _ in batch) - patience) if patience == 0 else upto
        assert sorted(r["at"] for r in streams.late_elements(out).collect()) == sorted(late)
        if patience:
            taken, cut, want = range(80 - patience), 0, set()
            for i in taken[1:]:
                if abs(values[i] - values[i - 1]) >= 40 and i - cut >= 4:
                    want.add((cut, i))
                    cut = i
            assert {(r.start, r.end) for r in streams.closed(out).collect()} == want


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    stream = feed(spark, [("a", 1), ("b", 2)], "k string, n long", tmp_path / "in", 1)
    assert streams.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).count() == 2
    again = feed(spark, [], "k string, n long", tmp_path / "in", 1)
    assert streams.run_once(again, str(tmp_path / "out"), str(tmp_path / "other")).count() == 2


def test_progress_ignores_late_and_repeated_lines(spark, tmp_path):
    rows = [("u", "rav1e", f"encoded {n} frames, x") for n in (5, 9, 7, 9, 12, 3)] + [("w", "x264", "noise")]
    stream = feed(spark, rows, "unit string, kind string, line string", tmp_path / "in", 3)
    got = streams.run_once(streams.progress(stream, ["unit"]), str(tmp_path / "out"), str(tmp_path / "cp"), mode="update", latest_by=["unit"])
    assert [tuple(r) for r in got.collect()] == [("u", 12)]


def test_projection_of_stream_totals(spark, tmp_path):
    rows = [("s", 10, 100), ("s", 30, 500), ("r", 5, 50)]
    stream = feed(spark, rows, "series string, n_elements long, size_bytes long", tmp_path / "in", 2)
    got = streams.run_once(streams.projection(stream, ["series"]), str(tmp_path / "out"), str(tmp_path / "cp"), mode="update", latest_by=["series"])
    row = ledger.projection(got.filter("series = 's'"), F.lit(20.0), F.lit(80), F.lit(7.0)).first()
    assert (row.done_elements, row.progress, row.estimated_bytes, row.kbps) == (40, 0.5, 1207.0, 600 * 8 / 1000 / 2)


class State:
    """The state of one group, outside of a stream."""

    exists, hasTimedOut, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_groups_without_news_write_nothing(monkeypatch, spark):
    """No frame for a group of which there is nothing to tell: a stream of very many series would be made of them."""
    steps = []
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandasWithState", lambda self, step, *rest: steps.append(step), raising=False)
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandasWithState", lambda self, step, *rest: steps.append(step))
    rows = spark.createDataFrame([("a", 1, 1.0, False)], "k string, t long, v double, f boolean")
    streams.segments(rows, "k", "t", "t", "v", 40.0, 4)
    streams.net_progress(rows, "k", "t", "v", "f")
    cut, net = steps
    state = State()
    assert list(cut(("a",), iter([pd.DataFrame({"_ts": [1, 2], "_tie": [1, 2], "_value": [1.0, 2.0]})]), state)) == []
    state = State()
    report = lambda t, d, f=False: iter([pd.DataFrame({"_order": [t], "_done": [d], "_failed": [f]})])
    assert [len(x) for x in net(("a",), report(1, 5), state)] == [1] and list(net(("a",), report(2, 5), state)) == []
    assert [x["increment"][0] for x in net(("a",), report(3, None, True), state)] == [-5] and state.get == (3, 0, [], [])


def test_halves_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).withColumnRenamed("id", "event_id").repartition(4)
    seen = stream_queries._by_halves(rows, "test", lambda stream: stream.select("event_id", F.input_file_name().alias("file")))
    assert sorted(r.event_id for r in seen.collect()) == list(range(40)) and seen.select("file").distinct().count() > 2
