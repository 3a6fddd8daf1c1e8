"""Readers and writers on files."""

import json

from pyspark.sql import functions as F

from cutline.sources import readers, writers


def test_scores_and_keys(spark, tmp_path):
    (tmp_path / "clip.json").write_text(json.dumps({"frames": [{"metrics": {"vmaf": 90.5}}, {"metrics": {"vmaf": 80.25}}]}))
    got = readers.element_scores(spark, str(tmp_path)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("clip", 0, 90.5), ("clip", 1, 80.25)]


def test_channel_log(spark, tmp_path):
    log = "n: 1  XPSNR y: 41.5  XPSNR u: 44.1  XPSNR v: inf\nn: 2  XPSNR y: 40  XPSNR u: 1.2.3  XPSNR v: 42\nXPSNR average, 2 frames  y: 40.7  u: 44.0  v: inf  (minimum: 40.7)\n"
    (tmp_path / "good.log").write_text(log)
    (tmp_path / "bad.log").write_text("nothing here\n")
    elements, averages, rejects = readers.channel_log(spark, str(tmp_path))
    inf = float("inf")
    assert [(r.pos, r.y, r.u, r.v) for r in elements.orderBy("pos").collect()] == [(0, 41.5, 44.1, inf), (1, 40.0, inf, 42.0)]
    assert [tuple(r) for r in averages.collect()] == [("good", 40.7, 44.0, inf)]
    assert [r.series_id for r in rejects.collect()] == ["bad"]


def test_channel_log_of_a_long_series_has_several_files_in_order(spark, tmp_path):
    """No task sorts a whole series, neither to write nor to read it."""
    rows = spark.range(4000).select(F.when(F.col("id") < 3990, "long").otherwise("short").alias("series_id"), F.when(F.col("id") < 3990, F.col("id")).otherwise(F.col("id") - 3990).alias("pos"), (F.col("id") % 97 + 1.5).alias("y"), F.lit(2.0).alias("u"), F.lit(float("inf")).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps small partitions apart
    try:
        writers.channel_log(rows, str(tmp_path / "log"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    files = sorted((tmp_path / "log" / "series_id=long").glob("*.txt"))
    text = "".join(f.read_text() for f in files).splitlines()
    assert len(files) > 1 and [int(t.split()[1]) for t in text[:-1]] == list(range(1, 3991)) and text[-1].startswith("XPSNR average, 3990")
    elements, averages, rejects = readers.channel_log(spark, str(tmp_path / "log"))
    assert {tuple(r) for r in elements.collect()} == {tuple(r) for r in rows.collect()}
    assert averages.count() == 2 and rejects.count() == 0
    windows = elements._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in windows


def test_segments_and_ledger(spark, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "a.json").write_text(json.dumps({"frames": 9, "scenes": [{"start_frame": 0, "end_frame": 9}], "split_scenes": [{"start_frame": 0, "end_frame": 4, "zone_overrides": {"extra_splits_len": 5}}, {"start_frame": 4, "end_frame": 9}]}))
    (tmp_path / "new" / "old.json").write_text(json.dumps({"frames": 7, "scenes": [{"start_frame": 0, "end_frame": 7}]}))
    got = {(r.series_id, r.seg_idx, r.start, r.end, r.max_len) for r in readers.segments(spark, str(tmp_path / "new")).collect()}
    assert got == {("a", 0, 0, 4, 5), ("a", 1, 4, 9, None), ("old", 0, 0, 7, None)}
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "a.json").write_text(json.dumps({"frames": 0, "done": {"00000": {"frames": 4, "size_bytes": 10}, "00001": {"frames": 5, "size_bytes": 20}}, "audio_done": True}))
    units, totals = readers.ledger(spark, str(tmp_path / "done"))
    assert {(r.unit, r.n_elements, r.size_bytes) for r in units.collect()} == {("00000", 4, 10), ("00001", 5, 20)}
    assert totals.first().total == 9
    listed = readers.files(spark, str(tmp_path / "new"))
    assert {r.file_name for r in listed.collect()} == {"a.json", "old.json"}


def test_queue_and_latest(spark, tmp_path):
    units = spark.createDataFrame([("a", 0, 0, 5, 24.0, 1, ["--x"], None)], readers.QUEUE)
    writers.queue(units, str(tmp_path / "q"))
    assert readers.queue(spark, str(tmp_path / "q")).first() == units.first()
    for at, size in ((1, 10), (2, 30)):
        writers.append_ledger(spark.createDataFrame([("a", "00000", at, size)], "series_id string, unit string, at int, size_bytes long"), str(tmp_path / "l"))
    assert writers.latest(spark.read.parquet(str(tmp_path / "l")), ["series_id", "unit"], "at").first().size_bytes == 30


def test_segments_json_comes_back(spark, tmp_path):
    split = spark.createDataFrame([("a", 0, 0, 4), ("a", 1, 4, 9)], "series_id string, seg_idx int, start long, end long")
    info = spark.createDataFrame([("a", 9)], "series_id string, n_elements long")
    document = writers.segments_json(split, split, info).first().document
    (tmp_path / "a.json").write_text(document)
    assert [(r.start, r.end) for r in readers.segments(spark, str(tmp_path)).orderBy("seg_idx").collect()] == [(0, 4), (4, 9)]


def test_progress_lines_end_with_carriage_returns(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes(b"encoded 1 frames\rencoded 2 frames\r")
    assert [r.line for r in readers.progress_lines(spark, str(tmp_path)).collect()] == ["encoded 1 frames", "encoded 2 frames"]
