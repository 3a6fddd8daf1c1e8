"""A growing log read at once and as a stream, by ranges of bytes of any size."""

import random

import pytest
from pyspark.sql import functions as F

from cutline.sources import growing
from cutline.streaming import streams


def lines_of(data, sep="\r"):
    at, out = 0, []
    for line in data.decode("utf-8", "replace").split(sep)[:-1]:
        out.append((at, line))
        at += len(line.encode()) + 1
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_ranges_hold_each_line_once(spark, tmp_path, size):
    rng = random.Random(size)
    growing.register(spark)
    want = set()
    for k in range(3):
        data = "".join(rng.choice(["encoded 5 frames", "", "é" * 5, "x" * 30]) + "\r" for _ in range(40 if size > 1 else 6)) + "unfinished"
        (tmp_path / f"series={k}").mkdir()
        (tmp_path / f"series={k}" / "log.txt").write_bytes(data.encode())
        want |= {(f"series={k}/log.txt", *x) for x in lines_of(data.encode())}
    (tmp_path / "series=0" / "_other").write_text("hidden\r")
    (tmp_path / "empty.txt").write_text("")
    df = spark.read.format("growing_log").option("lineSep", "\r").option("rangeBytes", size).load(str(tmp_path))
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert spark.read.format("growing_log").load(str(tmp_path / "none")).count() == 0


def test_stream_of_a_growing_log_goes_on_after_a_restart(spark, tmp_path):
    growing.register(spark)
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    text = "".join(f"encoded {k} frames\r" for k in range(50)).encode()
    seen = []
    for upto in (33, 400, 401, len(text)):  # in the midst of lines
        (folder / "a.log").write_bytes(text[:upto])
        if upto == 400:
            (folder / "b.log").write_bytes(b"other\r")
        stream = spark.readStream.format("growing_log").option("lineSep", "\r").option("rangeBytes", 50).load(str(folder))
        seen.append(streams.run_once(stream, out, mark).count())
    assert seen == sorted(seen) and seen[0] < seen[-1]
    batch = spark.read.format("growing_log").option("lineSep", "\r").load(str(folder))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(streams.run_once(stream, out, mark)) == rows(batch) and batch.count() == 51
    assert batch.filter(F.col("file") == "a.log").orderBy("start").first().line == "encoded 0 frames"


def test_small_ranges_do_not_become_tasks_without_end(tmp_path):
    (tmp_path / "a.log").write_bytes(b"encoded 5 frames\r" * 50_000)
    (tmp_path / "b.log").write_bytes(b"encoded 5 frames\r" * 10)
    reader = growing.GrowingLog({"path": str(tmp_path), "lineSep": "\r", "rangeBytes": "16"}).reader(None)
    parts = reader.partitions()
    assert len(parts) <= growing.RANGES + 2 and sum(b.num_rows for p in parts for b in reader.read(p)) == 50_010
    stream = growing.GrowingLog({"path": str(tmp_path), "lineSep": "\r", "rangeBytes": "16"}).streamReader(None)
    assert len(stream.partitions(stream.initialOffset(), stream.latestOffset())) <= growing.RANGES + 2
