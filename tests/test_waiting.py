"""Waiting elements in a map of the state: the same segments as with arrays, over restarts, and from a state that a batch has left."""

import random

import pandas as pd
import pytest

from cutline.streaming import streams, waiting

from .test_streams import feed

SCHEMA = "k string, t long, v double"


@pytest.fixture
def rocksdb(spark):
    before = waiting.use_rocksdb(spark)
    yield
    spark.conf.set(waiting.PROVIDER, before) if before else spark.conf.unset(waiting.PROVIDER)


def shuffled(seed=9, n=80):
    rng = random.Random(seed)
    values = [float(rng.choice([0, 0, 50])) for _ in range(n)]
    return [(k, i, values[i]) for i in sorted(range(n), key=lambda i: i + rng.randint(0, 5)) for k in ("a", "b")]


@pytest.mark.parametrize("late", [6, 0])
def test_map_state_gives_the_same_segments(spark, tmp_path, rocksdb, late):
    rows, found = shuffled(), []
    for name, form in (("array", streams.segments), ("map", waiting.segments)):
        stream = feed(spark, rows, SCHEMA, tmp_path / f"in-{name}", 4)
        out = streams.run_once(form(stream, "k", "t", "t", "v", 40.0, 4, late), str(tmp_path / f"out-{name}"), str(tmp_path / f"cp-{name}"))
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] and len(found[0]) > 5


def test_restarts_and_states_from_a_batch(spark, tmp_path, rocksdb):
    rows = [("a", i, float(50 * (i // 5 % 2))) for i in range(60)]
    paths = [str(tmp_path / x) for x in ("out", "cp")]
    for part in (rows[:23], rows[23:40], rows[40:]):  # three runs of one stream
        stream = feed(spark, part, SCHEMA, tmp_path / "in", 1)
        out = streams.run_once(waiting.segments(stream, "k", "t", "t", "v", 40.0, 4, 3), *paths)
    want = [(a, a + 5) for a in range(0, 55, 5)]
    assert sorted((r.start, r.end) for r in streams.closed(out).collect()) == want[: len(range(0, 56 - 5, 5))]
    begun = spark.createDataFrame([("a", 23, 20, rows[22][2], 22)], "k string, pos long, cut long, last double, upto long")
    stream = feed(spark, rows[23:], SCHEMA, tmp_path / "rest", 2)
    late = streams.run_once(waiting.segments(stream, "k", "t", "t", "v", 40.0, 4, 3, begun=begun), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert sorted((r.start, r.end) for r in streams.closed(late).collect()) == [w for w in want if w[1] >= 25][:-1] + [w for w in want if w[1] >= 25][-1:]


class Store:
    """A state that counts what it is asked for."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        Store.calls += 1
        return {
            "exists": lambda: "value" in self.held, "get": lambda: self.held["value"], "update": lambda v: self.held.update(value=v), "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k],
            "updateValue": lambda k, v: self.held.update({k: v}), "removeKey": lambda k: self.held.pop(k), "keys": lambda: iter([*self.held]), "iterator": lambda: iter([*self.held.items()]),
        }[name]


def test_what_is_ripe_at_once_never_enters_the_state():
    one = waiting._Series("k", 40.0, 4, 6, None)
    one.done, one.waiting, one.newest = Store(), Store(), Store()
    found = []
    for part in (range(0, 3000), range(3000, 3010), [3008, 3008]):
        batch = pd.DataFrame({"place_": list(part), "tie_": list(part), "value_": [float(50 * (i // 5 % 2)) for i in part]})
        found += [(int(a), int(b)) for out in one.handleInputRows(("a",), iter([batch]), None) for a, b in zip(out["start"], out["end"], strict=True)]
    assert Store.calls < 60
    assert found == [(a, a + 5) for a in range(0, 3000, 5)]
    assert one.waiting.held[(3008, 3008)] == (50.0, 3) and len(one.waiting.held) == 6
