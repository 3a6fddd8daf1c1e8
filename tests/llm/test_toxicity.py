"""The kernel against its definition, the machine against its optimum, held-out accuracy, and awkward tables."""

import itertools
import math
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cutline.llm import common, queries, toxicity

from .data import PROSE, awkward, empty


def vector(unit):
    """Weights of all subsequences of three letters, as defined."""
    codes = [toxicity._EDGE, *toxicity.letters(unit), toxicity._EDGE]
    out = defaultdict(float)
    for i, j, k in itertools.combinations(range(len(codes)), 3):
        if k - i < toxicity.SPAN and codes[i] and codes[j] and codes[k]:
            out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i + 1)
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {k: v / norm for k, v in out.items()}


def twin_kernel(a, b):
    a, b = vector(a), vector(b)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_kernel_is_its_definition():
    units = ["idiot", "id-iot", "i.d.i.o.t", "1d10t", "a", "banana", "ünïté", "xyzxyzxyzxyz", "q" * 24, "no!ni"]
    got = toxicity.kernel(units, units)
    assert np.allclose(got, [[twin_kernel(a, b) for b in units] for a in units], atol=1e-5)
    assert got[0, 1] > 0.6 and got[0, 2] > got[0, 5] and abs(got[0, 3] - 1) < 1e-5


def test_long_units_are_taken_in_windows():
    assert toxicity.windows("1d") != [] and toxicity.windows("1" * 9 + "!") == [] and toxicity.windows("...") == [] and toxicity.windows("") == []
    for n in (24, 25, 36, 37, 100):
        rows = toxicity.windows("a" * n)
        assert all(len(r) <= toxicity.WINDOW + 2 for r in rows)
        covered = {a + k for r, a in zip(rows, range(0, n, toxicity.WINDOW // 2), strict=False) for k in range(len(r) - 2)}
        assert covered == set(range(n))
    assert toxicity.units_of("He is an I D\tI O T ok a b") == ["he", "is", "an", "i", "d", "i", "o", "t", "ok", "a", "b", "idiot"]


def test_newton_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(300, 4)), np.ones(300)]
    y, w = np.sign(x[:, 0] + 0.5 * rng.normal(size=300)), rng.random(300) + 0.1
    v = toxicity.squared_hinge(x, y, w)
    slack = np.maximum(0, 1 - y * (x @ v))
    gradient = np.r_[v[:-1], 1e-6 * v[-1]] - 2 * x.T @ (w * y * slack)
    assert np.abs(gradient).max() < 1e-6


def machine(seed=1):
    rng = random.Random(seed)
    clean = ["".join(rng.choices(["the", "er", "on", "an", "re", "ti", "ha"], k=rng.randrange(1, 4))) for _ in range(400)]
    return toxicity.Machine.fit(["idiot", "moron", "worthless"], [0.0, 0.0, 0.1], sorted(set(clean)), landmarks=40), clean


def test_weights_fold_into_triples():
    m, clean = machine()
    units = [*clean[:20], "idiot", "id*iot", "moooron"]
    folded = [m.offset + sum(v * float(m.table[(k[0] * 32 + k[1]) * 32 + k[2]]) for k, v in vector(u).items()) for u in units]
    assert np.allclose(m.decide(units), folded, atol=1e-4)
    gaps = m.decide(["id-iot", "i.d.i.o.t", "idxiot", "m_o_r_o_n", "worthxless"])
    assert (gaps > 0).all() and np.mean(m.decide(clean) > 0) < 0.01


def in_small_slices(monkeypatch):
    for name, value in (("LONG", 1 << 12), ("SLICE", 1 << 10), ("HELD", 1 << 11), ("REMEMBERED", 1 << 11)):
        monkeypatch.setattr(toxicity, name, value, raising=False)


def counted(batch):
    return {(r["unit"], r["before"], r["after"], r["toxic"]) for b in toxicity.places([batch]) for r in b.to_pylist()}


def test_slices_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=rng.choice([1, 1, 1, 5, 9, 40]))) for _ in range(3000)]
    texts = [None, "", " ", "x", "Idiot", " ".join(words), "\t\n".join(words[:1024]), " ".join("a B" for _ in range(3000)), "q" * 9000 + " id.iot", "Moron " + " ".join(words[:2000]) + " moron"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array([1, 0] * 5, pa.int32())})
    m, _ = machine()
    top, places = toxicity.Scorer(m).top(texts), counted(batch)
    twin = set()
    for t, y in zip(texts, batch.column("toxic").to_pylist(), strict=True):
        own = toxicity.units_of(t)
        twin |= {(u, own[i - 1] if i else "", "".join(own[i + 1 : i + 2]), y) for i, u in enumerate(own)}
    in_small_slices(monkeypatch)
    assert [u for x in toxicity.slices(texts[5]) for u in x] == toxicity.units_of(texts[5]) and max(map(len, toxicity.slices(texts[5]))) == 1 << 10
    assert places == counted(batch) == twin
    assert (toxicity.Scorer(m).top(texts) == top).all() and (top[:3] == -2).all() and top[9, 0] > top[9, 1]


def test_long_texts_are_not_held_unit_by_unit(monkeypatch):
    in_small_slices(monkeypatch)
    m, _ = machine()
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60_000))
    batch = pa.RecordBatch.from_pydict({"text": [text], "toxic": pa.array([1], pa.int32())})
    for run, most in ((lambda: toxicity.Scorer(m).top([text]), 18e6), (lambda: [b.num_rows for b in toxicity.places([batch])], 5e6)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def test_labelled_texts_without_units(spark):
    rows = [(i, f"you are an idiot {i} indeed" if i % 2 else f"the river runs {i} past old town") for i in range(200)]
    empties = [(1000 + i, t) for i, t in enumerate([None, "", " \t\n", None, ""])]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows + empties], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + empties, "doc_id long, text string")
    count = lambda d: {tuple(r) for r in toxicity.unit_counts(toxicity._labelled(d, labels, 1000)).collect()}
    assert count(docs) == count(docs.filter("doc_id < 1000")) != set()
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 205 and len({got[i].score for i, _ in empties}) == 1 and got[1].score > got[1000].score


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_holds_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = toxicity.op12_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len(rows) == common.table(spark, sf_dir, "documents").count()
    toxic = {r.doc_id: r.toxic for r in common.table(spark, sf_dir, "labels").collect()}
    seen = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(b for a, b in seen if a == 1) >= 0.5 * sum(a for a, _ in seen)  # a small table: few toxic texts of each language
    assert sum(b for a, b in seen if a == 0) <= 0.03 * len(seen)


def test_inserted_characters_are_tolerated(spark):
    rng = random.Random(2)
    words = ["the", "river", "runs", "under", "old", "bridges", "near", "town", "and", "people", "walk", "there", "every", "evening"]
    insults = ["idiot", "moron", "scoundrel"]

    def text(bad):
        out = rng.choices(words, k=30)
        for _ in range(3 if bad else 0):
            out.insert(rng.randrange(30), rng.choice(insults))
        return " ".join(out)

    rows = [(i, text(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    tried = ["the river and id-iot walk there, mo.ron", "people m o r o n and i d i o t walk", "old sco_undrel near idxiot", "the river runs under old bridges", "", None, "123 456"]
    got = {r.i: r for r in toxicity.score(spark.createDataFrame(list(enumerate(tried)), "i int, text string"), m).collect()}
    assert [got[i].predicted for i in range(7)] == [1, 1, 1, 0, 0, 0, 0]
    assert got[4].score == got[5].score == got[6].score


def test_toxicity_of_awkward_tables(spark, tmp_path):
    m, _ = machine()
    m.calibrate(np.array([[2.0, 1.0], [-1.5, -1.8], [-1.2, -1.3], [1.5, -1.0]]), np.array([1.0, 0, 0, 1]))
    docs = awkward(spark).withColumnRenamed("labels", "predicted")
    got = toxicity.score(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    same = [r.score for r in got if r.doc_id == 2]
    assert len(same) == 2 and same[0] == same[1]
    assert toxicity.score(empty(spark), m).count() == 0
    long = spark.createDataFrame([(1, PROSE * 20_000 + " idiot"), (2, "z" * 500_000)], "doc_id long, text string")
    assert [r.score > 0.3 for r in toxicity.score(long, m).orderBy("doc_id").collect()] == [True, False]
    for name in ("documents", "labels"):
        source = awkward(spark) if name == "documents" else spark.createDataFrame([(1, None, 0), (77, 1, 1)], "doc_id long, toxic int, quality int")
        source.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {r.score for r in queries.QUERIES["op12_toxicity"](spark, str(tmp_path)).collect()} == {0.0}
    with pytest.raises(common.NothingToLearn):
        toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
