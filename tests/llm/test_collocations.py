"""Phrases against plain counting, the sort against a dictionary, and awkward tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cutline.llm import collocations

from .data import PROSE, awkward, empty


def twin(rows, least, most, top):
    """The result by counting every phrase in a dictionary."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\v\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] = counts.get((lang, tuple(words[i : i + k])), 0) + 1
    found = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, p), a in found.items():
        score, _, l, r = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(x == lang and b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in found.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r, totals[lang]))
    return {(lang, rank, p.decode(), -a, l, r, n, -s) for lang, rows in out.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top], 1)}


def texts(rng, documents=120):
    words = ["The", "of", "a", "x y", "éa", "End", "b-c", "longer", "z"]
    fixed = "one passage that stands in very many texts. "
    return [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "! "]) for _ in range(rng.randrange(60))) + fixed * rng.randrange(3), rng.choice(["en", "de", None])) for _ in range(documents)]


@pytest.mark.parametrize("bucket_rows", [20, 400_000])
def test_phrases_against_counting(spark, monkeypatch, bucket_rows):
    rows = texts(random.Random(3))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    monkeypatch.setattr(collocations, "BUCKET_ROWS", bucket_rows)
    found, totals = collocations.phrase_counts(df, 7, 4, bucket_rows=bucket_rows)
    assert totals.count() == 3
    for top in (5, 2000):
        got = collocations.collocations(df, 7, 4, top)
        assert {tuple(r) for r in got.collect()} == twin(rows, 7, 4, top)
        assert got.count() == len(twin(rows, 7, 4, top))


def test_partitions_are_counts():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 4, (3000, 5))
    ends = rng.integers(1, 6, 3000)
    words[np.arange(5)[None] >= ends[:, None]] = -1
    weight = rng.integers(1, 4, 3000)
    expected = Counter()
    for w, e, n in zip(words.tolist(), ends, weight, strict=True):
        for k in range(1, e + 1):
            expected[tuple(w[:k])] += int(n)
    for least in (1, 30, 10**6):
        got = [(tuple(words[p][:k].tolist()), int(n)) for a, b, c in collocations.multikey(words, weight, least) for p, k, n in zip(a, b, c, strict=True)]
        assert len(got) == len(dict(got))
        assert dict(got) == {k: n for k, n in expected.items() if n >= least}


def test_scores_beyond_64_bits(spark):
    a, n = 3 * 10**12, 7 * 10**13
    phrases = spark.createDataFrame([("en", "x y", a), ("en", "x", a + 5), ("en", "y", 2 * a + 1)], "lang string, phrase string, n long")
    row = collocations.scores(phrases, spark.createDataFrame([("en", n)], "lang string, words long")).collect()[0]
    assert (row.a, row.l, row.r, row.n, row.score) == (a, a + 5, 2 * a + 1, n, 1000 * a * n // ((a + 5) * (2 * a + 1)))


def test_phrases_of_awkward_tables(spark):
    rows = [(r.text, r.lang) for r in awkward(spark).collect()]
    assert {tuple(r) for r in collocations.collocations(awkward(spark)).collect()} == twin(rows, 100, 5, 2000)
    assert collocations.collocations(empty(spark)).count() == 0
    long = [(PROSE * 5000, "en"), ("q" * 400_000 + " r", None)]
    assert {tuple(r) for r in collocations.collocations(spark.createDataFrame(long, "text string, lang string")).collect()} == twin(long, 100, 5, 2000)
