"""Nearest names by shared letters against all pairs."""

import random

import pytest

from cutline.operators import match


def similar(a, b):
    return float(match.jaro_winkler(match._codes([a]), match._codes([b]))[0])


def names(rng, n):
    letters = "abcdeeefghiijklmnooprsttu-"
    base = ["".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(n)]
    return base + ["--" + b[::-1] for b in base[::3]] + ["é" * 3, "x" * 300, "x" * 299 + "y", ""]


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_suggestions_equal_all_pairs(spark, least):
    rng = random.Random(3)
    known, asked = names(rng, 120), names(rng, 60)
    asked += [w[:k] + w[k + 1 :] for w in known[:60] for k in (0, len(w) // 2)] + [None]
    df = lambda words: spark.createDataFrame([(w,) for w in words], "param string")
    got = {r.param: (r.suggestion, round(r.similarity, 9)) for r in match.suggestions(df(asked), df([*known, None]), "param", least).collect()}
    expected = {}
    for a in {a for a in asked if a is not None}:
        best = min((-round(similar(a, k), 12), k) for k in known)
        if similar(a, best[1]) > least:
            expected[a] = (best[1], round(-best[0], 9))
    assert got == expected


def test_no_similar_pair_is_dropped():
    rng = random.Random(5)
    words = [w for w in names(rng, 150) if w]
    for least in (0.3, 0.6, 0.75, 0.95):
        for _ in range(4000):
            a, b = rng.choice(words), rng.choice(words)
            if similar(a, b) > least:
                shared = sum(min(a.count(c), b.count(c)) for c in set(a))
                assert shared >= match.least_shared(len(a), len(b), least)


def test_few_pairs_are_compared(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(5, 11))) for _ in range(600)})
    df = spark.createDataFrame([(w,) for w in words], "_n string")
    pairs = match.shared_candidates(df, df, 0.75).collect()
    assert len(pairs) == len(set(pairs)) and len(words) <= len(pairs) < 0.1 * len(words) ** 2
