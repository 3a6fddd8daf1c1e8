"""Near words against deletion neighbourhoods of all words, trees against all pairs, and awkward tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cutline.llm import variants

from .data import awkward, empty


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            found[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= 7}


def edit_one(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def twin(words):
    """(word, form, root, n, n_near, form_n) from the words that share what is left without one letter."""
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: {v for k in range(len(w)) for v in holes[w[:k] + w[k + 1 :]]} | {w[:k] + w[k + 1 :] for k in range(len(w))} | holes.get(w, set()) for w in words}
    near = {w: {v for v in some if v in words and edit_one(w, v)} for w, some in near.items()}
    first = {w: min(some, key=lambda v: (-words[v], v)) if some else None for w, some in near.items()}
    form = {w: v if v and words[v] >= 10 * words[w] else None for w, v in first.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def invented(rng, documents=250):
    parts = ["ver", "ung", "al", "é", "ter", "in", "ab", "ñ", "to", "rel"]
    base = ["".join(rng.choices(parts, k=rng.randrange(3, 6))) for _ in range(150)]

    def word():
        w = base[int(rng.random() ** 3 * len(base))]
        if rng.random() < 0.2:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "i" + w[k + 1 :]])
        return w.title() if rng.random() < 0.1 else w

    return [(i or None, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(documents)]


@pytest.mark.parametrize("sizes", [{}, {"sample": 400, "cell_words": 40, "part_words": 20}, {"sample": 0, "part_bytes": 300}])
def test_variants_against_all_words(spark, sizes):
    rows = invented(random.Random(2))
    words = counted(rows)
    got = variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {tuple(r) for r in got.collect()} == set(words.items())
    found = variants.roots(variants.forms(variants.neighbours(variants.written(got, "words"), **sizes))).collect()
    assert len(found) == len(words) and {tuple(r) for r in found} == twin(words)
    assert any(r.form for r in found) and any(r.n_near > 1 for r in found)


def test_chains_are_followed_to_their_end(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    words = {w: 3 * 10**k for k, w in enumerate(chain)} | {"zzzzzzzz": 2}
    df = variants.written(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    assert {tuple(r) for r in variants.roots(variants.forms(variants.neighbours(df))).collect()} == twin(words)


def test_trees_lose_no_pair():
    rng = random.Random(4)
    for leaf, letters in ((1, "ab"), (8, "abcd"), (32, "abcdefghé")):
        words = sorted({"".join(rng.choices(letters, k=8)) for _ in range(500)})
        longer = sorted({"".join(rng.choices(letters, k=9)) for _ in range(500)})
        for other in (words, longer):
            tree = variants.Tree(variants.vectors(other), leaf)
            assert sorted(tree.order) == list(range(len(other)))
            got = [(words[q], other[w]) for a, b in variants.near_pairs(words, other, tree) for q, w in zip(a, b, strict=True)]
            assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in other if edit_one(a, b)}
            cells = tree.cells(variants.vectors(other))
            assert all(i in tree.order[tree.begin[c] : tree.end[c]] for i, c in enumerate(cells))


def test_boxes_are_pruned():
    rng = np.random.default_rng(1)
    words = sorted({"".join(map(chr, 97 + rng.integers(0, 26, 10))) for _ in range(20_000)})
    tree = variants.Tree(variants.vectors(words), variants.LEAF)
    reached = sum(len(own) * (tree.end[leaf] - tree.begin[leaf]) for own, leaf in tree.walk(variants.vectors(words[:500]), 1, 1))
    assert reached < 0.1 * 500 * len(words)


def test_variants_of_awkward_tables(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    rows += [(50 + k, "y" * 40_000 + "z" * (k % 3) + " sunrises Sunrises sunrise sunrise") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = counted(rows)
    run = lambda d, **o: variants.roots(variants.forms(variants.neighbours(variants.written(variants.word_counts(d), "words"), **o))).collect()
    got = run(df)
    assert len(got) == len(words) and {(r.word, r.n) for r in got} == set(words.items())
    short = {w: n for w, n in words.items() if len(w) < 1000}
    assert {tuple(r) for r in got if len(r.word) < 1000} == twin(short)
    long = {r.word: r.n_near for r in got if len(r.word) >= 1000}
    assert long == {w: sum(edit_one(w, v) for v in words) for w in words if len(w) >= 1000}
    assert run(empty(spark)) == []
    assert {r.word for r in run(awkward(spark))} == set(counted([(r.doc_id, r.text) for r in awkward(spark).collect()]))
