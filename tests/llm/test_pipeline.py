"""The pipeline's stages, one by one and as a whole."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cutline.llm import bpe, mixing, quality, queries, secrets

from .data import PROSE, awkward, empty
from .test_operators import brute_components, secrets_twin


def test_stages_keep_the_columns(spark, small):
    docs = awkward(spark, extra=False)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        assert stage(spark, empty(spark).select(docs.columns), small).count() == 0
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_near_copies_leave_one(spark, small):
    other = " ".join(f"t{i}" for i in range(90))
    rows = [(5, PROSE * 6), (3, PROSE * 6 + "more"), (9, PROSE * 6), (9, PROSE * 6), (4, other), (8, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, small).collect()) == [3, 4, 7, 8]


def test_near_copies_go_by_text_not_by_id(spark, small):
    text = lambda k: " ".join(f"{k}{i}" for i in range(90))
    rows = [(3, PROSE * 6), (5, PROSE * 6), (5, text("a")), (5, text("b")), (None, text("c")), (None, text("c") + " more"), (None, text("d")), (None, text("b")), (None, None), (None, ""), (6, text("d") + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = pipeline.drop_near_copies(spark, docs, small).collect()
    alike = [sum((r.text or "").startswith(text(k)) for r in left) for k in "abcd"]
    assert alike == [1, 1, 1, 1] and len(left) == 7
    assert {(r.doc_id, r.text) for r in left} >= {(3, PROSE * 6), (5, text("a")), (5, text("b")), (6, text("d") + " more"), (None, None), (None, "")}


@pytest.fixture(scope="module")
def planted(spark, small):
    """Documents of the tables with planted secrets, near copies, two texts under one id, and rows without id."""
    rng = random.Random(21)
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for k in rng.sample(range(len(rows)), 60):
        r = dict(rows[k])
        words = (r["text"] or "").split(" ")
        kind = rng.randrange(4)
        if kind == 0:
            words.insert(rng.randrange(len(words) + 1), f"password=dragon{rng.randrange(10**5)}!")
        elif kind == 1:
            words.insert(rng.randrange(len(words) + 1), f"api_key: {hashlib.sha256(str(k).encode()).hexdigest()[:40]}")
        elif kind == 2:
            words.append("again")
        r["text"] = " ".join(words)
        r["doc_id"] = rng.choice([None, 10_000 + k, rows[rng.randrange(len(rows))]["doc_id"]])
        rows.append(r)
    rows += [rows[3] | {"text": None, "doc_id": 20_000}, rows[3] | {"text": "", "doc_id": None, "source": None}]
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], spark.read.parquet(f"{small}/documents.parquet").schema)


def texts_of(rows):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


def test_stages_against_twins(spark, small, planted):
    """Every stage of one run, each on what the one before it kept, row by row against plain Python."""
    rows, docs = planted
    kept = {name: None for name, _ in pipeline.STAGES}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        kept[name] = [r.asDict() for r in docs.collect()]
    first, near, clean, mixed, tokens = kept.values()

    model = quality.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    scores = model.score(np.array([quality.statistics(r["text"] or "") for r in rows]))
    assert texts_of(first) == texts_of(r for r, x in zip(rows, scores, strict=True) if x >= quality.THRESHOLD)

    sets = []
    for r in first:
        w = "".join(c.lower() if c.isascii() else c for c in r["text"] or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = brute_components(sets, Fraction(8, 10))
    members = {}
    for r, s, g in zip(first, sets, group, strict=True):
        members.setdefault(g if s else ("empty", len(members)), []).append(r)
    assert len(near) == len(members) and not texts_of(near) - texts_of(first)
    left = Counter((r["doc_id"], r["text"]) for r in near)
    for own in members.values():
        least = min((r["doc_id"] for r in own if r["doc_id"] is not None), default=None)
        assert any(r["doc_id"] == least and left[(r["doc_id"], r["text"])] for r in own)

    trees = secrets.forest(secrets.labelled_findings(spark))
    want = [r | {"text": None if r["text"] is None else secrets_twin(r["text"], r["source"] or "", trees)[1]} for r in near]
    assert texts_of(clean) == texts_of(want) and texts_of(clean) != texts_of(near)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean)

    assert texts_of(mixed) == mixed_twin(clean)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_tokenizer())
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in tokens) == Counter((r["doc_id"], tuple(encode(r["text"]))) for r in mixed)
    assert all(r["n_tokens"] == len(r["tokens"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["tokens"], "<u4").tobytes()).hexdigest() for r in tokens)


def mixed_twin(rows):
    """Copies by one running sum over each source's documents, in the order of size class, salt, size and id."""
    size = lambda r: len([w for w in (r["text"] or "").replace("\x0b", " ").replace("\x0c", " ").split() if w])
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    total = {s: sum(size(r) for r in rows if r["source"] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    goal, capped = mixing.SHARE * sum(total.values()), set()
    while True:
        level = (goal - sum(mixing.CAP * total[s] for s in capped)) / sum(weight[s] for s in sources if s not in capped)
        above = {s for s in sources if s not in capped and weight[s] * level > mixing.CAP * total[s]}
        if not above:
            break
        capped |= above
    out = Counter()
    for s in sources:
        target = mixing.CAP * total[s] if s in capped else weight[s] * level
        rate = target / total[s] if total[s] else 0.0
        offset = int(hashlib.md5(f"mix:{'-' if s is None else '+' + s}".encode()).hexdigest()[:5], 16) / 1048576

        def place(r):
            n = size(r)
            digits = max(1, n.bit_length())
            salt = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:8], 16) % mixing.SALTS
            return digits * 8 + n * 8 // (1 << (digits - 1)) - 8, salt, n, r["doc_id"] is not None, r["doc_id"] or 0

        own = sorted((r for r in rows if r["source"] == s), key=place)
        for i, r in enumerate(own):
            copies = math.floor((i + 1) * rate + offset) - math.floor(i * rate + offset)
            if copies:
                out[(r["doc_id"], r["text"], r["source"])] += copies
    return out


def test_whole_pipeline(spark, small):
    out = pipeline.run(spark, small)
    documents = spark.read.parquet(f"{small}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() < documents.count()
    assert out.filter(F.size("tokens") != F.col("n_tokens")).isEmpty()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_variants", "op13_collocations"}))  # these return words and phrases
def test_registered_queries_return_every_document(spark, small, name):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    got = queries.QUERIES[name](spark, small)
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    if name == "op9_secrets":
        assert set(ids) <= {r.doc_id for r in documents.select("doc_id").collect()} and got.filter("not secret").count() > 0
    else:
        assert ids == Counter(r.doc_id for r in documents.select("doc_id").collect())
