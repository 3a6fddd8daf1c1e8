"""Toxicity: a support vector machine on the gap-weighted subsequence kernel, with Nyström landmarks.

A text's *units* are its lower-cased non-space runs, and runs of single characters that blanks keep apart, joined. A unit, between boundary marks, has for each triple of letters the
sum of ``DECAY ** span`` over all places where they stand in this order within ``SPAN`` characters: characters between them only weaken it, so ``id-iot``, ``idxiot`` and
``i d i o t`` stay near ``idiot``. The kernel of two units is the cosine of these vectors. Units of more than ``WINDOW`` characters are taken in overlapping windows.

*Learning.* Sentences carry their document's label; which units make them toxic is found by counting, in Spark, for each unit the different pairs of neighbours that it has under either label, so
copies of a text count once: units whose toxic share is beyond chance among all units (a binomial bound) are positive. The SVM (squared hinge, Newton's method)
learns them, with inserted characters, against a hashed sample of clean units, and once more against the clean units that it takes for toxic. Features are the kernel with ``LANDMARKS`` landmarks, whitened (Nyström).
A document's score is a logistic function, fitted on the same documents, of its two highest units. As the kernel is a product of explicit vectors, landmarks and weights
fold into one weight for each triple, which is all that tasks need.

At most ``TRAIN_ROWS`` labelled rows are read, the first by a hash of the id, and at most ``POSITIVE + NEGATIVE + HARD`` units and two numbers a document reach the driver; everything else covers all rows in one ``mapInArrow`` pass
without a shuffle. Whole texts are read, long ones in slices of their units, so that a task holds the texts of a batch and a bounded number of units. Null and empty texts, and those without letters, get the score of a text whose units say nothing; repeated rows get repeated scores; an empty table gives an empty result; labels of null or for ids without
document are ignored; columns named like outputs are replaced. Where nothing can be learned all scores are 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from heapq import nlargest
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .quality import remainder

#: Most labelled rows to learn from; most positive, clean and mistaken units; most landmarks; score from which a document is toxic.
TRAIN_ROWS, POSITIVE, NEGATIVE, HARD, LANDMARKS, THRESHOLD = 20_000, 300, 3_000, 1_500, 384, 0.3
#: The kernel: weight lost with each character of the span, longest span, characters of a window. Units that may be taken for positive by accident.
DECAY, SPAN, WINDOW, CHANCE = 0.7, 8, 24, 2.0
#: Least toxic share of a positive unit's places; weight of its clean places.
PURE, DOUBT = 0.7, 8.0
#: Penalty of the SVM; decisions that a task remembers; windows that are worked on at once.
PENALTY, REMEMBERED, BLOCK = 10.0, 1_000_000, 4096
#: Characters from which a text's units are taken in slices; units of a slice, and of the texts that are scored at once; counted places and windows that a task holds.
LONG, SLICE, HELD = 1 << 20, 1 << 17, 1 << 18

#: Letters 1 to 26, others by their code in 27 to 30, 31 the boundary, 0 what is no letter. Digits and signs that stand for letters count as these.
_AS_LETTER = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}+")  # possessive: a long run keeps no places to go back to
_UNIT = re.compile(r"\S+")
_EDGE, _CODES = 31, 1 << 15


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places i < j < k of a row of this length within a span, and their spans."""
    at = [(i, j, k) for i in range(length) for k in range(i + 2, min(length, i + SPAN)) for j in range(i + 1, k)]
    at = np.array(at, np.int64).reshape(-1, 3)
    return at, at[:, 2] - at[:, 0] + 1


_PLACES = {n: _triples(n) for n in (8, 11, 14, 18, WINDOW + 2)}
_WEIGHT = DECAY ** np.arange(SPAN + 1, dtype=np.float64)


def letters(unit: str) -> list[int]:
    """Codes of a unit's characters."""
    out = []
    for c in unit:
        o = ord(_AS_LETTER.get(c, c))
        out.append(o - 96 if 97 <= o <= 122 else 27 + o % 4 if o > 127 and c.isalpha() else 0)
    return out


def each_window(unit: str):
    """A unit's codes between boundaries, in windows of bounded length; none where it has no letter."""
    if any(map(str.isalpha, unit)):
        for a in range(0, len(unit) - WINDOW // 2, WINDOW // 2) if len(unit) > WINDOW else (0,):
            yield [_EDGE, *letters(unit[a : a + WINDOW]), _EDGE]


def windows(unit: str) -> list[list[int]]:
    return list(each_window(unit))


def features(rows: list[list[int]]):
    """Blocks of (row numbers, row of each entry, triple, weight): the vectors of rows of codes, of length 1."""
    length = np.fromiter(map(len, rows), np.int64, len(rows))
    least = 0
    for n, (at, span) in _PLACES.items():
        own = np.flatnonzero((length > least) & (length <= n))
        least = n
        for a in range(0, len(own), BLOCK):
            some = own[a : a + BLOCK]
            codes = np.zeros((len(some), n), np.int32)
            for i, r in enumerate(some.tolist()):
                codes[i, : length[r]] = rows[r]
            x, y, z = codes[:, at[:, 0]], codes[:, at[:, 1]], codes[:, at[:, 2]]
            key = np.where((x > 0) & (y > 0) & (z > 0), ((x * 32 + y) * 32 + z) * 16 + span.astype(np.int32), 0)
            key.sort(axis=1)
            row, col = np.nonzero(key)
            key = key[row, col]
            triple = key >> 4
            first = np.flatnonzero(np.r_[True, (triple[1:] != triple[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, np.int64)
            weight = np.add.reduceat(_WEIGHT[key & 15], first) if len(key) else np.zeros(0)
            row, triple = row[first], triple[first]
            norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(some)))
            yield some, row, triple, weight / norm[row]


def dense(units: list[str]) -> np.ndarray:
    """A row of all triples for each unit's first window."""
    rows = [(windows(u) or [[_EDGE, _EDGE]])[0] for u in units]
    out = np.zeros((len(rows), _CODES), np.float32)
    for some, row, triple, weight in features(rows):
        out[some[row], triple] = weight
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    return dense(a) @ dense(b).T


def decide(units: list[str], table: np.ndarray, offset: float) -> np.ndarray:
    """The machine's decision on each unit: of its windows' the highest; -inf without letters."""
    out = np.full(len(units), -np.inf)
    each = ((i, w) for i, u in enumerate(units) for w in each_window(u))
    while some := list(islice(each, HELD)):
        whose, rows = zip(*some, strict=True)
        value = np.full(len(rows), offset)
        for own, row, triple, weight in features(rows):
            value[own] += np.bincount(row, weights=weight * table[triple], minlength=len(own))
        np.maximum.at(out, np.array(whose, np.int64), value)
    return out


def units_of(text: str | None) -> list[str]:
    """Units in order; runs of three and more single characters stand once more, joined, at the end."""
    text = (text or "").lower()
    return text.split() + ["".join(m.split()) for m in _SINGLES.findall(text)]


def slices(text: str | None):
    """A text's units in lists; those of a long text are never held together."""
    if len(text or "") < LONG:
        yield units_of(text)
        return
    text = text.lower()
    for each in (map(re.Match.group, _UNIT.finditer(text)), ("".join(m.group().split()) for m in _SINGLES.finditer(text))):
        while some := list(islice(each, SLICE)):
            yield some


def placed(text: str | None):
    """Each unit with the units before and after it."""
    before, last = "", []
    for own in slices(text):
        own = last + own
        yield from zip(own[:-1], zip([before, *own[:-2]], own[1:], strict=False), strict=False)
        before, last = own[-2] if len(own) > 1 else before, own[-1:]
    for unit in last:
        yield unit, (before, "")


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton's method on ``|v|^2 / 2 + sum(weight * max(0, 1 - y * x v)^2)``; the last column of x is the offset's and not shrunk."""
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    v, active = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        now = y * (x @ v) < 1
        if active is not None and (now == active).all():
            break
        active = now
        own, w = x[active], weight[active]
        v = np.linalg.solve(ridge + 2 * own.T @ (own * w[:, None]), 2 * own.T @ (w * y[active]))
    return v


@dataclass
class Machine:
    table: np.ndarray  # a weight for each triple
    offset: float
    calibration: np.ndarray  # of the highest, the second and 1

    @classmethod
    def fit(cls, positive: list[str], doubt: list[float], clean: list[str], landmarks: int = LANDMARKS, seed: int = 5) -> Machine:
        """doubt: how often each positive unit stands in clean documents, as a share of all its places."""
        rng = np.random.default_rng(seed)
        marks = positive[: landmarks * 2 // 3]
        marks = [*marks, *(clean[i] for i in rng.permutation(len(clean))[: landmarks - len(marks)])]
        base = dense(marks)
        gram = (base @ base.T).astype(float)
        values, vectors = np.linalg.eigh(gram)
        good = values > 1e-4 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])  # Nyström: z = k(., landmarks) @ whiten
        units = [*positive, *(_gapped(u, rng) for u in positive for _ in range(3)), *positive, *clean, *(_gapped(u, rng) for u in clean[::4])]
        p = len(positive)
        y = np.r_[np.ones(4 * p), -np.ones(len(units) - 4 * p)]
        sure = np.r_[1 - np.tile(doubt, 4), DOUBT * np.array(doubt), np.ones(len(units) - 5 * p)]
        z = np.concatenate([dense(units[a : a + 1000]) @ base.T for a in range(0, len(units), 1000)]).astype(float) @ whiten
        z = np.c_[z, np.ones(len(z))]
        share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
        v = squared_hinge(z, y, PENALTY * sure * share / share.mean())
        return cls((base.T @ (whiten @ v[:-1])).astype(np.float32), float(v[-1]), np.zeros(3))

    def decide(self, units: list[str]) -> np.ndarray:
        return decide(units, self.table, self.offset)

    def calibrate(self, top: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression (Newton's method) of labels on the two highest decisions."""
        x, w = np.c_[np.clip(top, -2, 3), np.ones(len(top))], np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(3), x.T @ (toxic - p) - 0.05 * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.calibration = w

    def probability(self, top: np.ndarray) -> np.ndarray:
        x = np.c_[np.clip(top, -2, 3), np.ones(len(top))]
        return 1 / (1 + np.exp(-x @ self.calibration))


def _gapped(unit: str, rng) -> str:
    """The unit with something inserted: signs between all letters, or a sign or letter at one place."""
    kind = int(rng.integers(3))
    if kind == 0:
        return str(rng.choice(list("-.*_"))).join(unit)
    at = 1 + int(rng.integers(max(1, len(unit) - 1)))
    return unit[:at] + (str(rng.choice(list("-.*_"))) if kind == 1 else chr(97 + int(rng.integers(26)))) + unit[at:]


class Scorer:
    """The two highest decisions among a text's distinct units, remembered by unit."""

    def __init__(self, machine: Machine):
        self.machine, self.known, self.letters = machine, {}, 0

    def top(self, texts: list[str | None]) -> np.ndarray:
        out, best = np.full((len(texts), 2), -2.0), [()] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            for own in slices(text):
                held.append((i, set(own)))
                size += len(own)
                if size > HELD:
                    self._settle(held, best, out)
                    held, size = [], 0
        self._settle(held, best, out)
        return out

    def _settle(self, held: list[tuple[int, set[str]]], best: list[tuple[str, ...]], out: np.ndarray) -> None:
        """Take in the units of some texts. best: the two highest units of each so far, as a text may come in slices."""
        if len(self.known) > REMEMBERED or self.letters > 64 * REMEMBERED:
            self.known.clear()
            self.letters = 0
        new = list(set().union(*(own for _, own in held), *(best[i] for i, _ in held)) - self.known.keys())
        self.letters += sum(map(len, new))
        for a in range(0, len(new), 50_000):
            some = new[a : a + 50_000]
            self.known.update(zip(some, self.machine.decide(some).tolist(), strict=True))
        for i, own in held:
            own.update(best[i])
            best[i] = nlargest(2, own, key=self.known.__getitem__)
            out[i, : len(best[i])] = [self.known[u] for u in best[i]]


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic): one text of each labelled id, at most so many."""
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def places(batches):
    """(unit, before, after, toxic) of texts of either label; most of those that occur more than once are given once."""
    for batch in batches:
        found = set()
        for t, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            each = zip(placed(t.as_py()), repeat(int(y)), strict=False)
            while some := set(islice(each, SLICE)):
                found |= some
                if len(found) > HELD:
                    yield _rows(found)
                    found = set()
        yield _rows(found)


def _rows(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"unit": pa.array([x[0][0] for x in found], pa.string()), "before": pa.array([x[0][1][0] for x in found], pa.string()), "after": pa.array([x[0][1][1] for x in found], pa.string()), "toxic": pa.array([x[1] for x in found], pa.int32())})


def unit_counts(labelled: DataFrame) -> DataFrame:
    """(unit, toxic, clean): between how many different pairs of units a unit stands in documents of either label."""
    each = labelled.mapInArrow(places, "unit string, before string, after string, toxic int").select("unit", F.xxhash64("before", "after").alias("place"), "toxic").distinct()
    return each.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).filter(F.length("unit") <= 4 * WINDOW)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Learn from labels (doc_id, toxic) of documents."""
    spark = docs.sparkSession
    common.small_batches(spark)
    labelled = common.written(_labelled(docs, labels, rows), "toxicity-labelled")
    counts = common.written(unit_counts(labelled), "toxicity-units")
    known = counts.agg(F.count(F.lit(1)).alias("units"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()[0]
    if not known.toxic or not known.clean:
        raise common.NothingToLearn("labelled texts of both classes are needed")
    prior = known.toxic / (known.toxic + known.clean)
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = n * (share * F.log(share / prior) + F.when(F.col("clean") > 0, (1 - share) * F.log((1 - share) / (1 - prior))).otherwise(0.0))
    bound = math.log(known.units / CHANCE)
    scored = counts.withColumn("surprise", F.when(share > prior, surprise).otherwise(0.0))
    found = scored.filter((F.col("surprise") >= bound) & (share > PURE)).select("unit", (1 - share).alias("doubt")).orderBy(F.desc("surprise"), "unit").limit(POSITIVE).collect()
    positive, doubt = [r.unit for r in found if windows(r.unit)], [r.doubt for r in found if windows(r.unit)]
    plain = scored.filter((F.col("clean") > 0) & ((F.col("surprise") < bound) & (share <= max(0.5, prior))))
    clean = [r.unit for r in plain.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVE).collect()]
    if not positive or not clean:
        raise common.NothingToLearn("no unit tells the classes apart")
    machine = Machine.fit(positive, doubt, clean)

    def judged(batches):
        for batch in batches:
            value = machine.decide(batch.column("unit").to_pylist())
            yield pa.RecordBatch.from_pydict({"unit": batch.column("unit"), "value": pa.array(np.where(np.isfinite(value), value, -9.0))})

    mistaken = plain.select("unit").mapInArrow(judged, "unit string, value double").filter("value > -0.7").orderBy(F.desc("value"), "unit").limit(HARD)
    machine = Machine.fit(positive, doubt, list(dict.fromkeys([*clean, *(r.unit for r in mistaken.collect())])))

    def tops(batches):
        scorer = Scorer(machine)
        for batch in batches:
            top = scorer.top(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"a": pa.array(top[:, 0]), "b": pa.array(top[:, 1]), "toxic": batch.column("toxic").cast(pa.int32())})

    seen = labelled.mapInArrow(tops, "a double, b double, toxic int").toPandas()
    machine.calibrate(seen[["a", "b"]].to_numpy(), seen["toxic"].to_numpy().astype(float))
    return machine


def score(df: DataFrame, machine: Machine | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without its text, with ``score`` (0 to 1, higher is more toxic) and ``predicted``."""

    def run(batches):
        scorer = Scorer(machine) if machine else None
        for batch in batches:
            value = machine.probability(scorer.top(batch.column(text).to_pylist())) if machine else np.zeros(batch.num_rows)
            kept = {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k not in (text, "score", "predicted")}
            yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(value), "predicted": pa.array((value >= threshold).astype(np.int32))})

    common.small_batches(df.sparkSession)
    fields = [f for f in df.schema if f.name not in (text, "score", "predicted")]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a machine that has not seen the held-out labels."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 4) != 2)
    try:
        machine = fit(docs, labels)
    except common.NothingToLearn:
        machine = None
    return score(docs, machine).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
