"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes a short vector of statistics of its whole text (letters, case, symbols, word lengths, repeated
words and lines), taken through logarithms or logits so that a class is closer to a normal cloud. A class keeps its
mean and the Cholesky factor of its covariance, shrunk towards a multiple of the identity; the score is the logistic
of the difference of the two log densities (Mahalanobis distances plus log determinants) and the log prior odds.

The fit takes at most ``TRAIN_ROWS`` labelled rows, the first in the order of a hash of the id, each with one text of its id (the smallest, where rows share an id); only their statistics come
to the driver. Texts of any length are read whole. Scoring is one ``mapInArrow`` pass without a shuffle. Null texts count as empty, repeated rows get
repeated scores, an empty table an empty result; labels of null or for ids without document are ignored. Without
labelled rows of both classes there is no model, and ``fit`` says so; the query then gives every document the score ``NEUTRAL``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Most labelled rows to fit on; share of the scaled identity in a covariance; score from which a document is good.
TRAIN_ROWS, SHRINKAGE, THRESHOLD = 12_000, 0.05, 0.3
#: Score of documents where nothing can be learned: they are not rejected.
NEUTRAL = 0.5

#: Kinds of bytes: 0 white space, 1 lower case, 2 upper case, 3 digit, 4 sentence marks, 5 other symbols, 6 non-ASCII.
_KIND = np.full(256, 6, np.uint8)
_KIND[:128] = 5
for _k, _set in ((0, b" \t\n\v\f\r\0"), (1, bytes(range(97, 123))), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b".,;:'\"-?()")):
    _KIND[list(_set)] = _k
_LINES = re.compile(r"[^\r\n]+")

#: Statistics: name, and for shares the usual value that short texts are drawn to.
USUAL = {
    "upper": 0.03, "marks": 0.03, "symbols": 0.005, "other_letters": 0.05,
    "same_as_before": 0.003, "top_word": 0.05, "bare_symbols": 0.002, "marked_ends": 0.15, "distinct_words": 0.75, "distinct_lines": 0.97,
}
STATISTICS = (*USUAL, "mean_word", "sd_word", "words_a_line")
#: Letters from which words count as equally long.
LONG = 20
#: Weight of the usual value, in bytes, words and lines.
BYTES, WORDS, LINES = 150, 30, 3


def statistics(text: str) -> list[float]:
    """The vector of one text: log odds of shares, logarithms of lengths, each drawn to the usual in short texts."""
    data = text.encode("utf-8", "replace")
    kind = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7).tolist()
    solid, letters = len(data) - kind[0], kind[1] + kind[2]
    words = text.split()
    m = len(words)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    length = np.minimum(np.fromiter(map(len, words), np.float64, m), LONG)  # keys and addresses say little about the prose
    lines = _LINES.findall(text)
    counts = {
        "upper": (kind[2], letters, BYTES), "marks": (kind[4], solid, BYTES),
        "symbols": (kind[5], solid, BYTES), "other_letters": (kind[6], solid, BYTES),
        "same_as_before": (sum(a == b for a, b in zip(words, words[1:], strict=False)), m, WORDS),
        "top_word": (max(seen.values(), default=0), m, WORDS),
        "bare_symbols": (sum(c for w, c in seen.items() if not any(map(str.isalnum, w))), m, WORDS),
        "marked_ends": (sum(c for w, c in seen.items() if not w[-1].isalnum()), m, WORDS),
        "distinct_words": (len(seen), m, WORDS), "distinct_lines": (len(set(lines)), len(lines), LINES),
    }
    shares = [(c + USUAL[name] * k) / (n + k) for name, (c, n, k) in counts.items()]
    mean = (length.sum() + 5.0 * WORDS) / (m + WORDS)
    variance = (((length - mean) ** 2).sum() + 9.0 * WORDS) / (m + WORDS)
    return [
        *(float(np.log(s / (1 - s))) if s < 1 else 12.0 for s in shares),
        float(np.log(mean)), float(np.log(variance) / 2), float(np.log((m + 12.0 * LINES) / (len(lines) + LINES))),
    ]


@dataclass
class Discriminant:
    """Two normal classes in standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors
    logs: list[float]  # log prior minus half the log determinant

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
        if not ((y == 0).any() and (y == 1).any()):
            raise common.NothingToLearn("labelled rows of both classes are needed")
        centre, scale = x.mean(0), x.std(0) + 1e-9
        z = (x - centre) / scale
        means, factors, logs = [], [], []
        for k in (0, 1):
            own = z[y == k]
            mean = own.mean(0)
            covariance = (own - mean).T @ (own - mean) / max(1, len(own) - 1)
            p = len(mean)
            covariance = (1 - shrinkage) * covariance + shrinkage * max(np.trace(covariance) / p, 1e-3) * np.eye(p)
            lower = np.linalg.cholesky(covariance)
            means.append(mean)
            factors.append(np.linalg.inv(lower))
            logs.append(float(np.log(len(own) / len(z)) - np.log(np.diag(lower)).sum()))
        return cls(centre, scale, means, factors, logs)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [g - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, g in zip(self.means, self.factors, self.logs, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60)))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def add_statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """Replace the text column by its vector."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(text).to_pylist()]
            kept = {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k not in (text, out)}
            yield pa.RecordBatch.from_pydict(kept | {out: pa.array(rows, pa.list_(pa.float64()))})

    common.small_batches(df.sparkSession)
    fields = [f for f in df.schema if f.name not in (text, out)]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Learn from labels (doc_id, quality). rows bounds what is broadcast and what reaches the driver."""
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
    )
    first = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # ids may repeat: a text each
    got = add_statistics(first.join(F.broadcast(chosen), "doc_id")).orderBy("doc_id", "quality").toPandas()
    return Discriminant.fit(np.array(got["statistics"].tolist(), dtype=float).reshape(-1, len(STATISTICS)), got["quality"].to_numpy())


def score(df: DataFrame, model: Discriminant | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with ``score`` (0 to 1, higher is better) and ``predicted``; without a model the score is ``NEUTRAL``."""

    def run(batches):
        for batch in batches:
            if model is None:
                scores = np.full(batch.num_rows, NEUTRAL)
            else:
                rows = [statistics(t or "") for t in batch.column(text).to_pylist()]
                scores = model.score(np.array(rows, dtype=float).reshape(-1, len(STATISTICS)))
            kept = {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k not in ("score", "predicted")}
            yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))})

    common.small_batches(df.sparkSession)
    fields = [f for f in df.schema if f.name not in ("score", "predicted")]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that has not seen the held-out labels."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    try:
        model = fit(docs, labels)
    except common.NothingToLearn:
        model = None
    scored = score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
