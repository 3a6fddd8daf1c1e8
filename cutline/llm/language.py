"""Language identification by a byte-level convolutional network.

A text's lower-cased UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Each byte has an embedding; filters of 2, 3 and 4
bytes run over it, each filter's maximum over the window is kept, and a softmax layer gives the languages'
probabilities. A document's probabilities are the means over all its windows, weighted by their length.

The network is trained in numpy on the driver, on a bounded sample: about ``PER_LANGUAGE`` documents of each language,
chosen by a hash of id and text and twice as many at most, with ``WINDOWS_A_DOC`` windows spread over each. In tasks the filters are applied by table: what
two neighbouring bytes add to a filter is looked up, as there are only 65,536 pairs. One ``mapInArrow`` pass, no shuffle.

Null texts and texts without a letter (Unicode's letters: no digits, fractions or Roman numerals) are ``und`` with score 0. Texts of any length are read whole. Languages of null are not learned;
all others are, however many (their number sets the size of the last layer and of the counts that are broadcast). Repeated rows give repeated results, an empty table an empty one; columns named like outputs are replaced. Without any labelled text there is no model, and ``train`` says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .quality import remainder

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 8, 8
PER_LANGUAGE, WINDOWS_A_DOC, EPOCHS, BATCH, RATE = 500, 4, 8, 64, 0.01
#: Windows that a task holds in memory at once.
_BLOCK = 512


def windows(data: bytes) -> np.ndarray:
    """All windows of a text's bytes; the last is padded with zero bytes."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # of each width: (width * EMBEDDING) x FILTERS
    biases: list[np.ndarray]
    weights: np.ndarray  # (3 * FILTERS) x languages
    offset: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Network:
        """Adam on the cross entropy; gradients pass through each filter's best place only."""
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 0.5, (256, EMBEDDING))]
        p += [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS]
        p += [np.zeros(FILTERS) for _ in WIDTHS]
        p += [rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), np.zeros(len(languages))]
        p = [a.astype(np.float32) for a in p]
        k = len(WIDTHS)
        first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                xb, yb, n = x[rows], y[rows], len(rows)
                e = p[0][xb]
                pooled, places = [], []
                for i, w in enumerate(WIDTHS):
                    spans = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                    z = spans @ p[1 + i] + p[1 + k + i]
                    best = z.argmax(1)
                    places.append(best)
                    pooled.append(np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0], 0))
                h = np.concatenate(pooled, axis=1)
                s = h @ p[-2] + p[-1]
                s = np.exp(s - s.max(1, keepdims=True))
                d = s / s.sum(1, keepdims=True)
                d[np.arange(n), yb] -= 1
                d /= n
                g = [np.zeros_like(a) for a in p]
                g[-2], g[-1] = h.T @ d, d.sum(0)
                dh = (d @ p[-2].T) * (h > 0)
                for i, w in enumerate(WIDTHS):
                    own = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    bytes_at = xb[np.arange(n)[:, None, None], places[i][:, :, None] + np.arange(w)]  # n x FILTERS x w
                    spans = p[0][bytes_at].reshape(n, FILTERS, w * EMBEDDING)
                    g[1 + i] = np.einsum("nfc,nf->cf", spans, own)
                    g[1 + k + i] = own.sum(0)
                    back = (own[:, :, None] * p[1 + i].T[None]).reshape(-1, EMBEDDING)
                    np.add.at(g[0], bytes_at.reshape(-1), back)
                step += 1
                for a, da, m, v in zip(p, g, first, second, strict=True):
                    m += 0.1 * (da - m)
                    v += 0.001 * (da * da - v)
                    a -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(languages, p[0], p[1 : 1 + k], p[1 + k : 1 + 2 * k], p[-2], p[-1])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a pair of bytes adds to the filters that begin at it, and to those that began two bytes before."""
        part = [[self.embedding @ f[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        begin = np.concatenate([pair(x[0], x[1]) + b for x, b in zip(part, self.biases, strict=True)], axis=1)
        after = np.concatenate([pair(part[1][2], np.zeros_like(part[1][2])), pair(part[2][2], part[2][3])], axis=1)
        return begin.astype(np.float32), after.astype(np.float32)

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of each window (rows of bytes)."""
        begin, after = tables
        out = []
        for at in range(0, len(x), _BLOCK):
            b = x[at : at + _BLOCK].astype(np.int32)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            z = begin[pairs]
            z[:, :-2, FILTERS:] += after[pairs[:, 2:]]
            best = np.empty((len(b), 3 * FILTERS), np.float32)
            for i, w in enumerate(WIDTHS):
                best[:, i * FILTERS : (i + 1) * FILTERS] = z[:, : WINDOW - w + 1, i * FILTERS : (i + 1) * FILTERS].max(1)
            s = np.maximum(best, 0) @ self.weights + self.offset
            s = np.exp(s - s.max(1, keepdims=True))
            out.append(s / s.sum(1, keepdims=True))
        return np.concatenate(out)


def _prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Learn from a sample of docs: at most about per_language documents of each language."""
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    hashed = F.xxhash64("id", "text")
    drawn = labelled.join(F.broadcast(counts), "lang").withColumn("hashed", hashed).filter(F.pmod("hashed", F.lit(1_000_000_000)) / 1e9 * F.col("n") < per_language)
    # copies of a row are drawn together: twice the number wanted is the bound
    chosen = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hashed", "id"))).filter(F.col("place") <= 2 * per_language)

    def cut(batches):
        for batch in batches:
            found = [windows(_prepared(t)) for t in batch.column("text").to_pylist()]
            found = [w[np.unique(np.linspace(0, len(w) - 1, WINDOWS_A_DOC).astype(int))] for w in found]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").cast(pa.string()), "lang": batch.column("lang"), "bytes": pa.array([w.tobytes() for w in found], pa.binary())})

    common.small_batches(docs.sparkSession)
    rows = chosen.select("id", "text", "lang").mapInArrow(cut, "id string, lang string, bytes binary").toPandas().sort_values(["lang", "id", "bytes"])
    if not len(rows):
        raise common.NothingToLearn("labelled texts are needed")
    languages = sorted(rows["lang"].unique())
    each = [np.frombuffer(b, np.uint8).reshape(-1, WINDOW) for b in rows["bytes"]]
    y = np.repeat([languages.index(x) for x in rows["lang"]], [len(w) for w in each])
    return Network.train(np.concatenate(each).astype(np.int64), y, languages)


def predict(df: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """df without its text, with ``lang_pred`` and ``score``; without a network all are ``und``."""

    def run(batches):
        tables = network.tables() if network else None
        for batch in batches:
            names, scores = [], []
            texts = batch.column(text).to_pylist()
            cuts = [windows(_prepared(t)) for t in texts]
            if not cuts:
                continue
            found = network.probabilities(np.concatenate(cuts), tables) if network else np.zeros((sum(map(len, cuts)), 1))
            at = 0
            for t, rows in zip(texts, cuts, strict=True):
                own = found[at : at + len(rows)].astype(np.float64)
                at += len(rows)
                if network is None or t is None or not any(map(str.isalpha, t)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                weight = (rows != 0).sum(1)
                mean = (own * weight[:, None]).sum(0) / max(1, weight.sum())
                names.append(network.languages[int(mean.argmax())])
                scores.append(float(min(1.0, mean.max())))
            kept = {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k not in (text, "lang_pred", "score")}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    common.small_batches(df.sparkSession)
    fields = [f for f in df.schema if f.name not in (text, "lang_pred", "score")]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    try:
        network = train(docs.filter(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    except common.NothingToLearn:
        network = None
    return predict(docs.select("doc_id", "text"), network).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
