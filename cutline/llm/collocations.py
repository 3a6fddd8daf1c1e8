"""Phrase collocation mining: word suffixes routed by leading words, then multikey three-way quicksort.

A text's A-Z are lower-cased; it is cut into pieces at sentence marks and line ends, pieces into words at blanks and tabs. A *suffix* is
the ``MOST`` words from a place on, ended by its piece. Everything is counted for each language on its own. There are three steps.

1. *Words and pairs.* A pass counts words, and pairs of neighbours by ``CELLS`` cells that they are hashed into. A cell of fewer than ``least``
   pairs holds no frequent pair, and no phrase of a rare pair is frequent. What tasks learn of it is a bit a cell, in a table of fixed size that changes cost only: where it is full, all suffixes travel.
2. *Routing.* Suffixes end before their first rare pair; equal ones of a task become one with a count and go, packed, by a hash of their first two words to a bucket. Suffixes whose pair stands
   in a cell of more than ``hot`` pairs (a bucket's worth) go by all their words instead, so no pair is one task's load; their phrases' counts are summed afterwards.
3. *Sorting.* A bucket's suffix pointers are sorted by three-way partition on the word at the partition's depth: less, equal, greater. All
   partitions of a round are split at once in numpy. An equal partition is a phrase, its size the count; it goes on a word deeper. Partitions of fewer than ``least`` suffixes are abandoned, which is exact since all suffixes of a bucket's pairs are there.

``scores`` cuts each phrase in all ways and looks both parts up: parts of frequent phrases are frequent, so the table holds them. Arithmetic is exact, in integers of 128 bits within
a decimal type (38 digits). Null languages are ``und``; null and empty texts have no words; repeated rows count again; an empty table gives an empty result; only text and lang are read, so other
columns cannot clash. Texts of any length are taken whole, one in memory at a time.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import written

#: Most words of a phrase, least occurrences, phrases of a language in the result.
MOST, LEAST, TOP = 5, 100, 2000
#: Bits of a pair's cell; of its place in a block of cells; words that a task counts at once; places of suffixes to a bucket.
CELL_BITS, ROW_BITS, COUNTED, BUCKET_ROWS = 26, 14, 1_000_000, 400_000
#: The language of rows that name none.
UNKNOWN = "und"

_U = np.uint64
_END = b"\xff"  # in no UTF-8 text
_BYTES = bytearray(range(256))
_BYTES[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _BYTES[_c] = 255
_BYTES = bytes(_BYTES)


def words_of(text: str | None) -> list[bytes]:
    """A text's words in order; each piece ends with the word FF."""
    data = (text or "").encode("utf-8", "replace").translate(_BYTES).replace(_END, b" \xff ")
    return data.split()  # of white space only blanks and tabs are left


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_hash(word: bytes) -> int:
    """64 bits, the same in all tasks."""
    return xxhash.xxh64_intdigest(word)


class Chunk:
    """Texts of one language as numbers: ``ids`` of all words in order, 0 at the ends of pieces; ``names`` of the ids."""

    def __init__(self, lang: str):
        self.lang, self.parts, self.words, self.held = lang, [], 0, 0
        self.known: dict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[_END]

    def add(self, text: str | None) -> None:
        ids = np.fromiter(map(self.known.__getitem__, words_of(text)), np.int64)
        self.parts += [ids, np.zeros(1, np.int64)]
        self.words += len(ids)

    def close(self) -> None:
        self.ids = np.concatenate([*self.parts, np.zeros(1, np.int64)])
        self.names = list(self.known)
        hashes = np.array([word_hash(w) for w in self.names], _U)
        seed = _U(word_hash(b"lang " + self.lang.encode("utf-8", "replace")))
        first, second = hashes[self.ids[:-1]], hashes[self.ids[1:]]
        self.pair = np.flatnonzero((self.ids[:-1] != 0) & (self.ids[1:] != 0))  # places where a pair begins
        self.lead = mixed(mixed(first[self.pair] + seed) + second[self.pair])
        self.cell = (self.lead >> _U(64 - CELL_BITS)).astype(np.int64)
        self.hashes = hashes


def chunks(batches, text: str, lang: str, words: int = COUNTED):
    """Texts gathered by language, so many words of all languages at once."""
    held: dict[str, Chunk] = {}
    total = 0
    for batch in batches:
        for t, name in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True):
            name = UNKNOWN if name is None else name
            chunk = held.get(name) or held.setdefault(name, Chunk(name))
            before = chunk.words
            chunk.add(t)
            total += chunk.words - before
            if total >= words:
                for c in held.values():
                    c.close()
                    yield c
                held, total = {}, 0
    for c in held.values():
        c.close()
        yield c


def _counted(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """By task: (lang, word, n), how often each word stands, and (block, cells, counts), packed counts of the cells of a block."""

    def run(batches):
        for c in chunks(batches, text, lang):
            n, words = np.bincount(c.ids, minlength=len(c.names))[1:], pa.array(c.names[1:], pa.binary()).cast(pa.string())
            cells, counts = np.unique(c.cell, return_counts=True)
            block, low, counts = cells >> ROW_BITS, (cells & (1 << ROW_BITS) - 1).astype(np.uint16), counts.astype(np.uint32)
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
            spans = list(itertools.pairwise([*first.tolist(), len(block)]))
            for rows, columns in (
                (len(words), {"lang": pa.array([c.lang] * len(words), pa.string()), "word": words, "n": pa.array(n, pa.int64())}),
                (len(spans), {"block": pa.array(block[first], pa.int32()), "cells": pa.array([low[x:y].tobytes() for x, y in spans], pa.binary()), "counts": pa.array([counts[x:y].tobytes() for x, y in spans], pa.binary())}),
            ):
                nulls = {"lang": pa.string(), "word": pa.string(), "n": pa.int64(), "block": pa.int32(), "cells": pa.binary(), "counts": pa.binary()}
                yield pa.RecordBatch.from_pydict({k: columns[k] if k in columns else pa.nulls(rows, kind) for k, kind in nulls.items()})

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(_renamed(run, text, lang), "lang string, word string, n long, block int, cells binary, counts binary")


def _renamed(run, text, lang):
    """run over batches whose two columns are the text and its language."""
    return lambda batches: run(pa.RecordBatch.from_arrays(b.columns, names=[text, lang]) for b in batches)


def _frequent(counted: DataFrame, bounds: list[int]) -> tuple[list[np.ndarray], int]:
    """For each bound a bit a cell, set where it holds at least so many pairs, and the pairs in cells of the first: 2 ** CELL_BITS / 8 bytes a bound."""
    size = 1 << ROW_BITS

    def run(batches):
        now, total = None, None

        def row():
            bits = [np.packbits(total >= b, bitorder="little").tobytes() for b in bounds]
            return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "bits": pa.array([bits], pa.list_(pa.binary())), "pairs": pa.array([int(total[total >= bounds[0]].sum())], pa.int64())})

        for batch in batches:  # sorted by block: one block's sums at a time
            for block, cells, counts in zip(*(batch.column(k).to_pylist() for k in ("block", "cells", "counts")), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, total = block, np.zeros(size, np.int64)
                total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint32)
        if now is not None:
            yield row()

    sums = counted.filter("block is not null").select("block", "cells", "counts").repartition("block").sortWithinPartitions("block")
    out, pairs = [np.zeros(1 << (CELL_BITS - 3), np.uint8) for _ in bounds], 0
    for r in sums.mapInArrow(run, "block int, bits array<binary>, pairs long").collect():
        pairs += r.pairs
        for bits, own in zip(out, r.bits, strict=True):
            bits[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(bytes(own), np.uint8)
    return out, pairs


def _set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 != 0


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row number of each distinct row of ids, and how often it stands; exact, two columns at a time."""
    key = rows[:, 0]
    for j in range(1, rows.shape[1]):
        both = np.unique(key * np.int64(rows.max() + 2) + rows[:, j] + 1, return_inverse=True)[1]
        key = both.astype(np.int64)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def _suffixes(docs: DataFrame, text: str, lang: str, frequent, hot, buckets: int, most: int) -> DataFrame:
    """(bucket, deep, lang, phrases, counts): a task's distinct suffixes without what follows a rare pair, packed by bucket."""

    def run(batches):
        bits, crowded = frequent.value, hot.value
        for c in chunks(batches, text, lang):
            good = np.zeros(len(c.ids) + most, bool)
            good[c.pair] = _set(bits, c.cell)
            at = np.flatnonzero(good)
            if not len(at):
                continue
            rows, alive = np.zeros((len(at), most), np.int64), np.ones(len(at), bool)
            rows[:, 0] = c.ids[at]
            for j in range(1, most):
                alive = alive & good[at + j - 1]
                rows[alive, j] = c.ids[at[alive] + j]
            first, n = _distinct(rows)
            rows, at = rows[first], at[first]
            where = np.searchsorted(c.pair, at)
            lead, deep = c.lead[where], _set(crowded, c.cell[where])
            route = lead
            for j in range(2, most):
                route = np.where(deep, mixed(route + c.hashes[rows[:, j]]), route)
            bucket = (route % _U(buckets)).astype(np.int64) * 2 + deep
            order = np.argsort(bucket, kind="stable")
            bucket, rows, n, names = bucket[order], rows[order], n[order].astype(np.uint32), c.names
            phrases = [b" ".join([names[i] for i in r if i]) for r in rows.tolist()]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            spans = list(itertools.pairwise([*first.tolist(), len(bucket)]))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(bucket[first] // 2, pa.int64()),
                    "deep": pa.array(bucket[first] % 2 == 1),
                    "lang": pa.array([c.lang] * len(spans), pa.string()),
                    "phrases": pa.array([b"\n".join(phrases[x:y]) for x, y in spans], pa.binary()),
                    "counts": pa.array([n[x:y].tobytes() for x, y in spans], pa.binary()),
                }
            )

    return docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(_renamed(run, text, lang), "bucket long, deep boolean, lang string, phrases binary, counts binary")


def multikey(words: np.ndarray, weight: np.ndarray, least: int | np.ndarray):
    """Multikey three-way quicksort of suffix pointers, breadth first: yields (pointer to one suffix, number of words, total weight) for the phrases of each round.

    words has a suffix a row, as numbers from 0 on, -1 after its end; weight is how often each stands. least is the weight below
    which a partition is abandoned, one number or one for each suffix (equal for all that share their first words).
    """
    order = np.arange(len(words))
    least = np.broadcast_to(least, len(words))
    begin, size, depth = np.array([0]), np.array([len(words)]), np.array([0])
    keep = size > 0
    begin, size, depth = begin[keep], size[keep], depth[keep]
    while len(begin):
        part = np.repeat(np.arange(len(begin)), size)
        place = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + begin[part]
        pointer = order[place]
        key = words[pointer, depth[part]]
        thirds = np.sort(np.stack([words[order[begin + x], depth] for x in (np.zeros_like(size), size // 2, size - 1)]), axis=0)
        side = np.sign(key - thirds[1][part]) + 1  # 0 less, 1 equal, 2 greater
        group = part * 3 + side
        order[place] = pointer[np.argsort(group, kind="stable")]
        count = np.bincount(group, minlength=3 * len(begin))
        total = np.bincount(group, weights=weight[pointer], minlength=3 * len(begin)).astype(np.int64)
        start = np.repeat(begin, 3) + np.cumsum(count.reshape(-1, 3), axis=1).ravel() - count
        deeper = np.tile([0, 1, 0], len(begin))
        nonempty = count > 0
        bound = np.zeros(len(count), np.int64)
        bound[nonempty] = least[order[start[nonempty]]]
        equal = (deeper == 1) & nonempty
        ended = np.zeros(len(count), bool)
        ended[equal] = words[order[start[equal]], np.repeat(depth, 3)[equal]] < 0
        alive = nonempty & (total >= bound) & ~ended
        depth3 = np.repeat(depth, 3) + deeper
        found = alive & (deeper == 1)
        if found.any():
            yield order[start[found]], depth3[found], total[found]
        alive &= depth3 < words.shape[1]
        begin, size, depth = start[alive], count[alive], depth3[alive]


def _phrases(routed: DataFrame, least: int, most: int) -> DataFrame:
    """(lang, phrase, n, part): counted phrases of at least two words; part: the count is of this bucket alone and may be below least."""

    def one(rows: pa.Table):
        known: dict = defaultdict()
        known.default_factory = known.__len__
        split, langs, deep = [], [], []
        for name, d, phrases in zip(*(rows.column(k).to_pylist() for k in ("lang", "deep", "phrases")), strict=True):
            own = [p.split(b" ") for p in phrases.split(b"\n")]  # no word holds a blank or a line end
            split += own
            langs += [name] * len(own)
            deep += [d] * len(own)
        deep = np.array(deep, bool)
        # the language is the first word of a suffix
        words = np.full((len(split), most + 1), -1, np.int64)
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        words[:, 0] = np.fromiter((known[x] for x in zip(langs, deep.tolist(), strict=True)), np.int64, len(langs))
        flat = np.fromiter((known[w] for s in split for w in s), np.int64, int(lengths.sum()))
        row = np.repeat(np.arange(len(split)), lengths)
        words[row, 1 + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        weight = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32).astype(np.int64)
        for pointer, length, total in multikey(words, weight, np.where(deep, 1, least)):
            good = length >= 3
            pointer, length, total = pointer[good], length[good] - 1, total[good]
            if len(pointer):
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([langs[p] for p in pointer], pa.string()),
                        "phrase": pa.array([b" ".join(split[p][:k]) for p, k in zip(pointer, length, strict=True)], pa.binary()).cast(pa.string()),
                        "n": pa.array(total, pa.int64()),
                        "part": pa.array(deep[pointer]),
                    }
                )

    def run(batches):
        for _, rows in common.runs(batches, ["bucket"]):
            yield from one(rows)

    return routed.mapInArrow(run, "lang string, phrase string, n long, part boolean")


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = MOST, text: str = "text", lang: str = "lang", bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, n) of 1 to most words, and how many words each language has (lang, words)."""
    spark = docs.sparkSession
    counted = written(_counted(docs, text, lang), "collocation-words")
    words = counted.filter("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "collocation-vocabulary")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("words")), "collocation-totals")
    bits, pairs = _frequent(counted, [least, max(least, bucket_rows)])
    frequent, hot = (spark.sparkContext.broadcast(b) for b in bits)
    buckets = -(-pairs // bucket_rows) or 1
    suffixes = _suffixes(docs, text, lang, frequent, hot, buckets, most)
    routed = suffixes.repartition(max(buckets, _parallel(spark)), "bucket").sortWithinPartitions("bucket")
    found = written(_phrases(routed, least, most), "collocation-phrases")
    whole = found.filter("not part").select("lang", "phrase", "n")
    parts = found.filter("part").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    single = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n")
    return whole.unionByName(parts).unionByName(single), totals


def _parallel(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scores(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of two words and more: the cut with the lowest score, ties to the shortest first part."""
    many = phrases.withColumn("w", F.split("phrase", " ", -1)).filter(F.size("w") > 1)
    cuts = many.select(
        "lang", "phrase", F.col("n").alias("a"), F.size("w").alias("words"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("rest")))).alias("cut"),
    ).select("lang", "phrase", "a", "words", "cut.*")
    part = lambda name, out: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(out))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals.withColumnRenamed("words", "n"), "lang")  # a written table: broadcast where its size is small
    # a * n of up to 35 digits; the quotient is exact in whole numbers
    score = F.expr("cast((cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("words").alias("words"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def contained(phrases: DataFrame, most: int = MOST) -> DataFrame:
    """(lang, phrase) that stand within a longer phrase as often as everywhere: 100 * f(longer) >= 100 * f(phrase)."""
    w = phrases.withColumn("w", F.split("phrase", " ", -1)).filter(F.size("w") > 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    inner = w.select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(inner, ["lang", "phrase"]).filter(F.col("longer") * 100 >= F.col("n") * 100).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first phrases by score: (lang, rank, phrase, a, l, r, n, score)."""
    found, totals = phrase_counts(docs, least, most, text, lang)
    phrases = written(found, "collocation-frequent")
    kept = scores(phrases, totals).join(contained(phrases, most), ["lang", "phrase"], "left_anti")
    # the best of a language: rows above a bound of its sorted order, gathered in slices so that no language is sorted in one task
    first = _first(kept, top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first(kept: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of documents."""
    return collocations(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, w[i : i + k - 1] AS g FROM lists, unnest(range(1, len(w) + 1)) AS p(i), unnest(range(1, 6)) AS q(k) WHERE i + k - 1 <= len(w)
), f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
candidates AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
cuts AS (
  SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM candidates c, unnest(range(1, len(c.g))) AS q(k) JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1 :] JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ones AS (
  SELECT c.lang, c.g[i : i + k - 1] AS g, max(a) AS longer FROM candidates c, unnest(range(2, len(c.g))) AS q(k), unnest(range(1, len(c.g) + 1)) AS p(i) WHERE i + k - 1 <= len(c.g) GROUP BY ALL
), kept AS (SELECT b.* FROM best b LEFT JOIN inner_ones i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""
