"""Spelling variant grouping: k-d trees over letter-count vectors find words that are one edit apart.

A *word* is a run of letters (``[A-Za-z]`` and U+00C0 to U+00FF) with A-Z lower-cased. A word's *vector* counts its letters, a to z in a place each, the others in ``OTHERS`` places by their code.
Words of equal length that differ in one letter lie one letter up and one down from each other; of a word and a longer one by one letter, the
longer lies one up. So a word is looked for in the tree of its own length and in the one of the next length.

1. *Words.* Runs are counted in tasks, then by word.
2. *Cells.* From a sample of at most about ``SAMPLE`` words the driver builds the upper part of each length's tree: median splits of one letter's count, until a cell has about ``CELL_WORDS`` words or ``MOST_CELLS`` are made. The
   sample shapes the cells only. Every word lies in one cell, and asks all cells whose box its own point reaches. A cell that is larger than expected (many words of the same letters) is dealt out
   in parts, and what asks the cell asks all parts.
3. *Search.* A task builds the lower part of the tree over a cell's words; queries walk it together, level by level, each with what it has left of its one letter up and one down. Words of the leaves that are reached, if their vectors can differ by one letter (told by a sum over the vector) and a half of their letters is alike, are compared letter by letter.
4. *Forms.* Each word keeps how many are near and the most frequent of them. Following forms to the last is pointer jumping over those forms that have a form themselves, so the rounds are the logarithm of the longest chain, and
   a chain's counts grow tenfold a step.

No pair is lost and none is listed. Words of any length are compared in blocks of ``BLOCK_BYTES``. Null and empty texts have no words; a repeated row counts again; an empty table gives an empty result; of the input only doc_id
and text are read, so other columns cannot clash. A null id counts as the empty text where runs are altered.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import written

#: Least letters and occurrences of a word; times a form is more frequent than its variant.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: Words to a leaf, to a cell; bytes of words and words from which a cell is dealt out; most cells of a length; words in the sample.
LEAF, CELL_WORDS, PART_WORDS, PART_BYTES, CELL_BITS, SAMPLE = 16, 40_000, 100_000, 64_000_000, 12, 100_000
MOST_CELLS = 1 << CELL_BITS
#: Places of the letters beyond z; distinct words that a task counts at once; words that ask together; words of a leaf, and asking words, that are held against each other at once; bytes of letters that are compared at once.
OTHERS, COUNTED, ASKING, SQUARE, BLOCK_BYTES = 6, 500_000, 50_000, 4096, 1 << 24

_LOWER = {i: i + 32 for i in range(65, 91)}
_RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % LETTERS)
_DIMS = 26 + OTHERS
#: A code of each letter (1 to 90) and its place in a vector.
_CODE, _PLACE = np.zeros(256, np.uint8), np.zeros(256, np.int64)
_CODE[97:123], _CODE[192:256] = np.arange(1, 27), np.arange(27, 91)
_PLACE[97:123], _PLACE[192:256] = np.arange(26), 26 + np.arange(64) % OTHERS


def altered(word: str, doc_id) -> str:
    """The run, or for one document in 31 the run without one letter: by the crc32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def letter_codes(words: list[str], length: int) -> np.ndarray:
    """A row of letter codes each; all words have the length."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return _CODE[flat].reshape(len(words), length)


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, a row each."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), length)
    return np.bincount(row * _DIMS + _PLACE[flat], minlength=len(words) * _DIMS).reshape(-1, _DIMS).astype(np.int32)


#: A number for each place of a vector; a word's sum of them tells, by its difference from another's, whether their vectors can differ by one letter.
_WEIGHTS = np.random.default_rng(11).integers(0, 1 << 32, _DIMS).astype(np.uint32)
_ONE_UP = np.zeros(1 << 16, bool)
_ONE_UP[_WEIGHTS & 0xFFFF] = True
_UP_AND_DOWN = np.zeros(1 << 16, bool)
_UP_AND_DOWN[(_WEIGHTS[:, None] - _WEIGHTS[None]).ravel() & 0xFFFF] = True


def sums(points: np.ndarray) -> np.ndarray:
    return (points.astype(np.uint32) * _WEIGHTS).sum(axis=1, dtype=np.uint32)


def halves(codes: np.ndarray, cut: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for the letters before cut and one for those from rest on: one edit leaves either the first or the second half of a pair alike."""
    powers = np.cumprod(np.full(codes.shape[1] + 1, 0x9E3779B1, np.uint32), dtype=np.uint32)
    part = lambda x: (x.astype(np.uint32) * powers[: x.shape[1]]).sum(axis=1, dtype=np.uint32)
    return part(codes[:, :cut]), part(codes[:, rest:])


class Tree:
    """A k-d tree: node i splits points by ``point[dim[i]] <= cut[i]`` into nodes ``child[i]`` and ``child[i] + 1``; leaves have dim -1 and the points ``order[begin:end]``."""

    def __init__(self, points: np.ndarray, leaf: int, most: int | None = None):
        self.order = np.arange(len(points))
        self.dim, self.cut, self.child, self.begin, self.end = [-1], [0], [0], [0], [len(points)]
        waiting, leaves = [0], 1
        while waiting:
            i = waiting.pop(0)  # largest cells first, as they are split level by level
            a, b = self.begin[i], self.end[i]
            if b - a <= leaf or (most and leaves >= most):
                continue
            own = points[self.order[a:b]]
            dim, cut = self._split(own)
            if dim < 0:
                continue  # equal points
            left = own[:, dim] <= cut
            self.order[a:b] = np.concatenate([self.order[a:b][left], self.order[a:b][~left]])
            self.dim[i], self.cut[i], self.child[i] = dim, cut, len(self.dim)
            middle = a + int(left.sum())
            for x, y in ((a, middle), (middle, b)):
                waiting.append(len(self.dim))
                for column, value in zip((self.dim, self.cut, self.child, self.begin, self.end), (-1, 0, 0, x, y), strict=True):
                    column.append(value)
            leaves += 1
        self.dim, self.cut, self.child, self.begin, self.end = (np.array(c, np.int64) for c in (self.dim, self.cut, self.child, self.begin, self.end))

    @staticmethod
    def _split(own: np.ndarray) -> tuple[int, int]:
        """The letter and count that leave the smaller share of points near the cut, among even enough cuts."""
        spread = own.var(axis=0)
        best = (-1, 0)
        least = -1.0
        for dim in np.argsort(-spread)[:4].tolist():
            if spread[dim] == 0:
                break
            values, n = np.unique(own[:, dim], return_counts=True)
            below = np.cumsum(n)[:-1]
            even = np.minimum(below, len(own) - below)
            k = int(even.argmax())
            if even[k] > least:
                best, least = (dim, int(values[k])), float(even[k])
        return best

    def walk(self, points: np.ndarray, up: int, down: int):
        """Blocks of (point, leaf node) where a point is reached from the leaf's box by so many letters more and fewer.

        A box's distance from a point is kept for the split letters only, from the path's bounds: what a path already needs up or down.
        """
        for a in range(0, len(points), ASKING):
            rows = np.arange(a, min(len(points), a + ASKING))
            stack = [(0, rows, {}, np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32))]
            while stack:
                node, own, bounds, ups, downs = stack.pop()
                if not len(own):
                    continue
                dim, cut = int(self.dim[node]), int(self.cut[node])
                if dim < 0:
                    yield own, node
                    continue
                x = points[own, dim]
                low, high = bounds.get(dim, (None, None))
                short = lambda v: np.maximum(v - x, 0)  # noqa: E731, B023  letters that the point has too few
                spare = lambda v: np.maximum(x - v, 0)  # noqa: E731, B023  too many
                was_up, was_down = (0 if low is None else short(low)), (0 if high is None else spare(high))
                left = downs + spare(cut) - was_down
                right = ups + short(cut + 1) - was_up
                to, other = left <= down, right <= up
                child = int(self.child[node])
                stack.append((child, own[to], bounds | {dim: (low, cut)}, ups[to], left[to]))
                stack.append((child + 1, own[other], bounds | {dim: (cut + 1, high)}, right[other], downs[other]))

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The leaf in which each point lies."""
        at = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[at] >= 0)
            if not len(inner):
                return at
            now = at[inner]
            at[inner] = self.child[now] + (points[inner, self.dim[now]] > self.cut[now])


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Of rows of letters: whether the second is the first with exactly one letter replaced (equal lengths) or added (one longer)."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(axis=1) == 1
    differ = short != long[:, :n]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
    after = short != long[:, 1:]
    return ~(after & (np.arange(n) >= first[:, None])).any(axis=1)


def near_pairs(queries: list[str], words: list[str], tree: Tree | None = None):
    """(query, word) indices of words one edit from queries; all queries have one length, all words that or one more."""
    if not queries or not words:
        return
    n, m = len(queries[0]), len(words[0])
    tree = tree or Tree(vectors(words), LEAF)
    asked, known = letter_codes(queries, n), letter_codes(words, m)
    rows = max(1, BLOCK_BYTES // m)
    left, right, held = [], [], 0

    def verified():
        q, w = np.concatenate(left), np.concatenate(right)
        good = one_edit(asked[q], known[w])
        return q[good], w[good]

    points = vectors(queries)
    (first_q, second_q), (first_w, second_w) = halves(asked, n // 2, n // 2), halves(known, n // 2, n // 2 + m - n)
    of_queries, of_words, can = sums(points), sums(vectors(words)), _UP_AND_DOWN if m == n else _ONE_UP
    for own, leaf in tree.walk(points, 1, 1 if m == n else 0):
        members = tree.order[tree.begin[leaf] : tree.end[leaf]]
        for a in range(0, len(members), SQUARE):  # equal vectors can make a leaf long
            some = members[a : a + SQUARE]
            for b in range(0, len(own), SQUARE):
                q = own[b : b + SQUARE]
                i, j = np.nonzero(can[(of_words[some][None] - of_queries[q][:, None]) & 0xFFFF])
                i, j = q[i], some[j]
                alike = (first_q[i] == first_w[j]) | (second_q[i] == second_w[j])
                i, j = i[alike], j[alike]
                for c in range(0, len(i), rows):
                    left.append(i[c : c + rows])
                    right.append(j[c : c + rows])
                    held += len(left[-1])
                    if held >= rows:
                        yield verified()
                        left, right, held = [], [], 0
    if held:
        yield verified()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of words of so many letters that stand so often, after runs are altered."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w, n in Counter(_RUNS.findall((t or "").translate(_LOWER))).items():
                    found[altered(w, i)] += n
                if len(found) >= COUNTED:
                    yield pa.RecordBatch.from_pydict({"word": list(found), "n": pa.array(found.values(), pa.int64())})
                    found.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(found.values(), pa.int64())})

    common.small_batches(docs.sparkSession)
    each = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter((F.char_length("word") >= letters) & (F.col("n") >= occurrences))


def upper_trees(words: DataFrame, total: int, sample: int = SAMPLE, cell_words: int = CELL_WORDS) -> dict[int, Tree]:
    """The cells of each length, from a sample chosen by a hash of the word: at most about sample vectors reach the driver."""
    share = min(1.0, sample / max(1, total))

    def run(batches):
        for batch in common.gathered(batches, ASKING):
            own = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_pydict({"length": pa.array(map(len, own), pa.int32()), "vector": pa.array([v.tobytes() for v in vectors(own)], pa.binary())})

    chosen = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = chosen.select("word").mapInArrow(run, "length int, vector binary").toPandas().sort_values(["length", "vector"])
    leaf = max(LEAF, int(cell_words * share))
    return {int(n): Tree(np.frombuffer(b"".join(own), np.int32).reshape(-1, _DIMS), leaf, MOST_CELLS) for n, own in rows.groupby("length")["vector"]}


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    length = np.fromiter(map(len, words), np.int64, len(words))
    return {int(n): np.flatnonzero(length == n) for n in np.unique(length)}


def _cell(length: int, leaf) -> np.ndarray:
    return (length << CELL_BITS + 1) + leaf  # a tree of 2 ** CELL_BITS leaves has twice as many nodes


def _large_cells(words: DataFrame, trees, part_words: int, part_bytes: int) -> dict[int, int]:
    """Parts of the cells that are larger than a part: at most words / part_words of them."""

    def run(batches):
        for batch in common.gathered(batches, ASKING):
            own = batch.column("word").to_pylist()
            for n, at in _by_length(own).items():
                tree = trees.value.get(n)
                cells = tree.cells(vectors([own[i] for i in at])) if tree else np.zeros(len(at), np.int64)
                leaf, count = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(_cell(n, leaf)), "words": pa.array(count), "bytes": pa.array(count * n)})

    sizes = words.select("word").mapInArrow(run, "cell long, words long, bytes long").groupBy("cell").agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("words") / part_words), F.ceil(F.col("bytes") / part_bytes)).alias("parts")
    return {r.cell: int(r.parts) for r in sizes.select("cell", parts).filter("parts > 1").collect()}


def _routed(words: DataFrame, trees, large: dict[int, int]) -> DataFrame:
    """(cell, part, asks, word, n): each word once where it lies and wherever it asks."""

    def run(batches):
        for batch in common.gathered(batches, ASKING):
            own, count = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            hashed = np.fromiter((zlib.crc32(w.encode()) for w in own), np.int64, len(own))
            for n, at in _by_length(own).items():
                some = [own[i] for i in at]
                points = vectors(some)
                rows = []  # of (row, cell, part, asks)
                tree = trees.value.get(n)
                lies = _cell(n, tree.cells(points) if tree else np.zeros(len(at), np.int64))
                parts = np.array([large.get(c, 1) for c in lies.tolist()])
                rows.append((np.arange(len(at)), lies, hashed[at] % parts, False))
                for m in (n, n + 1):
                    tree = trees.value.get(m)
                    for asking, leaf in tree.walk(points, 1, 1 if m == n else 0) if tree else [(np.arange(len(at)), 0)]:
                        cell = int(_cell(m, leaf))
                        for part in range(large.get(cell, 1)):
                            rows.append((asking, np.full(len(asking), cell), np.full(len(asking), part), True))
                for row, cell, part, asks in rows:
                    if len(row):
                        yield pa.RecordBatch.from_pydict(
                            {"cell": pa.array(cell), "part": pa.array(part, pa.int32()), "asks": pa.array([asks] * len(row)), "word": pa.array([some[i] for i in row], pa.string()), "n": pa.array(count[at[row]], pa.int64())}
                        )

    return words.select("word", "n").mapInArrow(run, "cell long, part int, asks boolean, word string, n long")


def _found(routed: DataFrame) -> DataFrame:
    """(word, near, other_n, other): how many words are near in a cell, and the first of them by occurrences and code points."""

    def best(of: np.ndarray, other: np.ndarray, names: list[str], n: np.ndarray, rank: np.ndarray):
        """Of each ``of``: how many others, and the first by n descending, rank."""
        order = np.lexsort((rank[other], -n[other], of))
        of, other = of[order], other[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        return of[first], np.diff(np.r_[first, len(of)]), other[first]

    def run(batches):
        held = now = None
        for (cell, part, asks), rows in common.runs(batches, ["cell", "part", "asks"]):
            if not asks:
                words = rows.column("word").to_pylist()
                held, now = (words, np.array(rows.column("n")), Tree(vectors(words), LEAF)), (cell, part)
                continue
            if now != (cell, part):
                continue  # no word lies there
            words, count, tree = held
            place = np.argsort(np.argsort(np.array(words, object)))
            for batch in common.gathered(rows.to_batches(), ASKING):
                names, own = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for length, at in _by_length(names).items():
                    asked, own_n = [names[i] for i in at], own[at]
                    pairs = list(near_pairs(asked, words, tree))
                    if not pairs:
                        continue
                    q, w = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                    if not len(q):
                        continue
                    sides = [(q, w, asked, words, count, place)]
                    if length != len(words[0]):  # only the shorter word asks: tell the longer one
                        sides.append((w, q, words, asked, own_n, np.argsort(np.argsort(np.array(asked, object)))))
                    for of, other, of_names, other_names, n, rank in sides:
                        of, near, other = best(of, other, other_names, n, rank)
                        yield pa.RecordBatch.from_pydict(
                            {"word": [of_names[i] for i in of], "near": pa.array(near, pa.int64()), "other_n": pa.array(n[other], pa.int64()), "other": [other_names[i] for i in other]}
                        )

    return routed.mapInArrow(run, "word string, near long, other_n long, other string")


def neighbours(words: DataFrame, sample: int = SAMPLE, cell_words: int = CELL_WORDS, part_words: int = PART_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """words (word, n; each word once) with n_near, near_n and near: the number of words one edit away, and the most frequent of them (ties: the first in code-point order)."""
    spark = words.sparkSession
    total = words.count()
    trees = spark.sparkContext.broadcast(upper_trees(words, total, sample, cell_words))
    large = _large_cells(words, trees, part_words, part_bytes)
    routed = written(_routed(words, trees, large), "variants-routed")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * total // cell_words)
    found = _found(routed.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "asks"))
    first = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first"))
    both = words.join(near, "word", "left")
    return both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("first.less")).alias("near_n"), F.col("first.other").alias("near"))


def forms(near: DataFrame, times: int = TIMES) -> DataFrame:
    """neighbours with form and form_n: the near word where it stands so many times as often, else null."""
    is_form: Column = F.col("near_n") >= times * F.col("n")
    return near.select("word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """forms with root: the last word that forms lead to, the word itself where it has none."""
    steps = found.filter("form is not null").select("word", "form")
    named = steps.select(F.col("form").alias("word")).distinct()
    # forms that have a form: few, and the only ones that a chain goes on from
    links = written(steps.join(named, "word").select("word", F.col("form").alias("to")), "variants-links")
    while True:
        on = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        jumped = written(links.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "variants-links")
        links = jumped.select("word", "to")
        if not jumped.filter("moved").head(1):
            break
    end = links.select(F.col("word").alias("form"), F.col("to").alias("end"))
    return found.join(end, "form", "left").withColumn("root", F.coalesce("end", "form", "word")).select("word", "form", "root", "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with the forms that they are variants of."""
    words = written(word_counts(common.table(spark, sf_dir, "documents")), "variants-words")
    return roots(written(forms(neighbours(words)), "variants-forms"))
