"""N-gram Jaccard join: sets of word shingles whose likeness is at least a threshold, with a count-vector R-tree.

A document's set is its distinct shingles of ``SHINGLE`` words (non-space runs, A-Z lower-cased), as 64-bit hashes. Documents
with equal sets are one *node*; the smallest doc_id names them, or none where all their rows have a null id. Linked nodes are found in two steps.

1. *Candidates.* A node sends keys, and nodes with a common key become one candidate cluster by connected components. At high
   thresholds (``GROUPED``) keys are groups: two linked sets differ in at most d elements (at 0.9: a ninth of the smaller), so of d + 1 groups
   that elements are hashed into they have one wholly in common; its elements make the key, for the set's length class. Below, keys are single elements: all
   elements are put in one order, rare ones before those of very many documents, and two linked sets have an element in common
   in the first part (at 0.8: a fifth) of either. Passages that many documents share give no common keys either way: a group takes elements
   from the whole text, and common elements stand last in the order. Keys travel packed in buckets of about ``BUCKET_DOCS`` documents' keys
   each, so that a task holds little, however large the table.
   The nodes of a single element's key, ``PAIRED`` at most, are listed in pairs, and pairs are kept that have enough such keys in common: of two sets the one
   whose first part ends earlier in the order has there all that it shares with the other, so these shared elements and its rest bound the overlap. A passage that two long
   texts have in common does not connect them then, and clusters do not grow together as the table grows. Keys of more nodes, and of groups, join their nodes without counting:
   a task first joins the nodes of one key among themselves and sends on only its ends and a node in each size step, so a key that very many nodes share is no one's load.
2. *Pivots.* The node of a cluster that shares most keys is verified against all others, dealt out ``LEAVES`` at a time. A group of copies mostly ends here,
   in linear time; clusters that are then one component are done.
3. *Join within the other clusters.* Nodes fall apart again where they share no element of their prefixes, in the cluster's own order of elements. Group counts
   (elements hashed into a number of groups that suits the sets' sizes) are the points of a packed R-tree: the sum of coordinate minima bounds the overlap of two sets, or
   of a tile of sets and all below an inner entry. Pairs that pass the bound and are not yet connected are verified on the sets themselves. A cluster
   beyond ``BLOCK_ELEMENTS`` elements that keys of groups made is first taken apart by prefixes; what is still larger is dealt out as pairs of blocks, but for pairs of
   nodes that the pivot has joined. So no task's memory grows with a cluster.

Sets are exact up to collisions of 64-bit hashes with non-linear steps. No pair is lost and none is listed: the result names each document's
component, the smallest doc_id reachable by links, null where none of its rows has an id (rows of null id link like others). Null and empty texts have an empty set and are
linked with nothing; texts of any length are taken whole, a text in memory at a time; repeated rows share a component; an empty table gives an empty result;
of the input only doc_id (cast to long) and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.session import sound_unions

from . import common
from .common import written
from .components import components
from .hashing import mixed, span_hashes

SHINGLE, THRESHOLD, FANOUT = 3, Fraction(9, 10), 16
#: Bytes of a key, beyond its bucket, and of a node that candidates are found by (a chance agreement only enlarges a cluster);
#: documents to a bucket; keys that a task gathers before it sends them.
KEY_BYTES, SHORT_BYTES, BUCKET_DOCS, FLUSHED_KEYS = 6, 6, 1000, 500_000
#: Most nodes of a key that are listed in pairs; rows of keys whose pairs a task lists at once; the bit of a row's size that says its key has more nodes.
PAIRED, PAIRED_ROWS, CROWDED = 32, 65_536, 31
#: Threshold from which groups are the keys.
GROUPED = Fraction(88, 100)
#: Most common shingles whose rank tasks know; bytes of the table they stand in; elements that a task counts at once.
MOST_COMMON, CELLS, COUNTED = 8_000_000, 1 << 24, 2_000_000
#: Elements of a cluster that one task joins; most rows that are broadcast; nodes that a task remembers to have sent; nodes that one task holds against a pivot.
BLOCK_ELEMENTS, BROADCAST_ROWS, SEEN, LEAVES = 5_000_000, 300_000, 50_000, 256
#: Sets whose bounds are computed at once, against so many others.
TILE, TILED = 64, 4096

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    edges = np.cumsum([0, *(len(d) + 1 for d in data)])
    space = _SPACE[joined]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = span_hashes(_LOWER[joined], starts, ends)
    cuts = np.searchsorted(starts, edges + 1)
    runs = np.zeros(max(0, len(words) - size + 1), _U)
    for j in range(size):
        runs = mixed(runs + words[j : len(words) - size + 1 + j], j) if len(runs) else runs
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = np.zeros(1, _U)  # one sequence of fewer words
            for j in range(a, b):
                short = mixed(short + words[j], 1000 + int(j - a))
            out.append(mixed(short, 1000 + size))
        else:
            out.append(np.zeros(0, _U))
    return out


def length_classes(most: int = 1 << 40, ratio: float = 1.5) -> list[int]:
    """First length of each class."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


_CLASSES = np.array(length_classes())


def _differing(a: int, threshold: Fraction) -> int:
    """Most elements in which a set of a elements differs from one at least as large that it is linked with."""
    return int(a * (1 - threshold) / threshold)


def group_keys(elements: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """A key of each group, in the node's own length class and, where a smaller partner may be there, the one before."""
    n = len(elements)
    if not n:
        return np.zeros(0, np.int64)
    own = int(np.searchsorted(_CLASSES, n, "right")) - 1
    least = -(-n * threshold.numerator // threshold.denominator)  # of a smaller partner
    first = int(np.searchsorted(_CLASSES, least, "right")) - 1
    out, value, place = [], mixed(elements, 5), mixed(elements, 6) >> _U(8)
    for k in range(first, own + 1):
        groups = _differing(int(_CLASSES[k + 1]) - 1, threshold) + 1
        if groups == 1:
            continue  # only equal sets are linked
        sums = np.zeros(groups, _U)
        np.add.at(sums, (place % _U(groups)).astype(np.int64), value)
        out.append(mixed(sums + mixed(np.arange(groups, dtype=_U), 100 + k), 9).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_shingles(docs: DataFrame, size: int = SHINGLE, most: int = MOST_COMMON) -> np.ndarray:
    """A table of CELLS levels, by a shingle's hash: the binary logarithm of how many documents hold it, for the most common shingles (most of them at most), else 0.

    A task counts COUNTED elements at a time and sends those that it has met twice, so what is shuffled is a small part of the elements; a
    shingle of very many documents is met twice nearly everywhere. Levels only set an order, for which counts need not be exact nor cells be apart.
    """

    def count(batches):
        held, size_held = [], 0

        def flush():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"shingle": pa.array(value[n > 1].view(np.int64)), "n": pa.array(n[n > 1])})

        for batch in batches:
            for s in shingle_sets(batch.column("text").to_pylist(), size):
                held.append(s)
                size_held += len(s)
            if size_held > COUNTED:
                yield flush()
                held, size_held = [], 0
        if size_held:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    levels = written(counts.select(F.pmod("shingle", F.lit(CELLS)).cast("int").alias("cell"), F.floor(F.log2("n")).cast("byte").alias("level")), "common")
    least, total = 64, 0
    for row in sorted(levels.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):  # a row a power of two
        total += row.k
        if total > most:
            break
        least = row.level
    chosen = levels.filter(F.col("level") >= least).groupBy("cell").agg(F.max("level").alias("level")).toArrow()  # most rows at most
    table = np.zeros(CELLS, np.uint8)
    table[chosen["cell"].to_numpy()] = chosen["level"].to_numpy()
    return table


def grouped(threshold: Fraction) -> bool:
    """Are groups the better keys? They hold threshold / (1 - threshold) elements on average, and few say little."""
    return threshold >= GROUPED


def prefix(elements: np.ndarray, common: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """The elements that come first in an order of all elements, rare before common: two linked sets have one of these in common."""
    n = len(elements)
    if not n:
        return elements
    value = mixed(elements, 5)
    needed = -(-n * threshold.numerator // threshold.denominator)
    return value[np.lexsort((value, common[(elements.view(np.int64) % CELLS)]))[: n - needed + 1]]


def node_id(elements: np.ndarray) -> int:
    """Names a set: 64 bits as a signed integer."""
    total = mixed(np.array([mixed(elements, 3).sum(dtype=_U) + _U(len(elements))], _U), 4)
    return int(total.view(np.int64)[0])


def sets_of(docs: DataFrame, size: int = SHINGLE, kept: tuple[str, ...] = ("doc_id",), text: bool = False) -> DataFrame:
    """(n, node) of every document, after the columns that are kept; with text, before its text."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            out = {c: batch.column(c) for c in kept} | {"n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([node_id(s) for s in sets], pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"text": batch.column("text")} if text else {}))

    common.small_batches(docs.sparkSession)
    chosen = docs.select(*kept, "text")
    fields = [chosen.schema[c].simpleString().replace(":", " ", 1) for c in kept] + ["n long", "node long"] + ["text string"] * text
    return chosen.mapInArrow(run, ", ".join(fields))


def needed_keys(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Least number of elements that prefixes of linked sets of a and b elements have in common: what the overlap has beyond the longer rest."""
    p, q = threshold.numerator, threshold.denominator
    return -(-p * (a + b) // (p + q)) - (-(-np.maximum(a, b) * p // q) - 1)


def _packed(docs: DataFrame, buckets: int, size: int, threshold: Fraction, common: np.ndarray, by_group: bool) -> DataFrame:
    """The keys of all nodes, dealt to buckets: KEY_BYTES of each key, SHORT_BYTES of its node and the node's size, many in a row. A task sends a set once.

    Where a task has more than PAIRED nodes of one key, or keys are groups, of the nodes in runs of sizes without too large a step only a run's ends and the ends of each step on a
    scale of sizes go on; they stand in for the run, whose other nodes are joined to its first here. Such edges are rows of a bucket below 0. A key is also taken
    for crowded if its shortened form stands twice in one set, as counts of shared keys would be too small.
    """
    held_common = docs.sparkSession.sparkContext.broadcast(common)  # CELLS bytes at most
    p, q = threshold.numerator, threshold.denominator
    scale = 0.9 * np.log(q / p)

    def narrow(values: np.ndarray, width: int) -> np.ndarray:
        return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]

    def flushed(keys: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
        times = [len(k) for k in keys]
        key, node, n = np.concatenate(keys), np.repeat(np.array(nodes, np.int64).view(_U), times), np.repeat(np.array(sizes, np.int64), times)
        bucket, key = (key % _U(buckets)).astype(np.int64), (key // _U(buckets)) & _U((1 << 8 * KEY_BYTES) - 1)
        order = np.lexsort((node, n, key, bucket))
        bucket, key, node, n = bucket[order], key[order], node[order], n[order]
        new = np.append(True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1]))
        times = np.diff(np.append(np.flatnonzero(new), len(key)))
        crowd = times > (1 if by_group else PAIRED)
        crowd[(np.cumsum(new) - 1)[1:][(node[1:] == node[:-1]) & ~new[1:]]] = True
        crowded = np.repeat(crowd, times)
        begin = new | np.append(True, n[:-1] * q < n[1:] * p)
        step = np.floor(np.log(n) / scale)
        first = begin | np.append(True, step[1:] != step[:-1])
        kept = first | np.append(first[1:], True) | ~crowded
        hub = node[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]
        local = np.concatenate([narrow(hub[~kept], SHORT_BYTES), narrow(node[~kept], SHORT_BYTES)], axis=1)
        row = np.concatenate([narrow(key[kept], KEY_BYTES), narrow(node[kept], SHORT_BYTES), narrow((n | crowded.astype(np.int64) << CROWDED)[kept].view(_U), 4)], axis=1)
        bucket = bucket[kept]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        names, rows = bucket[start].tolist(), [row[a:b].tobytes() for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True)]
        if len(local):
            names.append(-1 - int(bucket[0]))
            rows.append(np.unique(local, axis=0).tobytes())
        return pa.RecordBatch.from_pydict({"bucket": pa.array(names, pa.int64()), "rows": pa.array(rows, pa.binary())})

    def run(batches):
        seen: set[int] = set()
        keys, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text").to_pylist(), size):
                node = node_id(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                keys.append(group_keys(s, threshold).view(_U) if by_group else prefix(s, held_common.value, threshold))
                nodes.append(node)
                sizes.append(len(s))
                held += len(keys[-1])
            if held > FLUSHED_KEYS:
                yield flushed(keys, nodes, sizes)
                keys, nodes, sizes, held = [], [], [], 0
        if held:
            yield flushed(keys, nodes, sizes)

    return docs.select("text").mapInArrow(run, "bucket long, rows binary")


def _edges(packed: DataFrame, threshold: Fraction, by_group: bool) -> DataFrame:
    """Edges (a, b, shared, needed) of shortened nodes, a task holding one bucket at a time.

    Of a crowded key's nodes, in order of size, each has one to the first of a run without too large a step: needed is 0. Of other keys' nodes all pairs of like size have one, with
    how many keys of the bucket they share, and how many they must share in all. Linked nodes that share a crowded key are in one run, so all keys of the others are counted.
    """
    width, p, q, most = KEY_BYTES + SHORT_BYTES + 4, threshold.numerator, threshold.denominator, 1 if by_group else PAIRED

    def wide(data: np.ndarray, a: int, b: int) -> np.ndarray:
        out = np.zeros((len(data), 8), np.uint8)
        out[:, : b - a] = data[:, a:b]
        return out.view("<i8").ravel()

    def edges(a: np.ndarray, b: np.ndarray, shared: np.ndarray, needed: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "shared": pa.array(shared, pa.int64()), "needed": pa.array(needed, pa.int64())})

    def sure(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return edges(a, b, np.ones(len(a), np.int64), np.zeros(len(a), np.int64))

    def known(rows: bytes) -> pa.RecordBatch:
        data = np.frombuffer(rows, np.uint8).reshape(-1, 2 * SHORT_BYTES)
        return sure(wide(data, 0, SHORT_BYTES), wide(data, SHORT_BYTES, 2 * SHORT_BYTES))

    def star(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        begin = np.append(True, (key[1:] != key[:-1]) | (n[:-1] * q < n[1:] * p))
        hub = node[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]
        return sure(*np.unique(np.stack([hub, node])[:, hub != node], axis=1))

    def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
        found = []
        for d in range(1, most):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            i = i[(n[i] * q >= n[i + d] * p) & (node[i] != node[i + d])]
            found.append(np.stack([node[i], node[i + d], needed_keys(n[i], n[i + d], threshold)]))
        if not found or not sum(f.shape[1] for f in found):
            return None
        a, b, needed = (x := np.concatenate(found, axis=1))[:, np.lexsort(x[::-1])]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return edges(a[first], b[first], np.diff(np.append(first, len(a))), needed[first])

    def joined(rows: list[bytes]):
        data = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
        key, node, n = wide(data, 0, KEY_BYTES), wide(data, KEY_BYTES, KEY_BYTES + SHORT_BYTES), wide(data, KEY_BYTES + SHORT_BYTES, width)
        crowded, n = n >> CROWDED, n & ((1 << CROWDED) - 1)
        order = np.lexsort((node, n, key))
        key, node, n, crowded = key[order], node[order], n[order], crowded[order]
        new = np.append(True, key[1:] != key[:-1])
        once = new | np.append(True, node[1:] != node[:-1])  # several tasks may send a set
        place = np.cumsum(new) - 1
        times = np.bincount(place, once).astype(np.int64)
        crowd = (times > most) | (np.bincount(place, crowded) > 0)
        if crowd.any():
            yield star(*(x[once & crowd[place]] for x in (key, node, n)))
        alone = once & (~crowd & (times > 1))[place]
        key, node, n = key[alone], node[alone], n[alone]
        if not len(key):
            return
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cuts = begin[np.append(True, begin[1:] // PAIRED_ROWS != begin[:-1] // PAIRED_ROWS)]
        for x, y in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
            if (found := pairs(key[x:y], node[x:y], n[x:y])) is not None:
                yield found

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            for b, r in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if b < 0:
                    yield known(r)
                    continue
                if b != bucket and rows:
                    yield from joined(rows)
                    rows = []
                bucket = b
                rows.append(r)
        if rows:
            yield from joined(rows)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, shared long, needed long")


class CountTree:
    """A packed R-tree over group counts: entries sorted along the coordinates, FANOUT to a parent."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        self.levels = []
        high, low = counts, sizes
        while len(high) > FANOUT:
            cut = np.arange(0, len(high), FANOUT)
            high, low = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut)
            self.levels.append((high, low))

    @staticmethod
    def order(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tiles of equal numbers by size, then by the leading groups."""
        return np.lexsort((*counts.T[:4], sizes))

    def partners(self, tile: np.ndarray, threshold: Fraction) -> np.ndarray:
        """Entries from the tile's first on whose bound lets them be linked with one of the tile (places in a row, sorted)."""
        p, q = threshold.numerator, threshold.denominator
        top, least = self.counts[tile].max(0), int(self.sizes[tile].min())
        fits = lambda high, low: (p + q) * np.minimum(high, top).sum(1, dtype=np.int64) >= p * (least + low)
        at = None
        for high, low in reversed(self.levels):
            at = np.arange(len(high)) if at is None else at[at < len(high)]
            at = at[fits(high[at], low[at])]
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        at = np.arange(len(self.sizes)) if at is None else at
        at = at[(at >= tile[0]) & (at < len(self.sizes))]
        return at[fits(self.counts[at], self.sizes[at])]

    def pairs(self, threshold: Fraction, apart=None):
        """(i, j) arrays of entries, i before j, whose bound lets them be linked; apart(i, j) tells which pairs are still wanted."""
        p, q = threshold.numerator, threshold.denominator
        for begin in range(0, len(self.sizes), TILE):
            tile = np.arange(begin, min(begin + TILE, len(self.sizes)))
            near = self.partners(tile, threshold)
            for cut in range(0, len(near), TILED):
                at = near[cut : cut + TILED]
                bound = np.zeros((len(tile), len(at)), np.int64)
                for c in range(self.counts.shape[1]):
                    bound += np.minimum(self.counts[tile, c][:, None], self.counts[at, c])
                i, j = np.nonzero(((p + q) * bound >= p * (self.sizes[tile][:, None] + self.sizes[at])) & (tile[:, None] < at))
                i, j = tile[i], at[j]
                if apart is not None:
                    wanted = apart(i, j)
                    i, j = i[wanted], j[wanted]
                if len(i):
                    yield i, j


def dimensions(n: int, threshold: Fraction) -> int:
    """Groups to count the elements of sets of n in, so that the bound tells sets apart that have nothing in common.

    Counts of two such sets differ by about 1.13 sqrt(n k) in all, linked ones by 2 n r at most, r = (1 - threshold) / (1 + threshold); k is four times what makes these equal.
    """
    r = float((1 - threshold) / (1 + threshold))
    return 1 << min(10, max(5, int(12.5 * r * r * n).bit_length()))


class Groups:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def find(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.above[self.find(j)] = self.find(i)

    def labels(self) -> np.ndarray:
        label = np.array(self.above, np.int64)
        while (label[label] != label).any():
            label = label[label]
        return label


def prefix_cells(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """A number for each set, different where no chain of shared prefix elements connects two sets: prefixes in the order of how many of these sets have an element."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    order = np.lexsort((element, count[element], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    needed = -(-sizes * threshold.numerator // threshold.denominator)
    first = order[place < np.repeat(sizes - needed + 1, sizes)]
    shared = first[count[element[first]] > 1]
    by_element = shared[np.argsort(element[shared], kind="stable")]
    token, node = element[by_element], owner[by_element]
    if not len(token):
        return np.arange(len(sets))
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(begin, len(token)))
    label = np.arange(len(sets))
    while True:
        least = np.repeat(np.minimum.reduceat(label[node], begin), length)
        new = label.copy()
        np.minimum.at(new, node, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def alike(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    """Are two sorted sets linked?"""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * threshold.denominator < len(large) * threshold.numerator:
        return False
    place = np.searchsorted(large, small)
    both = int((large[np.minimum(place, len(large) - 1)] == small).sum())
    return (threshold.numerator + threshold.denominator) * both >= threshold.numerator * (len(a) + len(b))


def linked_groups(sets: list[np.ndarray], threshold: Fraction = THRESHOLD, side: np.ndarray | None = None, joined: np.ndarray | None = None) -> np.ndarray:
    """A number for each set, equal where links connect sets; with side, only pairs of different sides are looked at; sets flagged joined are known to be connected."""
    groups = Groups(len(sets))
    for i in np.flatnonzero(joined).tolist() if joined is not None else ():
        groups.join(int(np.flatnonzero(joined)[0]), i)
    cells = prefix_cells(sets, threshold)
    by_cell = np.argsort(cells, kind="stable")
    for own in np.split(by_cell, np.flatnonzero(np.diff(cells[by_cell])) + 1):
        if len(own) < 2:
            continue
        sizes = np.array([len(sets[i]) for i in own])
        k = dimensions(int(np.median(sizes)), threshold)
        counts = np.stack([np.bincount((sets[i] % _U(k)).astype(np.int64), minlength=k) for i in own]).astype(np.int32)
        order = CountTree.order(counts, sizes)
        own = own[order]

        def apart(i: np.ndarray, j: np.ndarray, own=own) -> np.ndarray:
            label = groups.labels()
            wanted = label[own[i]] != label[own[j]]
            return wanted if side is None else wanted & (side[own[i]] != side[own[j]])

        for i, j in CountTree(counts[order], sizes[order]).pairs(threshold, apart):
            for a, b in zip(own[i].tolist(), own[j].tolist(), strict=True):
                if groups.find(a) != groups.find(b) and alike(sets[a], sets[b], threshold):
                    groups.join(a, b)
    return groups.labels()


_TEXTS = "cluster long, node long, packed binary"


def _compressed(texts: DataFrame) -> DataFrame:
    """(cluster, node, packed) of texts: compressed they take a third of what their sets do."""

    def run(batches):
        for batch in batches:
            small = [zlib.compress((t or "").encode("utf-8", "replace"), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("cluster", "node")} | {"packed": pa.array(small, pa.binary())})

    return texts.select("cluster", "node", "text").mapInArrow(run, _TEXTS)


def _set_of(packed: bytes, node: int, size: int) -> np.ndarray | None:
    """The node's set; None where the text is another's, as an id may stand on several texts."""
    s = shingle_sets([zlib.decompress(packed).decode()], size)[0]
    return s if node_id(s) == node else None


_EDGES = "a long, b long"


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64))})


def _pivot_links(texts: DataFrame, pivots: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """(a, b): nodes b linked with a, their cluster's pivot. The pivot's text goes to each part of its cluster; a task holds one text beside it."""

    def run(batches):
        key, pivot, hub = None, None, 0
        for batch in batches:
            a, b = [], []
            for cluster, part, node, leaf, packed in zip(*(batch.column(c).to_pylist() for c in ("cluster", "part", "node", "leaf", "packed")), strict=True):
                if (cluster, part) != key:
                    key, pivot = (cluster, part), None
                if leaf and pivot is None:
                    continue
                found = _set_of(packed, node, size)
                if not leaf:
                    pivot, hub = (found, node) if found is not None else (pivot, hub)
                elif found is not None and alike(pivot, found, threshold):
                    a.append(hub)
                    b.append(node)
            yield _pairs_batch(a, b)

    own = F.pmod(F.hash("node"), F.col("parts"))
    placed = texts.join(pivots, "cluster").withColumn("leaf", F.col("node") != F.col("pivot"))
    dealt = placed.withColumn("part", F.explode(F.when(F.col("leaf"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return dealt.select("cluster", "part", "node", "leaf", "packed").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "leaf").mapInArrow(run, _EDGES)


def _stars(texts: DataFrame, dealt: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """Stars (a, b) around the smallest node of each linked group in a pair of blocks."""

    def stars(key, rows):
        sets = [_set_of(r[3], r[0], size) for r in rows]
        own = [i for i, s in enumerate(sets) if s is not None]
        if len(own) < 2:
            return np.zeros((2, 0), np.int64)
        nodes = np.array([rows[i][0] for i in own], np.int64)
        side = None if key[1] == key[2] else np.array([rows[i][1] for i in own])
        group = linked_groups([sets[i] for i in own], threshold, side, np.array([rows[i][2] for i in own]))
        order = np.lexsort((nodes, group))
        first = np.append(True, group[order][1:] != group[order][:-1])
        hub = nodes[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        return np.stack([hub, nodes[order]])[:, hub != nodes[order]]

    def link(batches):
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "p", "q", "node", "block", "joined", "packed")]
            for cluster, p, q, *row in zip(*columns, strict=True):
                if (cluster, p, q) != key:
                    if len(rows) > 1:
                        yield _pairs_batch(*stars(key, rows))
                    key, rows = (cluster, p, q), []
                if not rows or row[0] != rows[-1][0] or row[3] != rows[-1][3]:
                    rows.append(row)
        if len(rows) > 1:
            yield _pairs_batch(*stars(key, rows))

    placed = texts.join(dealt.drop("cluster"), "node").withColumn("other", F.explode("others"))
    pairs = placed.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    return pairs.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "node").mapInArrow(link, _EDGES)


def _texts_of(base: DataFrame, named: DataFrame, few: bool) -> DataFrame:
    """named (doc_id, hashed and more) with the nodes' texts: by id and the text's hash, so rows that share an id, or have none, meet their own node only."""
    wanted = named.withColumnsRenamed({"doc_id": "_id", "hashed": "_hashed"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hashed") == F.col("_hashed"))
    return base.select("doc_id", "hashed", "text").join(F.broadcast(wanted) if few else wanted, same).drop("doc_id", "hashed", "_id", "_hashed")


def _clustered(base: DataFrame, nodes: DataFrame, size: int, threshold: Fraction, by_group: bool, tag: str) -> DataFrame:
    """(node, n, rep, degree, cluster) of the nodes that share a key, or enough of them, with another one of base; degree: edges that it is the hub of, in each bucket."""
    buckets = 1 << max(6, (nodes.count() // BUCKET_DOCS).bit_length())
    common = np.zeros(0, np.uint8) if by_group else common_shingles(base, size)
    found = _edges(_packed(base, buckets, size, threshold, common, by_group), threshold, by_group)
    if by_group:
        edges = found.select("a", "b", F.lit(1).alias("times"))
    else:
        counted = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.sum("shared").alias("shared"), F.min("needed").alias("needed"))
        edges = counted.filter("shared >= needed").select("a", "b", "times")
    edges = written(edges, f"{tag}-edges")
    degrees = edges.groupBy(F.col("a").alias("short")).agg(F.sum("times").alias("degree"))
    clusters = components(edges, tag).select(F.col("node").alias("short"), F.col("component").alias("cluster")).join(degrees, "short", "left").fillna(0, ["degree"])
    shortened = nodes.withColumn("short", F.col("node").bitwiseAND(F.lit((1 << 8 * SHORT_BYTES) - 1)))
    return written(shortened.join(clusters, "short").drop("short"), f"{tag}-members")


def _linked(base: DataFrame, nodes: DataFrame, size: int, threshold: Fraction, block_elements: int) -> DataFrame:
    """(node, component): every node that has a link, and the smallest node reachable."""
    found = _clustered(base, nodes, size, threshold, grouped(threshold), "clusters")

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("rep").alias("doc_id"), F.col("rep_hashed").alias("hashed"), "cluster", "node")

    def summed(df: DataFrame) -> DataFrame:
        # written, as a join with an aggregate of its own rows would meet a large cluster in one task
        return written(df.groupBy("cluster").agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("members"), F.max_by("node", F.struct("degree", "node")).alias("pivot")), "sums")

    sums = summed(found)
    count, most = sums.agg(F.sum("members"), F.max("elements")).first()
    if grouped(threshold) and (most or 0) > block_elements:  # take apart what only parts of sets hold together
        large = written(found.join(sums.filter(F.col("elements") > block_elements).select("cluster"), "cluster", "left_semi"), "large")
        again = _clustered(_texts_of(base, named(large), False), large.select("node", "n", "rep", "rep_hashed"), size, threshold, False, "apart")
        found = written(found.join(large.select("node"), "node", "left_anti").unionByName(again), "members")
        sums = summed(found)
    texts = written(_compressed(_texts_of(base, named(found), (count or 0) <= BROADCAST_ROWS)), "texts")
    pivots = sums.select("cluster", "pivot", F.ceil(F.col("members") / LEAVES).cast("int").alias("parts"))
    to_pivot = written(_pivot_links(texts, pivots, size, threshold).distinct(), "pivots")

    joined = to_pivot.select(F.col("b").alias("node")).unionByName(to_pivot.select(F.col("a").alias("node"))).distinct().withColumn("joined", F.lit(True))
    marked = found.join(joined, "node", "left").fillna(False, ["joined"])
    part = lambda flag: F.coalesce(F.sum(F.when(F.col("joined") == flag, F.col("n"))), F.lit(0))
    rest = marked.groupBy("cluster").agg(part(False).alias("rest"), part(True).alias("group")).filter("rest > 0")
    whole = F.col("rest") + F.col("group") <= block_elements
    blocks = lambda c: F.ceil(2 * F.col(c) / block_elements).cast("int")
    shares = rest.select("cluster", F.when(whole, 1).otherwise(blocks("rest")).alias("k"), F.when(whole, 0).otherwise(blocks("group")).alias("m"))
    place = F.when(F.col("joined") & (F.col("m") > 0), F.col("k") + F.pmod(F.hash("node"), F.greatest("m", F.lit(1)))).otherwise(F.pmod(F.hash("node"), F.col("k")))
    others = F.sequence(F.lit(0), F.when(F.col("joined") & (F.col("m") > 0), F.col("k") - 1).otherwise(F.col("k") + F.col("m") - 1))
    dealt = written(marked.join(written(shares, "shares"), "cluster").select("cluster", "node", "joined", "k", "m", place.alias("block"), others.alias("others")), "dealt")
    stars = written(_stars(texts, dealt.select("cluster", "node", "joined", "block", "others"), size, threshold).distinct(), "links")
    if not dealt.filter("k + m > 1").isEmpty():
        return components(to_pivot.unionByName(stars), "links")
    closed = to_pivot.join(dealt.select(F.col("node").alias("a")), "a", "left_anti").unionByName(stars)  # whole stars: an open cluster's hold its pivot's links
    hubs = closed.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("component"))
    return closed.join(hubs, "a").select(F.col("b").alias("node"), "component").unionByName(hubs.select(F.col("a").alias("node"), "component"))


def _classified(docs: DataFrame, size: int, threshold: Fraction, block_elements: int, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, n, class, component_id) of every row of docs: class is the smallest node reachable, null for an empty set."""
    base = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*kept, "text").withColumn("hashed", F.xxhash64("text"))
    sound_unions(docs.sparkSession)
    sets = written(sets_of(base, size, (*kept, "hashed")), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hashed")).alias("f")
    nodes = sets.filter("n > 0").groupBy("node", "n").agg(first).select("node", "n", F.col("f.doc_id").alias("rep"), F.col("f.hashed").alias("rep_hashed"))
    known = _linked(base, nodes, size, threshold, block_elements).join(nodes.select("node", "rep"), "node")
    known = written(known, "known")
    smallest = written(known.groupBy("component").agg(F.min("rep").alias("smallest")), "smallest")
    joined = known.join(smallest, "component").select("node", "component", "smallest")
    classes = nodes.join(joined, "node", "left").select("node", "n", F.coalesce("component", "node").alias("class"), F.coalesce("smallest", "rep").alias("component_id"))
    linked_docs = sets.filter("n > 0").join(classes, ["node", "n"]).select(*kept, "n", "class", "component_id")
    alone = sets.filter("n = 0").select(*kept, "n", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"))
    return linked_docs.unionByName(alone)


def near_classes(docs: DataFrame, size: int = SHINGLE, threshold: Fraction = THRESHOLD, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text)."""
    return _classified(docs.select("doc_id", "text"), size, threshold, block_elements).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: Fraction = THRESHOLD, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """docs with one row of each component: the smallest id, null ids last, then by hashes of the text and of the row. Rows without words are linked with nothing and stay.

    Components are of texts, not of ids: rows that share an id, or have none, are rows of their own. Rows are known by two 64-bit hashes, and only these are grouped.
    """
    worded = F.coalesce(F.col("text").rlike(common.NON_SPACE), F.lit(False))
    marked = docs.filter(worded).withColumn("_text", F.xxhash64("text")).withColumn("_row", F.xxhash64(*docs.columns))
    rows = _classified(marked.select("doc_id", "text", "_text", "_row"), size, threshold, block_elements, ("doc_id", "_text", "_row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text", "_row")).alias("f")
    chosen = written(rows.groupBy("class").agg(first).select("f._text", "f._row"), "chosen")
    kept = marked.join(chosen, ["_text", "_row"], "left_semi").dropDuplicates(["_text", "_row"])  # a wholly equal row stands once
    return kept.select(*docs.columns).unionByName(docs.filter(~worded))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links at nine tenths."""
    return near_classes(common.table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, rid, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), e AS (
  SELECT rid, len(g) AS n, unnest(g) AS h FROM s
), p AS (
  SELECT a.rid AS x, b.rid AS y FROM e a JOIN e b ON a.h = b.h AND a.rid <> b.rid AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT rid AS x, rid AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(o.doc_id)::BIGINT AS component_id
FROM s JOIN r ON s.rid = r.x JOIN s o ON o.rid = r.y GROUP BY s.rid, s.doc_id, s.g
"""
