"""Suffix-array dedup: remove every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too.

Strings ("windows") never cross documents, overlaps count, and all are judged on the input. A sorted table of all
suffixes is not needed for this, only which windows are equal, so suffixes are compared where they meet:

1. *Gathering.* Each window is named by the smallest hash of its ``GRAM``-byte grams. A *stretch* is a run of window starts
   with one name; equal windows have one name, wherever they stand. Equal stretches are one class, known by name and a second hash; one text of each class is looked at, and whether it
   occurs elsewhere too. A class that has its name to itself and occurs once has no repeats.
2. *Bucket-pointer refinement* finds the equal windows among the classes of a name: suffixes start in buckets by their first ``Q`` bytes;
   buckets are refined by sorting on the bucket of the suffix Q further on, and the refined buckets serve the next pass in
   turn (2Q, 4Q, ... up to LENGTH). Suffixes alone in a bucket leave at once, unless their class occurs elsewhere.
3. *Hot names.* A name of more than ``HOT`` classes is not one task's work: a short line that stands in very many documents names stretches that differ around it. Its windows are
   split into those whose anchor (the first place of the smallest gram) lies in the first and in the second half of where it can lie, and each half by the bytes that all its windows share; equal
   windows stay together. What is still hot is split again, until windows of one anchor place share all their bytes and are one class. The parts are refined like names.
4. *Removal.* Repeated windows go back to all places of their stretch; each document's are merged and cut out.

Classes are told apart by 125 bits of hashes, texts by a 64-bit hash and their length; which windows are equal within them is decided on their bytes. Null texts are empty; texts shorter than
LENGTH lose nothing; texts of any length are read whole, one at a time; of repeated texts (and rows) of LENGTH bytes or more nothing is left; an empty table gives an empty result; rows may share a doc_id or have
none, and each is judged on its own; of the input only doc_id (of any type) and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.session import sound_unions

from . import common
from .common import written
from .hashing import BYTE_VALUES, mixed, run_hashes

LENGTH, GRAM, Q = 200, 32, 8
#: Classes of a name up to which one task refines them as they are; bytes that are refined, or scanned, at once; texts that a
#: task remembers to have sent.
HOT, REFINED_BYTES, SCANNED_BYTES, SEEN = 2000, 4_000_000, 250_000, 200_000

_U = np.uint64


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes from each position on, by doubling; gram is a power of two."""
    h, k = BYTE_VALUES[data], 1
    while k < gram:
        h = mixed(h[:-k] * _U(3) + (h[k:] ^ (h[k:] >> _U(29))), k) if len(h) > k else h[:0]
        k *= 2
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values, by doubling."""
    out, k = values, 1
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    return np.minimum(out[: len(values) - width + 1], out[width - k :][: len(values) - width + 1]) if width > k else out


def window_maxima(values: np.ndarray, width: int) -> np.ndarray:
    return ~window_minima(~values, width)


def stretches(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window start, windows, name, hash, twice) of each stretch; twice: its name stands twice in the text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.cumsum([0, *map(len, texts)])
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, bool),)
    width = length - gram + 1
    grams = gram_hashes(data, gram)
    names = window_minima(grams, width)
    start = np.arange(len(names))
    text = np.searchsorted(edges, start, "right") - 1
    whole = start + length <= edges[text + 1]
    begin = whole & np.append(True, ~whole[:-1] | (names[1:] != names[:-1]))
    end = whole & np.append(begin[1:] | ~whole[1:], True)
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    name, own = names[first], text[first]
    # a gram that is the smallest of one of its windows: that window's name is the greatest of them that it may equal
    known = np.where(whole, names, 0)
    around = window_maxima(np.concatenate([np.zeros(width - 1, _U), known, np.zeros(width - 1, _U)]), width)
    anchor = np.flatnonzero(grams == around[: len(grams)])
    pair = mixed(grams[anchor] ^ mixed((np.searchsorted(edges, anchor, "right") - 1).astype(_U), 21), 22)
    value, n = np.unique(pair, return_counts=True)
    often = value[n > 1]
    twice = np.isin(mixed(name ^ mixed(own.astype(_U), 21), 22), often)
    return own, first - edges[own], last - first + 1, name.view(np.int64), run_hashes(data, first, last + length).view(np.int64), twice


def _numbered(values: np.ndarray, double: np.ndarray) -> np.ndarray:
    """Equal numbers for equal values, 0 for a value that stands alone and is not flagged double."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    number = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))
    times = np.bincount(number) + np.bincount(number, weights=double[order])
    out = np.empty(len(values), np.int64)
    out[order] = np.where(times[number] > 1, number, 0)
    return out


def refined(pieces: list[bytes], length: int = LENGTH, q: int = Q, again: list[bool] | None = None) -> np.ndarray:
    """For each byte of the joined pieces a bucket: the same for equal strings of length bytes, 0 for one that stands alone or runs out of its piece. Pieces flagged again occur elsewhere as well."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = list(map(len, pieces))
    stop = np.repeat(np.cumsum(sizes), sizes)
    double = np.repeat(np.array(again, bool) if again is not None else np.zeros(len(pieces), bool), sizes)
    bucket = np.zeros(len(data), np.int64)
    at = np.flatnonzero(np.arange(len(data)) + q <= stop)
    packed = np.zeros(len(at), _U)
    for j in range(q):
        packed = packed << _U(8) | data[at + j].astype(_U)
    bucket[at] = _numbered(packed, double[at])
    depth = q
    while depth < length:
        ahead = min(depth, length - depth)
        at = at[(bucket[at] > 0) & (at + ahead + depth <= stop[at])]
        at = at[bucket[at + ahead] > 0]
        pointers = bucket[at] * (bucket.max() + 1) + bucket[at + ahead]
        bucket = np.zeros(len(data), np.int64)
        bucket[at] = _numbered(pointers, double[at]) if len(at) else 0
        depth += ahead
    return bucket


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    padded = np.concatenate([[False], flags, [False]])
    return np.flatnonzero(padded[1:-1] & ~padded[:-2]), np.flatnonzero(padded[1:-1] & ~padded[2:])


def _scanned(docs: DataFrame, length: int) -> DataFrame:
    """Stretches of docs (doc_id, data, th, size). A task sends those of one text once."""

    def blocks(data: list[bytes]):
        size = begin = 0
        for i, d in enumerate(data):
            size += len(d)
            if size >= SCANNED_BYTES or i == len(data) - 1:
                yield begin, i + 1
                size, begin = 0, i + 1

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            th, size = batch.column("th"), batch.column("size")
            take = []
            for i, t in enumerate(zip(th.to_pylist(), size.to_pylist(), strict=True)):
                if t not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(t)
                    take.append(i)
            ids, data = batch.column("doc_id").take(pa.array(take, pa.int64())), batch.column("data").take(pa.array(take, pa.int64())).to_pylist()
            th, size = th.take(pa.array(take, pa.int64())), size.take(pa.array(take, pa.int64()))
            for a, b in blocks(data):
                own, first, n, name, whole, twice = stretches(data[a:b], length)
                yield pa.RecordBatch.from_pydict(
                    {
                        "th": th.slice(a, b - a).take(pa.array(own)), "size": size.slice(a, b - a).take(pa.array(own)), "doc_id": ids.slice(a, b - a).take(pa.array(own)), "first": pa.array(first.astype(np.int32)),
                        "n": pa.array(n.astype(np.int32)), "name": pa.array(name), "whole": pa.array(whole), "twice": pa.array(twice),
                    }
                )

    return docs.select("doc_id", "data", "th", "size").mapInArrow(run, f"th long, size int, {_id(docs)}, first int, n int, name long, whole long, twice boolean")


def _id(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def _packed(docs: DataFrame) -> DataFrame:
    """docs with their data compressed, for the shuffles that move whole texts."""

    def run(batches):
        for batch in batches:
            small = [zlib.compress(d, 1) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "th", "size")} | {"packed": pa.array(small, pa.binary())})

    return docs.select("doc_id", "th", "size", "data").mapInArrow(run, f"{_id(docs)}, th long, size int, packed binary")


_PIECE = "key long, cls long, again boolean, piece binary"
_PART = f"{_PIECE}, name long, lo int, hi int, of_name long, of_whole long, at int"


def _cut(found: DataFrame, length: int) -> DataFrame:
    """The bytes of each stretch of found (packed data, spans): key is its name, cls its hash."""

    def run(batches):
        for batch in batches:
            rows = []
            for data, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = zlib.decompress(data)
                rows += [(x["name"], x["whole"], x["again"], data[x["first"] : x["first"] + x["n"] + length - 1]) for x in spans]
            for a in range(0, len(rows), 2000):
                yield _batch(_PIECE, rows[a : a + 2000])

    return found.select("packed", "spans").mapInArrow(run, _PIECE)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_pydict({name: pa.array(list(c), _KINDS[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


_VERDICT = "key long, cls long, starts array<int>, ends array<int>"


def _refine(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated window starts of each piece, as runs; pieces of a key meet in one task."""

    def verdicts(rows):
        bucket = refined([r[3] for r in rows], length, Q, [r[2] for r in rows])
        out, at = [], 0
        for key, cls, _, piece in rows:
            starts, ends = _runs(bucket[at : at + len(piece)] > 0)
            at += len(piece)
            if len(starts):
                out.append((key, cls, starts.tolist(), ends.tolist()))
        return _batch(_VERDICT, out)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "cls", "again", "piece")), strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # the same row twice in the table
                if rows and size >= REFINED_BYTES and row[0] != rows[-1][0]:
                    yield verdicts(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield verdicts(rows)

    return pieces.select("key", "cls", "again", "piece").repartition("key").sortWithinPartitions("key", "cls").mapInArrow(run, _VERDICT)


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def split_piece(piece: bytes, name: int, lo: int, hi: int, length: int = LENGTH, gram: int = GRAM):
    """(lo, hi, key, first window, bytes) of the parts of a piece whose windows have their anchors lo to hi bytes behind their starts: halves of that range, by anchor and by the bytes all windows of a part share."""
    grams = gram_hashes(np.frombuffer(piece, np.uint8), gram).view(np.int64)
    anchors, begin = np.flatnonzero(grams == name).tolist(), 0
    middle = (lo + hi) // 2
    for p in anchors:
        last = min(p, len(piece) - length)  # windows from begin on whose first anchor is p
        for a, b in ((middle + 1, hi), (lo, middle)):
            i, j = max(begin, p - b), min(last, p - a)
            if i <= j:
                shared = piece[p - a : p - b + length]
                yield a, b, _digest(name.to_bytes(8, "little", signed=True), bytes([a, b]), shared), i, piece[i : j + length]
        begin = p + 1


def _split(parts: DataFrame, length: int) -> DataFrame:
    """Parts (_PART), each in its halves."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, cls, again, piece, name, lo, hi, of_name, of_whole, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                del key, cls
                rows += [(k, _digest(bytes_), again, bytes_, name, a, b, of_name, of_whole, at + i) for a, b, k, i, bytes_ in split_piece(piece, name, lo, hi, length)]
                if len(rows) > 2000:
                    yield _batch(_PART, rows)
                    rows = []
            if rows:
                yield _batch(_PART, rows)

    return parts.select(*(f.split()[0] for f in _PART.split(", "))).mapInArrow(run, _PART)


def _hot_verdicts(pieces: DataFrame, length: int, hot: int) -> DataFrame:
    """The verdicts (name, whole, starts, ends) of pieces of hot names. Each round splits what is hot; at the last one windows of a key are equal, and so one class."""
    whole = [F.col("key").alias("name"), F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"), F.col("key").alias("of_name"), F.col("cls").alias("of_whole"), F.lit(0).alias("at")]
    parts, verdicts = pieces.dropDuplicates(["key", "cls"]).select("key", "cls", "again", "piece", *whole), None
    while True:
        parts = written(_split(parts, length), "parts")
        classes = parts.groupBy("key", "cls").agg(F.min(F.struct("of_name", "of_whole", "at")).alias("r"), F.count(F.lit(1)).alias("k"), F.max("again").alias("again"))
        classes = written(classes.select("key", "cls", "r", ((F.col("k") > 1) | F.col("again")).alias("again")), "part-classes")
        large = classes.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select("key")
        hot_parts = written(parts.join(large, "key", "left_semi").filter("hi > lo"), "hot-parts")
        keys = written(hot_parts.select("key").distinct(), "hot-keys")
        chosen = classes.join(keys, "key", "left_anti").select("key", "cls", "again", "r.of_name", "r.of_whole", "r.at")
        found = _refine(parts.drop("again").join(chosen, ["key", "cls", "of_name", "of_whole", "at"]), length)
        moved = parts.select("key", "cls", "of_name", "of_whole", "at").join(found, ["key", "cls"])
        shifted = lambda c: F.transform(c, lambda x: x + F.col("at")).alias(c)
        own = moved.select(F.col("of_name").alias("name"), F.col("of_whole").alias("whole"), shifted("starts"), shifted("ends"))
        verdicts = own if verdicts is None else verdicts.unionByName(own)
        if hot_parts.isEmpty():
            return verdicts
        parts = hot_parts


def _removed(docs: DataFrame, length: int) -> DataFrame:
    """docs (doc_id, packed data, places) with the repeated windows cut out."""

    def run(batches):
        for batch in batches:
            rows = []
            for data, places in zip(batch.column("packed").to_pylist(), batch.column("places").to_pylist(), strict=True):
                data = zlib.decompress(data)
                gone = np.zeros(len(data) + 1, np.int32)
                for p in places or ():
                    a, b = p["a"], min(p["b"] + length, len(data))
                    if b - a >= length:
                        gone[a] += 1
                        gone[b] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                rows.append((len(data), len(data) - len(kept), len(_runs(gone)[0]), kept))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")} | {c: pa.array(list(x), k) for c, x, k in zip(("n_bytes", "n_removed", "n_spans", "kept"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)}
            )

    return docs.mapInArrow(run, f"{_id(docs)}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of docs (doc_id, text); kept are the bytes that are left."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sound_unions(spark)
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    base = base.withColumn("th", F.xxhash64("data")).withColumn("size", F.length("data"))

    found = written(_scanned(base, length), "stretches")
    often = found.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("twice")).filter("k > 1 or twice").select("name")  # most names have one stretch and go here
    shared = written(often, "names")  # a join with an aggregate of its own rows would meet a hot name in one task
    met = written(found.drop("twice").join(shared, "name", "left_semi"), "met")
    place = F.struct("th", "size", "first")
    classes = met.groupBy("name", "whole").agg(F.min(F.struct("th", "size", "first", "doc_id", "n")).alias("r"), (F.min(place) != F.max(place)).alias("again"))
    counts = classes.groupBy("name").agg((F.count(F.lit(1)) > hot).alias("hot"))
    looked = written(classes.select("name", "whole", "r.*", "again").join(counts, "name"), "classes")

    spans = looked.groupBy(F.col("th").alias("of_th"), F.col("size").alias("of_size"), F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("name", "whole", "first", "n", "again")).alias("spans"))
    texts = _packed(base)
    pieces = _cut(texts.join(spans, (F.col("th") == F.col("of_th")) & (F.col("size") == F.col("of_size")) & F.col("doc_id").eqNullSafe(F.col("of"))), length)
    hot_names = looked.filter("hot").select(F.col("name").alias("key")).distinct()
    named = lambda v: v.select(F.col("key").alias("name"), F.col("cls").alias("whole"), "starts", "ends")
    if hot_names.isEmpty():
        verdicts = named(_refine(pieces, length))
    else:
        pieces, hot_names = written(pieces, "pieces"), written(hot_names, "hot-names")
        verdicts = named(_refine(pieces.join(hot_names, "key", "left_anti"), length)).unionByName(_hot_verdicts(pieces.join(hot_names, "key", "left_semi"), length, hot))
    verdicts = written(verdicts, "verdicts")

    part = met.join(verdicts, ["name", "whole"]).select("th", "size", "first", F.explode(F.arrays_zip("starts", "ends")).alias("v"))
    part = part.select("th", "size", (F.col("first") + F.col("v.starts")).alias("a"), (F.col("first") + F.col("v.ends")).alias("b"))
    copied = base.groupBy("th", "size").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    copied = copied.select("th", "size", F.lit(0).alias("a"), (F.col("size") - length).alias("b")).filter("b >= 0")
    places = part.unionByName(copied).distinct().groupBy("th", "size").agg(F.collect_list(F.struct("a", "b")).alias("places"))
    return _removed(texts.join(places, ["th", "size"], "left").select("doc_id", "packed", "places"), length)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the removal of repeated strings takes and leaves."""
    found = without_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
