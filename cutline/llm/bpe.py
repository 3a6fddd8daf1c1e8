"""BPE encoding and decoding with a contiguous rank array.

The vocabulary and merges of a public tokenizer file are read on the driver (their path is a parameter; the file must
be readable there) and sent to the tasks once. A text is cut at special tokens, normalised (NFC, lower case), split
into words, and each word is encoded on its own: the part boundaries of the word and the rank of each adjacent pair
stand in two short lists; the smallest rank is searched, its boundary deleted, and the two neighbouring ranks read
again, until no pair has a rank. Words repeat, so each worker keeps a bounded cache of encoded words.

Encoding and decoding are two ``mapInArrow`` passes without a shuffle. Null texts are empty: no ids. Texts of any length are encoded whole; a word of more than
``SHORT`` bytes, whose rank array would be searched quadratically, keeps its ranks in a heap, with the same merges. Repeated rows give repeated results, an empty table an empty one; other columns are kept, those named like outputs replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Words kept by a worker: two generations of this many.
CACHE_WORDS = 50_000
#: Bytes of a word up to which the rank array is searched from end to end.
SHORT = 256
#: Rank of a pair that no merge joins.
NO_RANK = 1 << 60

#: Fixed value: Unicode white space as the tokenizer's expressions read \s.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache
def byte_letters() -> tuple[str, ...]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return tuple(chr(b if b in printable else next(rest)) for b in range(256))


class Vocabulary:
    """Ranks, ids and the splitting rule of a tokenizer file with byte-level letters and a word end."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.tokens: dict[int, str] = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.first = [ids.get(c, -1) for c in letters]
        self.last = [ids.get(c + end, -1) for c in letters]
        #: (left id, right id) -> (rank, id of both)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.cuts = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))).split if self.special else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lookup = np.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], dtype=object)

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.first[b] for b in data]
        parts[-1] = self.last[data[-1]]
        pairs = self.pairs
        none = (NO_RANK, -1)
        if len(parts) > SHORT:
            return self._encode_long(parts)
        ranks = [pairs.get(p, none)[0] for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            parts[at] = pairs[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = pairs.get((parts[at], parts[at + 1]), none)[0]
            if at:
                ranks[at - 1] = pairs.get((parts[at - 1], parts[at]), none)[0]
        return parts

    def _encode_long(self, parts: list[int]) -> list[int]:
        """The same merges for a word of many bytes, where searching the whole array each time would be quadratic."""
        pairs, n = self.pairs, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = pairs[left, right][1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], a, *p))
        return [p for p in parts if p >= 0]

    def _cached(self, word: str) -> bytes:
        known = self.old.get(word)
        if known is None:
            known = np.array(self.encode_word(word), dtype="<i4").tobytes()
        if len(word) <= 64:
            if len(self.new) >= CACHE_WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = known
        return known

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # case is mapped letter by letter: no final sigma
        get, cached = self.new.get, self._cached
        return b"".join([get(w) or cached(w) for w in self.words(text.lower())])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not self.cuts or not any(s in text for s in self.special):
            return self._plain(text)
        out, pieces = [], self.cuts(text)
        marks = regex.findall("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)), text)
        for i, piece in enumerate(pieces):
            out.append(self._plain(piece))
            if i < len(marks):
                out.append(np.array([self.special[marks[i]]], dtype="<i4").tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks, word ends and byte letters as they stand: the file names no decoder."""
        return " ".join(self.lookup[ids].tolist())


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(file: str) -> Vocabulary:
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(file)
    return _loaded[key]


def tokenizer_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _passed(batch: pa.RecordBatch, new: str, drop: str) -> dict[str, pa.Array]:
    return {k: c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k not in (new, drop)}


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", keep_text: bool = False) -> DataFrame:
    """Replace a text column by its token ids (``array<int>``)."""
    spark = df.sparkSession
    file = spark.sparkContext.broadcast(tokenizer_file(path))  # a vocabulary file, of fixed size
    drop = "" if keep_text else text

    def run(batches):
        vocabulary = _vocabulary(file.value)
        for batch in batches:
            packed = [vocabulary.encode(t or "") for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_pydict(_passed(batch, out, drop) | {out: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)})

    common.small_batches(spark)
    fields = [f for f in df.schema if f.name not in (out, drop)]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace a column of token ids by the decoded text."""
    file = df.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches):
        vocabulary = _vocabulary(file.value)
        for batch in batches:
            rows = [np.asarray(x.values, dtype="<i4") if x.is_valid else np.zeros(0, "<i4") for x in batch.column(ids)]
            yield pa.RecordBatch.from_pydict(_passed(batch, out, ids) | {out: pa.array([vocabulary.decode(x) for x in rows], pa.string())})

    fields = [f for f in df.schema if f.name not in (ids, out)]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Encode and decode in one pass, which needs half as many workers: ids, ``n_tokens`` and the digests of ids and decoded text instead of the text."""
    file = df.sparkSession.sparkContext.broadcast(tokenizer_file(path))
    added = T.StructType.fromDDL(f"{out} array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        vocabulary = _vocabulary(file.value)
        for batch in batches:
            packed = [vocabulary.encode(t or "") for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            decoded = [hashlib.sha256(vocabulary.decode(np.frombuffer(p, "<i4")).encode()).hexdigest() for p in packed]
            new = {
                out: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            kept = {k: c for k, c in _passed(batch, out, text).items() if k not in new}
            yield pa.RecordBatch.from_pydict(kept | new)

    common.small_batches(df.sparkSession)
    fields = [f for f in df.schema if f.name != text and f.name not in added.names]
    return df.mapInArrow(run, T.StructType(fields + list(added)))


def word_tokenizer() -> str:
    """Path of the public word-end BPE file that op7 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, word_tokenizer()).drop("ids")
