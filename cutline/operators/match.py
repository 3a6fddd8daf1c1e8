"""Vocabularies of option names: reading them from help texts, finding unknown names, suggesting the nearest known one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_GAP = r"[ \t\n\r\f]"
#: A name where a word begins; for vpx without the dash that ends its word. One pass over a text finds all of them.
NAME = rf"(?<![^ \t\n\r\f])-(?!-?(?:{_GAP}|\z))[-_0-9A-Za-z]++"
VPX_NAME = rf"(?<![^ \t\n\r\f])-(?!-?(?:{_GAP}|\z))(?:[-_0-9A-Za-z]+(?=-(?:{_GAP}|\z))|[-_0-9A-Za-z]++)"


def option_names(help_text: Column, kind: Column) -> Column:
    """Distinct option names in a help text.

    Words that begin with a dash count, up to their first character that no name has; ``-`` and ``--`` do not, nor a dash before another sign. For x265 ``-x/--long`` names both and
    ``--[no-]x`` names ``--x`` and ``--no-x``; for vpx a dash at the end of a name, left where the text was cut off, is dropped.
    """
    words = F.array_distinct(F.filter(F.split(help_text, f"{_GAP}+"), lambda w: w.startswith("-") & ~w.isin("-", "--")))

    def names(word: Column) -> Column:
        paired = word.rlike("^-./--")
        short = F.when(paired, F.array(F.substring(word, 1, 2))).otherwise(F.array().cast("array<string>"))
        long = F.when(paired, F.substring(word, F.lit(4), F.length(word))).otherwise(word)
        toggle = F.regexp_extract(long, r"^--\[no-\]-?(.*)$", 1)
        head = F.regexp_extract(long, "^[-_0-9A-Za-z]*", 0)
        plain = F.when((head == long) | (F.length(head) > 1), F.array(head)).otherwise(F.array().cast("array<string>"))
        toggled = F.array(F.concat(F.lit("--"), toggle), F.concat(F.lit("--no-"), toggle))
        return F.concat(short, F.when(long.startswith("--[no-]"), toggled).otherwise(plain))

    found = lambda pattern: F.regexp_extract_all(help_text, F.lit(pattern), F.lit(0))
    pairs = F.flatten(F.transform(words, names))
    return F.array_distinct(F.when(kind == "x265", pairs).when(kind == "vpx", found(VPX_NAME)).otherwise(found(NAME)))


def vocabulary(helps: DataFrame, help_text: str = "help", kind: str = "kind") -> DataFrame:
    """(kind, param) of a table of help texts."""
    texts = helps.select(F.col(kind).alias("_kind"), F.col(help_text).alias("_help"))
    names = texts.select("_kind", F.explode(option_names(F.col("_help"), F.col("_kind"))).alias("param"))
    return names.select(F.col("_kind").alias("kind"), "param").distinct()


def unknown(used: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Used names that the vocabulary lacks."""
    return used.join(known.select(*by).distinct(), by, "left_anti")


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of names in rows padded with -1, and their lengths."""
    sizes = np.array([len(n) for n in names], np.int64)
    out = np.full((len(names), max(1, int(sizes.max(initial=0)))), -1, np.int64)
    for row, name in zip(out, names, strict=True):
        row[: len(name)] = [ord(c) for c in name]
    return out, sizes


def jaro_winkler(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Similarity from 0 to 1 of each name of a with the name of b in the same row: Jaro's, raised for a common prefix of up to four letters. A letter of all rows at a time."""
    (x, n), (y, m) = a, b
    rows, width, columns = len(n), x.shape[1], np.arange(y.shape[1])
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    taken = np.zeros((rows, y.shape[1]), bool)
    hit = np.zeros((rows, width), bool)
    for i in range(width):
        fits = (y == x[:, i : i + 1]) & (x[:, i : i + 1] >= 0) & ~taken & (np.abs(columns - i) <= reach[:, None])
        first, any_ = fits.argmax(1), fits.any(1)
        taken[np.flatnonzero(any_), first[any_]] = True
        hit[:, i] = any_
    k = hit.sum(1)
    most = int(k.max(initial=0))
    order = lambda found, codes: np.take_along_axis(codes, np.argsort(~found, axis=1, kind="stable"), 1)[:, :most]
    swaps = ((order(hit, x) != order(taken, y)) & (np.arange(most) < k[:, None])).sum(1) // 2 if most else np.zeros(rows, np.int64)
    safe = np.maximum(k, 1)
    jaro = np.where(k > 0, (k / np.maximum(n, 1) + k / np.maximum(m, 1) + (k - swaps) / safe) / 3, 0.0)
    head = min(4, x.shape[1], y.shape[1])
    prefix = np.cumprod((x[:, :head] == y[:, :head]) & (x[:, :head] >= 0), axis=1).sum(1) if head else np.zeros(rows, np.int64)
    same = np.where((n == m) & (n == 0), 1.0, jaro)
    return np.where(same > 0.7, same + prefix * 0.1 * (1 - same), same)


#: Letters whose frequency sets the order of tokens; numbers of letters that pairs are compared at once.
LETTERS, COMPARED = 256, 1 << 20


def least_shared(n: int, m: int, least: float) -> int:
    """Letters that two names of these lengths must share, repeated ones as often as in both, for a similarity above least.

    Jaro's similarity of k matches is (k/n + k/m + 1) / 3 at most. It is raised above 0.7 only, by four tenths of the rest at most.
    """
    jaro = max(0.7, (least - 0.4) / 0.6) if least >= 0.7 else least
    return max(1, int(np.floor((3 * jaro - 1) / (1 / n + 1 / m) - 1e-9)) + 1)


def shared_candidates(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(_n, _k) of the names of two tables (one column _n, distinct, no nulls) that may be more similar than least: they share enough letters.

    A name's letters, numbered where they repeat, stand in an order with rare ones first. At a pair of lengths that asks for o common ones, two names share one of their first n - o + 1. They are joined on it, once a pair (on
    the first that is common), and held to o common letters in all.
    """
    letters = known.select(F.explode(F.split("_n", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("f")).orderBy(F.desc("f"), "c").limit(LETTERS).collect()
    rank = {r.c: i for i, r in enumerate(letters)}  # letters beyond these are rarer
    lengths = [sorted(r[0] for r in df.select(F.char_length("_n")).distinct().collect() if r[0]) for df in (asked, known)]

    def keyed(others: list[int], first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {"name": [], "n": [], "m": [], "token": [], "head": [], "all": []}
                for name in batch.column("_n").to_pylist():
                    seen: dict[str, int] = {}
                    tokens = []
                    for c in name:
                        seen[c] = seen.get(c, 0) + 1
                        tokens.append((-rank.get(c, LETTERS), -seen[c], c))
                    tokens = [f"{c}{-k}" for _, k, c in sorted(tokens)]
                    for other in others:
                        need = least_shared(len(name), other, least) if name else 1
                        if need > min(len(name), other):
                            continue
                        head = tokens[: len(name) - need + 1]
                        for t in head:
                            n, m = (len(name), other) if first else (other, len(name))
                            for column, value in zip(out.values(), (name, n, m, t, head, tokens), strict=True):
                                column.append(value)
                texts = pa.list_(pa.string())
                yield pa.RecordBatch.from_pydict(
                    {"name": pa.array(out["name"], pa.string()), "n": pa.array(out["n"], pa.int32()), "m": pa.array(out["m"], pa.int32()), "token": pa.array(out["token"], pa.string()), "head": pa.array(out["head"], texts), "all": pa.array(out["all"], texts)}
                )

        return run

    schema = "name string, n int, m int, token string, head array<string>, all array<string>"
    a, k = asked.mapInArrow(keyed(lengths[1], True), schema).alias("a"), known.mapInArrow(keyed(lengths[0], False), schema).alias("k")
    met = a.join(k, ["n", "m", "token"]).filter(F.get(F.array_intersect("a.head", "k.head"), F.lit(0)) == F.col("token"))
    jaro = max(0.7, (least - 0.4) / 0.6) if least >= 0.7 else least
    need = F.floor((3 * jaro - 1) * F.col("n") * F.col("m") / (F.col("n") + F.col("m")) - F.lit(1e-9)) + 1
    return met.filter(F.size(F.array_intersect("a.all", "k.all")) >= need).select(F.col("a.name").alias("_n"), F.col("k.name").alias("_k"))


def suggestions(unknown_names: DataFrame, known: DataFrame, name: str, least: float = 0.75) -> DataFrame:
    """The most similar known name of each unknown one, if its similarity is above least; of equals the first in order. Null names are left out, and an empty one is like an empty one only.

    Only names that share enough letters are compared (``shared_candidates``), vectorised over the pairs of a task.
    """
    distinct = lambda df: df.select(F.col(name).alias("_n")).filter("_n is not null").distinct()
    a, k = distinct(unknown_names), distinct(known)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted(zip(batch.column("_n").to_pylist(), batch.column("_k").to_pylist(), strict=True), key=lambda p: max(map(len, p)))
            at = 0
            while at < len(pairs):  # pairs of like lengths, as rows are padded to the longest
                step = max(1, COMPARED // max(1, max(map(len, pairs[min(len(pairs), at + 512) - 1]))) // 8)
                some = pairs[at : at + min(step, 512)]
                s = jaro_winkler(_codes([p[0] for p in some]), _codes([p[1] for p in some]))
                good = s > least
                chosen = [p for p, g in zip(some, good, strict=True) if g]
                yield pa.RecordBatch.from_pydict({"_n": pa.array([p[0] for p in chosen], pa.string()), "_k": pa.array([p[1] for p in chosen], pa.string()), "_s": pa.array(s[good])})
                at += len(some)

    scored = shared_candidates(a.filter("_n <> ''"), k.filter("_n <> ''"), least).mapInArrow(compare, "_n string, _k string, _s double")
    empty = a.filter("_n = ''").join(k, "_n", "left_semi").select("_n", F.col("_n").alias("_k"), F.lit(1.0).alias("_s"))
    best = scored.unionByName(empty).groupBy("_n").agg(F.min(F.struct((-F.round("_s", 12)).alias("d"), F.col("_k").alias("k"), F.col("_s").alias("s"))).alias("_m"))
    return best.select(F.col("_n").alias(name), F.col("_m.k").alias("suggestion"), F.col("_m.s").alias("similarity"))
