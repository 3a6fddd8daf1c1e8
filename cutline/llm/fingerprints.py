"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits, in SQL functions only.

A text's words (runs of non-space, lower-cased) form shingles of ``SHINGLE`` words; a shorter text is one shingle. Each
shingle is hashed once. The hash's top bits name one of ``BINS`` bins, and each bin keeps its smallest hash. An
empty bin takes over the value of a filled bin: the first filled one among ``PROBES`` bins drawn by a hash of (bin,
attempt), else the filled one whose hash with the bin is smallest. Either way the choice depends on the bins alone,
so two documents whose bins are filled alike borrow alike. Of every bin the ``BITS`` low-order bits are stored, two hexadecimal
digits a bin; a borrowed value is hashed with the borrowing bin first, so that two different values never agree everywhere they are lent. Two fingerprints agree by chance in
one of ``2**BITS`` bins, which the likeness corrects for.

All work on a text stands in one expression: sort the hashes, keep the first of each bin. There is no explode and
no shuffle. Texts of any length are read whole, in the memory of their row. Null and empty texts have the empty fingerprint, which is like another empty one (1) and unlike all
others (0). Equal texts, and so repeated rows, have equal fingerprints; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import let

SHINGLE, BINS, BITS, PROBES = 5, 256, 8, 8
#: Documents in one window partition when each is paired with the next; buckets up to which their heads are broadcast; quantiles of the keys that buckets lie between.
BUCKET_ROWS, BROADCAST_HEADS, QUANTILES = 2048, 100_000, 256


def words(text: Column) -> Column:
    """Runs of non-space; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash of every run of size words; of the whole where there are fewer."""

    def of(hashes: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(size))))
        return F.when(F.size(hashes) >= size, each).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def bin_minima(hashes: Column, bins: int = BINS) -> Column:
    """The smallest hash of each filled bin, in the order of bins. The bin is the hash's top bits."""
    shift = 64 - (bins.bit_length() - 1)

    def firsts(ordered: Column) -> Column:
        # a signed sort keeps hashes with the same top bits together
        return F.filter(ordered, lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(ordered, i - 1), shift)))

    return let(F.sort_array(hashes), firsts)


def _bin(h: Column, bins: int) -> Column:
    return (F.shiftright(h, 64 - (bins.bit_length() - 1)) + bins // 2).cast("int")


def densified(minima: Column, bins: int = BINS, bits: int = BITS, probes: int = PROBES) -> Column:
    """The low-order bits of every bin, empty bins filled from others; no bins for no shingles."""
    low = F.lit((1 << bits) - 1)
    none = F.lit(None).cast("long")

    def fill(m: Column) -> Column:
        filled = F.transform(m, lambda h: F.struct(_bin(h, bins).alias("bin"), h.alias("h")))

        def spread(f: Column) -> Column:
            """The hash of every bin, null for an empty one: gaps between filled bins are filled up with nulls."""
            gap = lambda b, p: b["bin"] - F.coalesce(F.get(f, p - 1)["bin"], F.lit(-1)) - 1
            pieces = F.flatten(F.transform(f, lambda b, p: F.concat(F.array_repeat(none, gap(b, p)), F.array(b["h"]))))
            return F.concat(pieces, F.array_repeat(none, bins - 1 - F.element_at(f, -1)["bin"]))

        def borrow(f: Column, at: Column) -> Column:
            def lend(i: Column) -> Column:
                tried = (F.get(at, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(bins)).cast("int")) for t in range(1, probes + 1))
                nearest = F.array_min(F.transform(f, lambda b: F.struct(F.xxhash64(i, b["bin"] + bins).alias("k"), b["h"].alias("h"))))["h"]
                return F.xxhash64(F.coalesce(*tried, nearest), i)

            return F.transform(at, lambda h, i: F.coalesce(h, lend(i)).bitwiseAND(low).cast("int"))

        return let(filled, lambda f: let(spread(f), lambda at: borrow(f, at)))

    return let(minima, lambda m: F.when(F.size(m) > 0, fill(m)).otherwise(F.array().cast("array<int>")))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint as hexadecimal text."""
    digits = BITS // 4
    packed = F.array_join(F.transform(densified(bin_minima(shingle_hashes(text))), lambda c: F.substring(F.hex(c + (1 << BITS)), 2, digits)), "")
    return F.lower(packed)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard likeness of two fingerprints: agreeing bins, corrected for agreement by chance."""
    digits, chance = bits // 4, 2.0**-bits

    def compare(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substring(x, i * digits + 1, digits) == F.substring(y, i * digits + 1, digits)))
        estimate = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))
        return F.when((F.length(x) == 0) | (F.length(y) == 0), (F.length(x) == F.length(y)).cast("double")).otherwise(estimate)

    return let(F.struct(F.encode(a, "US-ASCII").alias("x"), F.encode(b, "US-ASCII").alias("y")), compare)


def _buckets(df: DataFrame, key: str) -> tuple[Column, int]:
    """A bucket of each key, in the order of keys, null ones first, and the number of rows: between QUANTILES quantiles of all keys equal widths, so that about BUCKET_ROWS rows fall into each wherever keys lie."""
    k = F.col(key).cast("long")
    cuts, low, n = df.agg(F.approx_percentile(k, [i / QUANTILES for i in range(1, QUANTILES)], 20 * QUANTILES), F.min(k), F.count(F.lit(1))).first()
    edges = sorted({low, *(cuts or ())} - {None})
    inner = max(1, n // (QUANTILES * BUCKET_ROWS))  # buckets between two quantiles
    widths = [max(1.0, (b - a) / inner) for a, b in zip(edges, [*edges[1:], edges[-1] + 1], strict=True)] if edges else []

    def place(q: Column) -> Column:
        start, width = F.element_at(F.array(*map(F.lit, edges)), q), F.element_at(F.array(*map(F.lit, widths)), q)
        return q.cast("long") * (1 << 40) + F.floor((k.cast("double") - start) / width)

    if not edges:
        return F.lit(0).cast("long"), n
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= k))
    return F.when(k.isNull(), 0).otherwise(let(at, place)).cast("long"), n


def with_next(df: DataFrame, carried: list[str], key: str = "doc_id", tie: str = "text") -> DataFrame:
    """df with ``next_<column>`` of the row that follows in the order of key, and of tie where keys are equal (after the last: the first). Null keys come first.

    Rows fall into buckets of neighbouring keys; the first row of a bucket is also dealt to the bucket before it. So each row is shuffled about once, and a task sorts
    one bucket at a time; rows of one key stand in one bucket.
    """
    bucket, n = _buckets(df, key)
    if not n:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    part = F.shiftright("_bucket", 40)
    heads = df.groupBy(bucket.alias("_bucket")).agg(F.min(F.col(key).cast("long")).alias("_head"))
    lasts = heads.groupBy(part.alias("_part")).agg(F.max("_bucket").alias("_last"))  # a row a quantile
    around = Window.orderBy("_part")
    lasts = lasts.select("_part", F.coalesce(F.lag("_last").over(around), F.max("_last").over(Window.partitionBy())).alias("_far"))
    near = F.lag("_bucket").over(Window.partitionBy("_part").orderBy("_bucket"))
    heads = heads.withColumn("_part", part).withColumn("_near", near).join(F.broadcast(lasts), "_part").select(F.coalesce("_near", "_far").alias("_before"), F.col("_bucket").alias("_own"), "_head")
    if n // BUCKET_ROWS <= BROADCAST_HEADS:
        heads = F.broadcast(heads)
    keyed = df.withColumn("_bucket", bucket)
    dealt = keyed.join(heads, (keyed["_bucket"] == heads["_own"]) & F.col(key).cast("long").eqNullSafe(heads["_head"]), "left").drop("_head", "_own")
    places = F.filter(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(True).alias("own")), F.struct(F.col("_before").alias("b"), F.lit(False).alias("own"))), lambda p: p["b"].isNotNull())
    dealt = dealt.withColumn("_place", F.explode(places))
    # a foreign row follows all rows of the bucket, also where the last bucket is followed by the first
    order = Window.partitionBy("_place.b").orderBy(F.desc("_place.own"), F.asc_nulls_first(key), tie)
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried)).filter("_place.own").drop("_place", "_bucket", "_before")


def edited(text: Column, following: Column) -> Column:
    """text, its last floor(n / 2) code points replaced by as many of the first of following, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they and the next document's are."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    changed = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"), "fingerprint", "next_fingerprint")
    both = changed.select("*", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
