"""Mixing sources to target weights by systematic sampling.

Each document's expected number of copies is its source's target over its source's size. Within a source the expected
copies are prefix-summed in order of size, one random offset is added, and a copy is emitted for every whole number
that the running sum crosses. As neighbours in the order have like sizes, the words taken come within about one
document of the target.

The prefix sum is done in two levels, so that a source with a third of all rows, or many documents of one size, is not one task's work: documents fall
into buckets (size class, one of ``SALTS`` by a hash of the id), a small table holds how many documents stand before each bucket, and a window numbers
the rows within a bucket. The order is the same at every size of the table. Sources are taken to be few (a row each is sorted in one task).

Null texts have size 0, null sources are a source of their own (last), repeated rows are documents of their own (rows alike in size and id come in the order of a hash of their texts), null ids come first in their
bucket, texts of any length are counted whole, an empty table gives an empty result, a source without words gets nothing. Other columns are kept, those named like outputs replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words to take over words there are; most copies of a document; weights of the sources in order, repeated.
SHARE, CAP, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)
#: Parts of each size class, and so tasks that a class of one source can be spread over.
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.NON_SPACE)), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """Eight classes for each power of two; rises with size."""
    digits = F.length(F.conv(size.cast("string"), 10, 2))
    return (digits * 8 + F.floor(size * 8 / F.pow(F.lit(2.0), digits - 1)) - 8).cast("int")


def _source_columns(source: str) -> list[Column]:
    return [F.col(source).isNull().alias("_none"), F.coalesce(F.col(source), F.lit("")).alias("_source")]


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Words to take of each source: share of the whole by weight, nowhere above cap times the source's size.

    sizes: one row a source with ``source_size`` and ``weight``. What a capped source can't take goes to the others by
    weight until none is above: sources are capped in order of cap over weight for as long as the rest can be filled
    to that level.
    """
    whole, level = Window.partitionBy(), Window.orderBy("_ratio", "_none", "_source")
    sized = (
        sizes.withColumn("_cap", F.col("source_size") * F.lit(cap))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_goal", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("_rest", F.sum("weight").over(whole) - F.sum("weight").over(level))
        .withColumn("_capped", F.sum("_cap").over(level) + F.col("_ratio") * F.col("_rest") <= F.col("_goal"))
    )
    left = F.col("_goal") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(whole)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("weight") * (left / open_weight))
    return sized.withColumn("target", target).select("_none", "_source", "source_size", "target")


def cycled(weights=WEIGHTS):
    """Weights dealt to the sources in code point order, null last, over and over."""

    def deal(sources: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.orderBy("_none", "_source"))  # one row a source
        return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))

    return deal


def mix(docs: DataFrame, weigh=cycled(), share: float = SHARE, cap: float = CAP, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with ``size``, ``source_size``, ``target`` and ``copies``. weigh adds ``weight`` to a table of sources."""
    return mix_sized(docs.withColumn("size", n_words(F.col(text))).withColumn("_tie", F.xxhash64(text)), weigh, share, cap, seed, doc_id, source)


def mix_sized(docs: DataFrame, weigh=cycled(), share: float = SHARE, cap: float = CAP, seed: str = "mix", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The same for documents whose ``size`` is known, and perhaps ``_tie``, which orders rows of one size and id; docs is read three times, twice for its sources and sizes only."""
    base = docs.drop("source_size", "target", "copies").select("*", *_source_columns(source))
    by_source = base.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"))
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % SALTS
    base = base.withColumn("_class", _size_class(F.col("size"))).withColumn("_salt", salt)

    bucket = ["_none", "_source", "_class", "_salt"]
    before = Window.partitionBy("_none", "_source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("_none"), "-").otherwise(F.concat(F.lit("+"), "_source")))), 1, 5), 16, 10).cast("double") / 1048576
    starts = (
        base.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(targets(weigh(by_source), share, cap), ["_none", "_source"])
        .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_offset", offset)
        .drop("_n")
    )
    order = ["size", doc_id, *(["_tie"] if "_tie" in docs.columns else [])]
    numbered = base.withColumn("_row", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)))
    place = F.col("_before") + F.col("_row")
    crossed = F.floor(place * F.col("_rate") + F.col("_offset")) - F.floor((place - 1) * F.col("_rate") + F.col("_offset"))
    return numbered.join(starts, bucket).withColumn("copies", crossed.cast("int")).drop(*bucket, "_row", "_before", "_rate", "_offset", "_tie")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it has copies."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*columns)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mix_sized(common.written(docs, "sizes"))  # words are counted once
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, source IS NULL AS none, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT none, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS goal,
         sum(cap) OVER lv + ratio * (sum(weight) OVER () - sum(weight) OVER lv) <= sum(source_size) OVER () * 1.5::DOUBLE AS capped
  FROM r WINDOW lv AS (ORDER BY ratio, none, src)
), t AS (
  SELECT none, src, source_size,
         CASE WHEN capped THEN cap ELSE weight * ((goal - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / (sum(weight) FILTER (WHERE NOT capped) OVER ())) END AS target,
         ('0x' || substr(md5('mix:' || CASE WHEN none THEN '-' ELSE '+' || src END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM l
), b AS (
  SELECT d.*, length(bin(size)) * 8 + (size * 8) // (1::BIGINT << (length(bin(size)) - 1)) - 8 AS cls,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SALTS} AS salt
  FROM d
), n AS (
  SELECT b.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY b.none, b.src ORDER BY cls, salt, size, doc_id) AS place
  FROM b JOIN t ON b.none = t.none AND b.src = t.src
)
SELECT doc_id, size, source_size, target, (size * (floor(place * rate + u) - floor((place - 1) * rate + u)))::BIGINT AS taken,
       (floor(place * rate + u) - floor((place - 1) * rate + u))::INT AS copies
FROM n
"""
