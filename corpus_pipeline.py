"""The corpus pipeline: five stages, each the Parquet output of the one before.

1. quality: documents that the classifier rejects go (labels of the table's folder, none held out).
2. near copies: of each component of documents whose sets of five-word shingles are at least 0.8 alike, the one with the smallest id stays
   (null ids last, then by a hash of the text). Rows with one id or none are documents of their own; those without words all stay.
3. secrets: confirmed findings are replaced in the text; every document stays.
4. mixing: sources are brought to their target weights; a document may be left out or stand twice.
5. tokens: texts are encoded and decoded.

All but the last return the columns of documents. Null texts count as empty and reach the end as such; an empty
table passes through as an empty table.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import bpe, common, jaccard, mixing, quality, secrets

#: Shingle words and likeness from which two documents are near copies.
NEAR_WORDS, NEAR = 5, Fraction(8, 10)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    if docs.isEmpty():
        return docs
    model = quality.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts; ids only say which."""
    return jaccard.one_of_each(docs, NEAR_WORDS, NEAR)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced at their places; n_chars follows."""
    trees = secrets.own_forest(spark)
    clean = docs.withColumn("text", secrets.cleaned(F.col("text"), F.col("source"), trees))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeats as rows of their own."""
    return mixing.repeated(mixing.mix(docs), docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the digests of ids and decoded text."""
    return bpe.round_trip(docs.select("doc_id", "source", "text"), bpe.word_tokenizer(), out="tokens")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing to target weights", mix_sources),
    ("BPE encoding and decoding", to_tokens),
]

#: SQL can't express the classifier, the forest or the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}-{uuid.uuid4().hex[:8]}")
    return docs
