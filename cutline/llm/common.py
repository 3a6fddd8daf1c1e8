"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and word characters as the contracts spell them (Java, RE2 and Python read these alike).
NON_SPACE = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch; a batch of very long documents must still fit a Python worker.
BATCH_ROWS = 256


class NothingToLearn(ValueError):
    """The rows hold nothing that a model can be learned from."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound Arrow batches by rows, so that a worker never holds thousands of long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != rows:
        spark.conf.set(key, str(rows))


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row.

    Inside a higher-order function an inlined expression would be evaluated again for every element;
    a lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder of the context. Where neither is set a folder of our own, in local mode only: a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-cutline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cutline-{tag}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    df.write.option("compression", "zstd").parquet(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def runs(batches, keys: list[str]):
    """Runs of equal keys in batches that are sorted by them: (key, table of the run's rows). A run is held whole."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a].as_py() for c in columns)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def gathered(batches, rows: int, size: int = 1 << 24):
    """Batches put together to about so many rows, or so many bytes where rows are long."""
    held, n, b = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, b = n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, b = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
