"""Shared helpers of the training-data operators: tables, lineage cuts and Arrow text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what separates words, in Java and Python regex syntax.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a new temporary one on a local master; a cluster's tasks share none, so there it is an error."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current.isEmpty():
        if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="terraloom-checkpoint-"))
        current = jsc.getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Replace the lineage of a small intermediate by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str, codec: str = "zstd", folder: str | None = None) -> DataFrame:
    """Write a larger intermediate to the shared folder as Parquet and read it back, columns prunable."""
    path = f"{folder or shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A folder in the shared one for the intermediates of one job; close() deletes it, once nothing is to be computed from them. What a lazy result still reads has another name."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, name, folder=self.folder)

    def close(self) -> None:
        remove(self.spark, self.folder)


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only if a count shows at most max_rows narrow rows; otherwise leave the join to Catalyst."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bounded_sample(df: DataFrame, order: F.Column, most: int) -> DataFrame:
    """At most `most` rows of df, of the least hashes `order` (a long). Rows beyond a cutoff set from the count go before the sort, so all tasks
    together send about `most` rows, not each of them. df is read twice: stage or checkpoint it before."""
    n = df.count()
    wanted = most + 6 * most**0.5 + 10
    cutoff = (1 << 63) - 1 if n <= wanted else int(-(1 << 63) + (1 << 64) * (wanted / n))
    return df.where(order <= cutoff).orderBy(order).limit(most)


def word_count(text) -> F.Column:
    """Words of a text column as a long; null and wordless texts give 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(col) + 1, col.offset * kind().itemsize).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, one row at least, so that temporaries stay bounded."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `most` bytes of a string or binary column, so that Python objects made of them stay bounded; one row is the largest unit."""
    for batch in batches:
        for i, j in pieces(utf8(batch.column(column))[1], most):
            yield batch.slice(i, j - i)
