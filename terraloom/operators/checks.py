"""Data-quality tests, each one row (test, failures)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _result(df: DataFrame, name: str, failures) -> DataFrame:
    return df.agg(failures.cast("long").alias("failures")).select(F.lit(name).alias("test"), "failures")


def failing(df: DataFrame, where: str, name: str) -> DataFrame:
    """Rows that a condition finds."""
    return _result(df, name, F.count_if(F.coalesce(F.expr(where), F.lit(False))))


def not_null(df: DataFrame, columns: Sequence[str], name: str = "not_null") -> DataFrame:
    return failing(df, " OR ".join(f"`{c}` IS NULL" for c in columns), name)


def unique(df: DataFrame, columns: Sequence[str], name: str = "unique") -> DataFrame:
    """Values that occur more than once; a value with a null part is not counted."""
    counts = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
    return _result(counts, name, F.count_if(F.col("n") > 1))


def accepted_values(df: DataFrame, column: str, values: Sequence[object], name: str = "accepted_values") -> DataFrame:
    return _result(df, name, F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(list(values))))


def recency(df: DataFrame, column: str, days: int, now: str, name: str = "recency") -> DataFrame:
    """1 if the newest value is more than `days` days before now, or there is none."""
    fresh = F.max(column) >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    return _result(df, name, F.when(fresh, 0).otherwise(1))


def run(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


#: What the metadata of a chunk must have.
CHUNK_FIELDS = ("document_id", "chunk_index", "total_chunks", "content_hash", "ingest_version", "doc_kind")


def chunk_errors(df: DataFrame, required: Sequence[str] = CHUNK_FIELDS) -> DataFrame:
    """df (id, text, metadata as a map, and _corrupt_record where lines were read) with errors: an array of what is wrong with a row, empty if nothing is."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    found = [F.when(F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.lit(k)), None).otherwise(f"missing metadata.{k}") for k in required]
    found = [F.when(empty("id") | empty("text"), "missing id or text"), *found]
    errors = F.filter(F.array(*found), lambda e: e.isNotNull())
    if "_corrupt_record" in df.columns:
        errors = F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("not JSON"))).otherwise(errors)
    return df.withColumn("errors", errors)


def chunk_report(df: DataFrame, tokens: Column) -> DataFrame:
    """One row over chunk_errors' result: rows, bad rows, the count of each error, and the median, mean and greatest number of tokens of the readable rows."""
    readable = F.when(~F.array_contains("errors", "not JSON"), tokens)
    kinds = df.select(F.explode("errors").alias("e")).groupBy("e").count().agg(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "count")))), F.create_map().cast("map<string,bigint>")).alias("by_error"))
    sums = df.agg(F.count("*").alias("rows"), F.count_if(F.size("errors") > 0).alias("bad_rows"), F.percentile(readable, 0.5).alias("token_p50"), F.avg(readable).alias("token_mean"), F.max(readable).alias("token_max"))
    return sums.crossJoin(F.broadcast(kinds))
