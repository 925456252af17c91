"""Queries of the incremental and streaming jobs, run as batches where a stream and a batch give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.plans.base import query, read
from terraloom.sources import files
from terraloom.streaming import jobs


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 2 DAY")
def r3_future_guard(spark, sf_dir):
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    return jobs.plausible(read(spark, sf_dir, "events"), "ts", now).select("event_id")


@query("""SELECT user_id, time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND - INTERVAL 60 SECOND + k * INTERVAL 10 SECOND AS start, count(*) AS n FROM events, range(6) t(k) GROUP BY ALL""")
def r5_sliding_counts(spark, sf_dir):
    rows = jobs.counts(read(spark, sf_dir, "events"), "ts", ["user_id"], "60 seconds", "10 seconds")
    return rows.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query()
def r5b_rate_limit(spark, sf_dir):
    return jobs.limit_rate(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 6 * 3600.0)


@query("SELECT min(doc_id) AS doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash FROM documents GROUP BY 2")
def r8_ingest_manifest(spark, sf_dir):
    from terraloom.functions import text as tx

    docs = read(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT vec_id, label, substring('[' || array_to_string(list_transform(embedding[1:2], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), ',') || ']', 1, 1000) AS signs FROM embeddings")
def s9_payload(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("signs", F.transform(F.slice("embedding", 1, 2), lambda x: F.when(x > 0, 1).otherwise(0)))
    return files.payload(rows, ["vec_id", "label", "signs", "missing"])
