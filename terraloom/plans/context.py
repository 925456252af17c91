"""Queries of the bounded per-group jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import context, metrics, retrieval
from terraloom.plans.base import query, read


@query()
def f12_truncate_utf8(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", context.truncate_utf8(F.col("text"), 200).alias("head"))


@query()
def w7_memory_compaction(spark, sf_dir):
    return context.remember(read(spark, sf_dir, "conversations"), "conv_id", "turn", 2)


@query()
def x6_character_allocation(spark, sf_dir):
    items = metrics.ranked(read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("structured")), ["conv_id"], [F.col("turn")])
    return context.allocate_characters(items, "conv_id", "rank", "structured", 2000, 900, 300)


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id // 100 AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score FROM q, embeddings d),
m AS (SELECT query_id, doc_id, max(score) AS score FROM s GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM m) WHERE rank <= 5""")
def v2_multi_vector(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    lanes = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("lane"), "embedding")
    found = retrieval.dense_top_k(lanes, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), 10, "lane")
    best = found.groupBy(F.floor(F.col("lane") / 100).alias("query_id"), "doc_id").agg(F.max("score").alias("score"))
    return metrics.ranked(best, ["query_id"], [F.desc("score"), F.col("doc_id")], 5).withColumn("score", F.round("score", 6))


@query("""SELECT source, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Data' ELSE 'Text' END AS label, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END, doc_id)::INT AS position FROM documents""")
def x7_merged_kinds(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id")
    kinds = docs.where("doc_id % 5 = 0").withColumns({"label": F.lit("Data"), "o": F.lit(0)}).unionByName(docs.where("doc_id % 5 <> 0").withColumns({"label": F.lit("Text"), "o": F.lit(1)}))
    return metrics.ranked(kinds, ["source"], [F.col("o"), F.col("doc_id")], name="position").drop("o")


@query("SELECT doc_id, lang IS NULL OR lang = '' OR lang IN ('en', 'fr') AS keep FROM documents")
def v10_usable_unless_conflict(spark, sf_dir):
    lang = F.col("lang")
    return read(spark, sf_dir, "documents").select("doc_id", (lang.isNull() | (lang == "") | lang.isin("en", "fr")).alias("keep"))
