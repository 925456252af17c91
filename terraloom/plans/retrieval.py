"""Retrieval queries. A stated query set meets all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import metrics, retrieval
from terraloom.plans.base import query, read


def _dense(spark, sf_dir, k=10):
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_top_k(asked, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), k)


_DENSE = """SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)"""


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({_DENSE}) WHERE rank <= 10")
def v1_dense_top_k(spark, sf_dir):
    return _dense(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(r"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))) AS term FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
r AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM r) WHERE rank <= 10""")
def v3_bm25(spark, sf_dir):
    bench, docs = read(spark, sf_dir, "benchmark", "documents")
    return retrieval.bm25(bench.withColumnRenamed("item_id", "query_id"), docs, 10)


@query(f"""WITH a AS (SELECT query_id, doc_id, rank FROM ({_DENSE}) WHERE rank <= 20),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC)::INT AS rank FROM a),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 10""")
def v4_rank_fusion(spark, sf_dir):
    dense = _dense(spark, sf_dir, 20)
    other = metrics.ranked(dense.select("query_id", "doc_id"), ["query_id"], [F.desc("doc_id")])
    return retrieval.fuse([dense, other], 10)


_META = "SELECT doc_id, 'NATION_' || (doc_id % 25) AS country, (2015 + doc_id % 10)::INT AS year, source FROM documents"


def _meta(spark, sf_dir):
    country = F.concat(F.lit("NATION_"), F.pmod("doc_id", F.lit(25)).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", country.alias("country"), (2015 + F.pmod("doc_id", F.lit(10))).cast("int").alias("year"), "source")


@query(f"SELECT doc_id FROM ({_META}) WHERE country IN ('NATION_3', 'NATION_7') AND year BETWEEN 2018 AND 2022 AND source <> 'src3'")
def v5_metadata_filter(spark, sf_dir):
    return _meta(spark, sf_dir).where(F.col("country").isin("NATION_3", "NATION_7") & F.col("year").between(2018, 2022) & (F.col("source") != "src3")).select("doc_id")


@query(f"""SELECT doc_id, greatest(-0.5, least(0.5, CASE WHEN country = 'NATION_3' THEN 0.25 WHEN source = 'src3' THEN 0.1 ELSE -0.5 END + CASE WHEN year BETWEEN 2018 AND 2020 THEN 0.15 ELSE -0.15 END + CASE WHEN source = 'src1' THEN 0.1 ELSE 0 END))::DOUBLE AS score FROM ({_META})""")
def v6_soft_score(spark, sf_dir):
    score = retrieval.soft_score(F.col("country"), F.col("source") == "src3", F.lit("NATION_3"), F.col("year"), F.lit(2018), F.lit(2020), F.col("source") == "src1")
    return _meta(spark, sf_dir).select("doc_id", score.alias("score"))


@query(f"""WITH c AS (SELECT source, doc_id, country IN ('NATION_3', 'NATION_8') AS g, year = 2019 AS t, year BETWEEN 2018 AND 2020 AS n FROM ({_META})),
l AS (SELECT source, CASE WHEN bool_or(g AND t) THEN 0 WHEN bool_or(g AND n) THEN 1 WHEN bool_or(g) THEN 2 WHEN bool_or(t) THEN 3 ELSE 4 END AS level FROM c GROUP BY 1)
SELECT source, doc_id, (['full', 'time_near', 'no_time', 'no_geo', 'none'])[level + 1] AS "constraint" FROM c JOIN l USING (source)
WHERE CASE level WHEN 0 THEN g AND t WHEN 1 THEN g AND n WHEN 2 THEN g WHEN 3 THEN t ELSE true END""")
def v7_relaxation_cascade(spark, sf_dir):
    rows = _meta(spark, sf_dir)
    geo, time, near = F.col("country").isin("NATION_3", "NATION_8"), F.col("year") == 2019, F.col("year").between(2018, 2020)
    return retrieval.cascade(rows, "source", geo, time, near).select("source", "doc_id", "constraint")


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, (len(list_intersect(a.w, b.w)) >= 2 OR 10 * len(list_intersect(a.w, b.w)) >= 3 * len(a.w)) AS relevant FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def v13_memory_relevance(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(retrieval.terms(F.col("text"))).alias("w"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v"))
    shared = F.size(F.array_intersect("w", "v"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", ((shared >= 2) | (10 * shared >= 3 * F.size("w"))).alias("relevant"))


@query(f"""WITH c AS (SELECT query_id, doc_id, score, doc_id % 3 AS m FROM ({_DENSE}) WHERE rank <= 10),
n AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM c),
f AS (SELECT query_id, doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END + CASE m WHEN 0 THEN 0.2 WHEN 1 THEN 0.1 ELSE 0 END + 0.05, 6) AS final FROM n)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, doc_id)::INT AS rank FROM f""")
def x1_normalised_rerank(spark, sf_dir):
    kind = F.concat(F.lit("k"), F.pmod("doc_id", F.lit(3)).cast("string"))
    boost = retrieval.source_boost(kind, {"k0": 0.2, "k1": 0.1}, F.lit(True))
    return retrieval.normalised_rerank(_dense(spark, sf_dir).drop("rank"), "query_id", "score", boost).select("query_id", "doc_id", "final", "rank")


_KINDS = ["news", "policy", "report", "paper"]
_ITEMS = "SELECT source, doc_id, CASE doc_id % 11 WHEN 0 THEN 'structured' WHEN 1 THEN 'policy' WHEN 2 THEN 'report' WHEN 3 THEN 'paper' ELSE 'news' END AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank FROM documents"


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY rank) AS n, list_position(['news', 'policy', 'report', 'paper'], kind) AS o FROM ({_ITEMS})),
p AS (SELECT *, CASE WHEN kind = 'structured' AND n <= 4 THEN 0 WHEN o > 0 AND n <= 2 THEN 1 ELSE 2 END AS a FROM i),
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY a, CASE WHEN a = 2 THEN rank ELSE n END, CASE WHEN a = 1 THEN o ELSE 0 END)::INT AS position FROM p)
SELECT * FROM r WHERE position <= 14""")
def x4_diversity_packing(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 11 == 0, "structured").when(F.col("doc_id") % 11 == 1, "policy").when(F.col("doc_id") % 11 == 2, "report").when(F.col("doc_id") % 11 == 3, "paper").otherwise("news")
    items = metrics.ranked(read(spark, sf_dir, "documents").select("source", "doc_id", kind.alias("kind")), ["source"], [F.col("doc_id")])
    return retrieval.diversity_pack(items, "source", "kind", "rank", _KINDS).select("source", "doc_id", "position")


@query(f"""WITH r AS (SELECT d.query_id, d.rank, a.label = b.label AS hit FROM ({_DENSE}) d JOIN embeddings a ON a.vec_id = d.query_id JOIN embeddings b ON b.vec_id = d.doc_id WHERE d.rank <= 11 AND d.query_id <> d.doc_id),
p AS (SELECT query_id, max(CASE WHEN hit AND rank <= 5 THEN 1 ELSE 0 END) AS found, min(CASE WHEN hit THEN rank END) AS first FROM r GROUP BY 1)
SELECT count(*) AS queries, round(avg(found), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM p""")
def q8_retrieval_metrics(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    a, b = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("x")), vectors.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("y"))
    rows = _dense(spark, sf_dir, 11).where("query_id <> doc_id").join(a, "query_id").join(b, "doc_id").withColumn("hit", F.col("x") == F.col("y"))
    return retrieval.evaluate(rows, "query_id", "hit", 5)
