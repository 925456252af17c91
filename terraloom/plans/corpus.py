"""Corpus queries: text functions, guards, structure, claims, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import text as tx
from terraloom.operators import corpus
from terraloom.plans.base import query, read

_SQUEEZE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_SQUEEZE}) AS hash, sha256(lower({_SQUEEZE})) AS web_hash, md5(text) AS md5 FROM documents")
def f1_content_hashes(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", tx.content_hash(t).alias("hash"), tx.content_hash(t, lower=True).alias("web_hash"), F.md5("text").alias("md5"))


@query()
def f2_chunk_uuid(spark, sf_dir):
    name = F.concat_ws("|", F.lit("news"), F.col("doc_id"), F.substring(tx.content_hash(F.col("text")), 1, 16))
    return read(spark, sf_dir, "documents").select("doc_id", tx.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", name).alias("chunk_id"))


@query("SELECT p_partkey, substring(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS slug FROM part")
def f8_slug(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '//([^/?]*)', 1)), '^www\.', '') AS host,
regexp_replace(regexp_replace(regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','mc_cid','mc_eid')), '&') AS q FROM u)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM p""")
def f9_normalize_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.normalize_url(F.col("url")).alias("url"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS title FROM part")
def f10_normalize_title(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", tx.normalize_title(F.concat_ws(" / ", "p_name", "p_type")).alias("title"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS full_date, strftime(o_orderdate, '%Y-%m') || '-01' AS month_date, strftime(o_orderdate, '%Y-%m-%d') AS mail_date, NULL::VARCHAR AS garbage FROM orders")
def f11_iso_date(spark, sf_dir):
    day = F.col("o_orderdate")
    mail = F.concat(F.lit("Mon, "), F.date_format(day, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.iso_date(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).alias("full_date"), tx.iso_date(F.date_format(day, "yyyy-MM")).alias("month_date"), tx.iso_date(mail).alias("mail_date"), tx.iso_date(F.lit("not a date")).alias("garbage"))


@query("SELECT vec_id, round(degrees((embedding[1] * 1e7) / 6378137.0), 6) AS lon, round(degrees(atan(sinh((embedding[2] * 1e7) / 6378137.0))), 6) AS lat FROM embeddings")
def f13_mercator(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 1e7
    lon, lat = tx.mercator_to_wgs84(at(0), at(1))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)') AS names_it FROM documents")
def f15_whole_word(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.whole_word(F.col("text"), "the").alias("names_it"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS first, 2024 AS last FROM orders")
def f16_year_range(spark, sf_dir):
    asked = F.concat(F.lit("yields since "), F.year("o_orderdate"), F.lit(" please"))
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.year_range(asked, 2024).alias("r")).select("o_orderkey", "r.first", "r.last")


@query("SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def f19_token_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def f21_json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(r"SELECT doc_id, (len(regexp_extract_all(substring(text, 1, 800), '[\x00-\x08\x0E-\x1F]')) >= 10 OR starts_with(text, '%PDF-')) AS is_binary FROM documents")
def c4_binary_guard(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", corpus.binary_text(F.col("text")).alias("is_binary"))


LEXICON = {"soil": ["the", "that"], "water": ["of", "and"], "market": ["token", "on the"]}


@query(r"""WITH s AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\b(?:the|that)\b')) AS a, len(regexp_extract_all(lower(text), '\b(?:of|and)\b')) AS b, len(regexp_extract_all(lower(text), '\b(?:token|on the)\b')) AS c FROM documents WHERE lang = 'en'),
r AS (SELECT doc_id, unnest([a, b, c]) AS score, unnest(['soil', 'water', 'market']) AS name, unnest([0, 1, 2]) AS i FROM s)
SELECT doc_id, string_agg(name || '=' || score, ',' ORDER BY score DESC, i) AS labels FROM r WHERE score > 0 GROUP BY 1""")
def c8_domain_scores(spark, sf_dir):
    scores = tx.keyword_scores(F.col("text"), LEXICON)
    docs = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", scores.alias("s")).where(F.size("s") > 0)
    return docs.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["name"], x["score"].cast("string"))), ",").alias("labels"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '^references|bibliograph') THEN 'reference' WHEN regexp_matches(lower(text), 'method|erth') THEN 'method' WHEN regexp_matches(lower(text), 'result|tion') THEN 'result' ELSE 'body' END AS role FROM documents""")
def c12_section_role(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.first_of(F.col("text"), [("reference", "^references|bibliograph"), ("method", "method|erth"), ("result", "result|tion")], "body").alias("role"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n|\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents)
SELECT doc_id, unnest(range(len(b)))::INT AS block, unnest(b) AS text FROM p""")
def c13_paragraph_blocks(spark, sf_dir):
    return corpus.paragraphs(read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def c14_chunker(spark, sf_dir):
    return corpus.chunk(read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def c17_claims(spark, sf_dir):
    found = corpus.claims(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in found.items()])


@query()
def d1_greedy_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("body"), F.concat_ws("|", F.substring(tx.normalize_title(F.col("text")), 1, 40), "source").alias("title"))
    return corpus.greedy_dedup(docs, "doc_id", ["title", "body"])


@query("SELECT sha256(array_to_string([substring(trim(regexp_replace(lower(substring(text, 1, 60)), '[^a-z0-9]+', ' ', 'g')), 1, 120), lower(lang), lower(source), 'unknown'], '|')) AS cluster, count(*) AS n FROM documents GROUP BY 1")
def d4_cluster_id(spark, sf_dir):
    cluster = corpus.cluster_id(F.substring("text", 1, 60), F.col("lang"), F.col("source"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "documents").groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS content_hash FROM documents GROUP BY md5(text)")
def d5_exact_dedup(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, sum(length(role) + length(text) + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run FROM conversations),
t AS (SELECT * FROM m WHERE b <= 6), c AS (SELECT conv_id, max(b) AS n FROM t GROUP BY 1),
w AS (SELECT conv_id, n AS k FROM c UNION ALL SELECT w.conv_id, CASE WHEN w.k > 1 THEN greatest(w.k - 2, 0) ELSE 0 END FROM w JOIN t ON t.conv_id = w.conv_id AND t.b = w.k WHERE t.run > 1500)
SELECT t.conv_id, t.turn FROM t JOIN (SELECT conv_id, min(k) AS k FROM w GROUP BY 1) f ON t.conv_id = f.conv_id AND t.b <= f.k""")
def w6_recent_history(spark, sf_dir):
    return corpus.recent_history(read(spark, sf_dir, "conversations"), "conv_id", "turn", 3, 1500).select("conv_id", "turn")
