"""Article and ranking queries: dates, guards, metadata, enrichment, context order."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.functions import text as tx
from terraloom.operators import corpus, metrics, retrieval
from terraloom.plans.base import query, read
from terraloom.plans.retrieval import _ITEMS, _META, _meta


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2024-01-02' WHEN doc_id % 3 = 0 THEN '2023-05-06' END AS published_at, CASE WHEN doc_id % 4 = 0 THEN 'rss' WHEN doc_id % 3 = 0 THEN 'html' ELSE 'missing' END AS source,
CASE WHEN doc_id % 4 = 0 THEN 0.95 WHEN doc_id % 3 = 0 THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence FROM documents""")
def c3_pick_published(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rss = F.when(F.col("doc_id") % 4 == 0, "2024-01-02").when(F.col("doc_id") % 5 == 0, "2999-01-01")
    html = F.when(F.col("doc_id") % 3 == 0, "2023-05-06T10:00:00Z")
    return docs.select("doc_id", corpus.pick_published([("rss", rss, 0.95), ("html", html, 0.85)], "2024-06-01").alias("p")).select("doc_id", "p.*")


@query(r"SELECT page_id, nullif(regexp_extract(html, '<title>([^<]{1,40})', 1), '') AS title, length(html) >= 200 AND NOT contains(lower(html), 'before you continue') AS good FROM pages")
def c5_page_guard(spark, sf_dir):
    title = F.regexp_extract("html", r"<title>([^<]{1,40})", 1)
    return read(spark, sf_dir, "pages").select("page_id", F.when(title != "", title).alias("title"), corpus.good_body(F.col("html"), ["before you continue"], 200).alias("good"))


@query(r"SELECT page_id, len(list_distinct(regexp_extract_all(lower(html), 'https?://([^/\s\"''<>]+)', 1))) <= 2 AS few_hosts FROM pages")
def c6_snippet_hosts(spark, sf_dir):
    hosts = F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit(r"https?://([^/\s\"'<>]+)"), 1))
    return read(spark, sf_dir, "pages").select("page_id", (F.size(hosts) <= 2).alias("few_hosts"))


@query(r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM u)
SELECT host, arg_max(url, (depth, length(url), url)) AS url FROM s WHERE depth >= 1 GROUP BY 1""")
def c7_best_url(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    rows = read(spark, sf_dir, "pages").select("url", F.lower(F.regexp_extract("url", r"//([^/?#]*)", 1)).alias("host"), depth.alias("depth")).where("depth >= 1")
    return rows.groupBy("host").agg(F.max_by("url", F.struct("depth", F.length("url"), "url")).alias("url"))


@query(f"""SELECT doc_id, sha256(doc_id::VARCHAR) AS parent_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY source) AS total_chunks, country AS geo FROM ({_META})""")
def c16_chunk_metadata(spark, sf_dir):
    w = W.partitionBy("source")
    return _meta(spark, sf_dir).select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("parent_id"), (F.row_number().over(w.orderBy("doc_id")) - 1).alias("chunk_index"), F.count("*").over(w).alias("total_chunks"), F.coalesce(F.lit(None).cast("string"), "country").alias("geo"))


@query(f"SELECT doc_id, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 1 WHEN 'src2' THEN 3 ELSE 2 END AS tier, coalesce(year || '-01-01', 'unknown') AS as_of FROM ({_META})")
def c18_provenance_tier(spark, sf_dir):
    tiers = {"src0": 1, "src1": 1, "src2": 3}
    tier = F.lit(2)
    for k, v in tiers.items():
        tier = F.when(F.col("source") == k, v).otherwise(tier)
    return _meta(spark, sf_dir).select("doc_id", tier.alias("tier"), F.coalesce(F.concat(F.col("year").cast("string"), F.lit("-01-01")), F.lit("unknown")).alias("as_of"))


@query(f"SELECT doc_id, '10.1234/' || source || '.' || doc_id AS doi, year FROM ({_META})")
def c20_bibliography(spark, sf_dir):
    cited = F.concat(F.lit("Published "), F.col("year"), F.lit(", https://doi.org/10.1234/"), F.upper("source"), F.lit("."), F.col("doc_id"), F.lit(")."))
    rows = _meta(spark, sf_dir).select("doc_id", cited.alias("head"))
    return rows.select("doc_id", tx.normalize_doi(F.col("head")).alias("doi"), F.regexp_extract("head", r"\b((?:19|20)\d{2})\b", 1).cast("int").alias("year"))


@query("SELECT doc_id, lang AS old_lang, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS new_lang FROM documents WHERE doc_id % 10 = 0 AND lang IS NOT NULL")
def c21_changed_rows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus.changed(docs, docs.withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang"))), "doc_id", "lang").select("doc_id", "old_lang", "new_lang")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing_text, count(*) FILTER (WHERE source IS NULL OR trim(source) = '') AS missing_source FROM documents")
def c22_chunk_validation(spark, sf_dir):
    return metrics.completeness(read(spark, sf_dir, "documents"), ["text", "source"]).select("n", "missing_text", "missing_source")


MARKERS = [("en", ["the", "of", "and", "that"]), ("fr", ["de", "le", "les", "et"]), ("es", ["que", "los", "las", "el"]), ("de", ["der", "die", "und", "ein"])]


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM documents),
m AS (SELECT unnest(['the','of','and','that']) AS word, 'en' AS l UNION ALL SELECT unnest(['de','le','les','et']), 'fr' UNION ALL SELECT unnest(['que','los','las','el']), 'es' UNION ALL SELECT unnest(['der','die','und','ein']), 'de'),
v AS (SELECT doc_id, l, count(*) AS votes FROM w JOIN m USING (word) GROUP BY ALL)
SELECT doc_id, arg_max(l, (votes, l)) AS detected FROM v GROUP BY 1""")
def c23_language_votes(spark, sf_dir):
    markers = spark.createDataFrame([(w, lang) for lang, words in MARKERS for w in words], "word string, l string")
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(retrieval.terms(F.col("text"))).alias("word"))
    votes = words.join(F.broadcast(markers), "word").groupBy("doc_id", "l").agg(F.count("*").alias("votes"))
    return votes.groupBy("doc_id").agg(F.max_by("l", F.struct("votes", "l")).alias("detected"))


@query(r"""WITH k AS (SELECT page_id, coalesce(nullif(CASE WHEN page_id % 7 = 0 THEN 'doi:' || page_id % 3 ELSE '' END, ''), 'url:' || lower(url)) AS key FROM pages) SELECT min(page_id) AS page_id, key FROM k GROUP BY key""")
def d2_context_keys(spark, sf_dir):
    doi = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("doi:"), F.col("page_id") % 3))
    rows = read(spark, sf_dir, "pages").select("page_id", F.coalesce(doi, F.concat(F.lit("url:"), F.lower("url"))).alias("key"))
    return metrics.first_per_key(rows, ["key"], [F.col("page_id")])


@query("SELECT min(event_id) AS event_id, k FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS k FROM events) WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0")
def d3_nullable_key_dedupe(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("user_id")).alias("k"))
    return metrics.first_per_key(rows, ["k"], [F.col("event_id")])


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])that([^\\p{L}\\p{N}]|$)') OR source IN ('src1', 'src2')")
def v8_geo_post_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.where(tx.whole_word(F.col("text"), "that") | tx.list_has(F.lit("src1; SRC2"), F.col("source"))).select("doc_id")


@query("SELECT source, count(*) FILTER (WHERE n_chars > 500) < 3 OR NOT bool_or(lang = 'en') AS fall_back FROM documents GROUP BY 1")
def v11_fallback_trigger(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(((F.count_if(F.col("n_chars") > 500) < 3) | ~F.bool_or(F.col("lang") == "en")).alias("fall_back"))


@query(f"""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE kind WHEN 'structured' THEN 0.3 WHEN 'policy' THEN 0.1 ELSE 0 END DESC, rank)::INT AS position FROM ({_ITEMS})""")
def x3_boost_order(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 11 == 0, "structured").when(F.col("doc_id") % 11 == 1, "policy").otherwise("news")
    items = read(spark, sf_dir, "documents").select("source", "doc_id", retrieval.source_boost(kind, {"structured": 0.3, "policy": 0.1}, F.lit(False)).alias("boost"))
    return metrics.ranked(items, ["source"], [F.desc("boost"), F.col("doc_id")], name="position").drop("boost")


@query(f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN year BETWEEN 2018 AND 2020 THEN 0 ELSE 1 END, doc_id)::INT AS position FROM ({_META})")
def x5_window_first(spark, sf_dir):
    outside = F.when(F.col("year").between(2018, 2020), 0).otherwise(1)
    return metrics.ranked(_meta(spark, sf_dir).select("source", "doc_id", outside.alias("o")), ["source"], [F.col("o"), F.col("doc_id")], name="position").drop("o")


@query(f"SELECT doc_id, '[geo=' || country || '; year=' || year || '; domains=' || source || '] ' || substring(text, 1, 50) AS passage FROM ({_META}) JOIN documents USING (doc_id, source)")
def x8_passage_header(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    head = F.concat(F.lit("[geo="), "country", F.lit("; year="), F.col("year").cast("string"), F.lit("; domains="), "source", F.lit("] "))
    return _meta(spark, sf_dir).join(docs, "doc_id").select("doc_id", F.concat(head, F.substring("text", 1, 50)).alias("passage"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '2024-0' || (1 + page_id % 9) || '-05' WHEN page_id % 3 = 1 THEN '2023-01-02' END AS published FROM pages")
def c2_page_date(spark, sf_dir):
    month = F.concat(F.lit("2024-0"), (1 + F.pmod("page_id", F.lit(9))).cast("string"), F.lit("-05T10:00:00Z"))
    tag = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), month, F.lit('">'))).when(F.col("page_id") % 3 == 1, F.lit("<time datetime='2023-01-02'>x</time>")).otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", tx.page_date(F.concat(tag, "html")).alias("published"))


@query("""WITH l AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
s AS (SELECT label, vec_id, round(list_cosine_similarity(e, b), 6) AS similarity FROM l), c AS (SELECT *, quantile_cont(similarity, 0.95) OVER (PARTITION BY label) AS cutoff FROM s)
SELECT label, vec_id, similarity, sum(CASE WHEN similarity <= cutoff THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS "group" FROM c""")
def c15_semantic_breaks(spark, sf_dir):
    return corpus.semantic_breaks(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query(f"SELECT doc_id, source || ' (' || year || '). Report ' || doc_id || '. https://doi.org/10.1/' || doc_id AS line FROM ({_META})")
def f22_citation(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    return _meta(spark, sf_dir).select("doc_id", tx.citation(F.col("source"), F.col("year"), F.concat(F.lit("Report "), doc), F.lit(" "), F.concat(F.lit("10.1/"), doc)).alias("line"))


@query("""WITH r(intent, corpus, boost, skip) AS (VALUES ('en', 'news', 0.1, false), ('en', 'policy', 0.2, false), ('fr', 'news', 0.3, true), ('de', 'research', 0.0, false)),
k AS (SELECT doc_id, corpus, boost::DOUBLE AS boost FROM documents JOIN r ON lang = intent WHERE NOT skip)
SELECT * FROM k UNION ALL SELECT doc_id, 'all', 0.0::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def v9_corpus_routing(spark, sf_dir):
    rules = spark.createDataFrame([("en", "news", 0.1, False), ("en", "policy", 0.2, False), ("fr", "news", 0.3, True), ("de", "research", 0.0, False)], "intent string, corpus string, boost double, skip boolean")
    return retrieval.route_corpora(read(spark, sf_dir, "documents"), "doc_id", "lang", F.broadcast(rules), "all")


@query(r"""WITH c AS (SELECT doc_id, unnest(['that', 'the', 'and', 'ing', 'of']) AS name, unnest(range(5)) AS i, unnest([len(regexp_extract_all(lower(text), '\bthat\b')), len(regexp_extract_all(lower(text), '\bthe\b')), len(regexp_extract_all(lower(text), '\band\b')),
len(regexp_extract_all(lower(text), '\bing\b')), len(regexp_extract_all(lower(text), '\bof\b'))]) AS n FROM documents WHERE lang = 'en'),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS found FROM c WHERE n > 0)
SELECT doc_id, coalesce((SELECT string_agg(name, ',' ORDER BY n DESC, i) FROM k WHERE k.doc_id = d.doc_id AND (found <= 3 OR n >= 2)), '') AS places FROM documents d WHERE lang = 'en'""")
def c10_place_mentions(spark, sf_dir):
    found = corpus.places(F.col("text"), ["of", "the", "and", "ing", "that"])
    return read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.array_join(found, ",").alias("places"))


@query(r"""SELECT page_id, regexp_matches(regexp_extract(html, '<title>([^<]*)', 1), '(?i)(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)') AS in_title FROM pages""")
def v12_title_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.whole_word(F.regexp_extract("html", r"<title>([^<]*)", 1), "the").alias("in_title"))


@query(f"SELECT doc_id, (CASE source WHEN 'src1' THEN 0.3 WHEN 'src2' THEN 0.1 ELSE 0.0 END + CASE WHEN year = 2019 THEN 0.05 ELSE 0.0 END)::DOUBLE AS boost FROM ({_META})")
def x2_source_boost(spark, sf_dir):
    boost = retrieval.source_boost(F.col("source"), {"src1": 0.3, "src2": 0.1}, F.col("year") == 2019)
    return _meta(spark, sf_dir).select("doc_id", boost.alias("boost"))
