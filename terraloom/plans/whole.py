"""Queries over whole tables and texts, beside earlier ones that read a part of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import text as tx
from terraloom.operators import checks, corpus, joins, meaning, retrieval
from terraloom.plans.base import query, read
from terraloom.plans.corpus import LEXICON

_TITLE = r"nullif(trim(regexp_replace(regexp_extract(html, '(?i)<title\b[^>]*>([^<]*)<', 1), '\s+', ' ', 'g')), '')"
_BODY = r"trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT page_id, url, coalesce({_TITLE}, '') AS title, {_BODY} AS body, trim(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)<', 1), '\s+', ' ', 'g')) AS item FROM pages),
n AS (SELECT *, lower(title) AS t, lower(body) AS b FROM p)
SELECT page_id, CASE WHEN item <> '' AND (lower(title) IN ({', '.join(f"'{t}'" for t in meaning.BAD_TITLES)}) OR length(title) < 12 OR contains(lower(title), 'error 400') OR contains(lower(title), 'bad request')) THEN item ELSE title END AS title,
  CASE WHEN b = '' THEN true WHEN t = '' THEN length(b) < 120 ELSE (contains(b, t) AND length(b) <= length(t) + 40) OR (contains(t, b) AND length(t) <= length(b) + 40) END AS headline_only,
  length(body) >= 200 AND NOT contains(b, 'before you continue') AS good FROM n""")
def c5_page_rules(spark, sf_dir):
    """The title ladder over page title and first heading, whether the body is but a headline, and the guard, over whole pages."""
    squeezed = lambda c: tx.squeeze(F.regexp_replace(c, "(?s)<[^>]*>", " "))
    pages = read(spark, sf_dir, "pages").select("page_id", F.coalesce(tx.squeeze(F.regexp_extract("html", r"(?i)<title\b[^>]*>([^<]*)<", 1)), F.lit("")).alias("title"), squeezed(F.col("html")).alias("body"), tx.squeeze(F.regexp_extract("html", "<h1[^>]*>([^<]*)<", 1)).alias("item"))
    return pages.select("page_id", meaning.title_ladder(F.col("title"), F.col("item")).alias("title"), meaning.headline_only(F.col("title"), F.col("body")).alias("headline_only"), corpus.good_body(F.col("body"), ["before you continue"], 200).alias("good"))


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(url, '//[^/]*/([a-z]{{2}})/', 1) AS country, coalesce({_TITLE}, '') AS title, trim(html) AS b, lower(trim(html)) AS low FROM pages),
h AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(low, 'https?://([^/\s?#]+)', 1), lambda x: regexp_replace(string_split(x, '@')[-1], '^[w.]+', '')), lambda x: x <> '')) AS hosts,
  list_filter(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z''-]+'), lambda w: lower(w)), lambda w: length(w) >= 4 AND NOT list_contains({meaning.EMPTY_WORDS}, w))[1:8] AS w FROM p)
SELECT page_id, CASE WHEN b = '' THEN 'empty' WHEN len(hosts) > 2 THEN 'hosts' WHEN length(country) >= 3 AND contains(low, country) THEN NULL WHEN len(w) = 0 THEN 'no title' WHEN len(list_filter(w, lambda x: contains(low, x))) >= least(len(w), 2) THEN NULL ELSE 'subject' END AS reason FROM h""")
def c6_off_topic(spark, sf_dir):
    """Whole pages as search results: hosts, country and title words."""
    pages = read(spark, sf_dir, "pages")
    title = F.coalesce(tx.squeeze(F.regexp_extract("html", r"(?i)<title\b[^>]*>([^<]*)<", 1)), F.lit(""))
    return pages.select("page_id", meaning.off_topic(F.col("html"), F.regexp_extract("url", "//[^/]*/([a-z]{2})/", 1), title).alias("reason"))


@query(rf"""WITH p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS s FROM pages
  UNION ALL SELECT -1 - page_id, regexp_extract(url, '^[a-z]+://[^/]*/?[^/]*', 0), list_filter(string_split(regexp_extract(regexp_extract(url, '^[a-z]+://[^/]*/?[^/]*', 0), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') FROM pages)
SELECT page_id, url, len(s) = 0 OR (len(s) = 1 AND list_contains({meaning.HUBS}, lower(s[1]))) AS hub FROM p""")
def c7_hub_urls(spark, sf_dir):
    """Which URLs, and which of their first path segments, are roots or section pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    tops = pages.select((-1 - F.col("page_id")).alias("page_id"), F.regexp_extract("url", "^[a-z]+://[^/]*/?[^/]*", 0).alias("url"))
    return pages.unionByName(tops).select("page_id", "url", meaning.hub_url(F.col("url")).alias("hub"))


@query(r"""WITH s AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\b(?:the|that)\b')) AS a, len(regexp_extract_all(lower(text), '\b(?:of|and)\b')) AS b, len(regexp_extract_all(lower(text), '\b(?:token|on the)\b')) AS c FROM documents),
r AS (SELECT doc_id, unnest([a, b, c]) AS score, unnest(['soil', 'water', 'market']) AS name, unnest([0, 1, 2]) AS i FROM s)
SELECT doc_id, string_agg(name || '=' || score, ',' ORDER BY score DESC, i) AS labels FROM r WHERE score > 0 GROUP BY 1""")
def c8_all_languages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", tx.keyword_scores(F.col("text"), LEXICON).alias("s")).where(F.size("s") > 0)
    return docs.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["name"], x["score"].cast("string"))), ",").alias("labels"))


@query("SELECT doc_id, '[geo=' || n_name || '; domains=' || source || '; lang=' || lang || '] ' || text AS passage FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 25")
def x8_whole_passages(spark, sf_dir):
    docs, nations = read(spark, sf_dir, "documents", "nation")
    head = F.concat(F.lit("[geo="), "n_name", F.lit("; domains="), "source", F.lit("; lang="), "lang", F.lit("] "))
    return docs.join(F.broadcast(nations), F.col("doc_id") % 25 == F.col("n_nationkey"), "left").select("doc_id", F.concat(head, "text").alias("passage"))


@query(rf"""WITH p AS (SELECT page_id, {_TITLE} AS title, regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\.', '') AS host, lang FROM (SELECT *, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages))
SELECT sha256(substring(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')), 1, 120) || '|' || lang || '|' || host || '|unknown') AS cluster, min(page_id) AS first_page, count(*) AS n FROM p GROUP BY 1""")
def d4_page_clusters(spark, sf_dir):
    """Clusters by whole page titles, languages and hosts."""
    pages = read(spark, sf_dir, "pages")
    title = F.coalesce(tx.squeeze(F.regexp_extract("html", r"(?i)<title\b[^>]*>([^<]*)<", 1)), F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "//([^/?#]*)", 1)), r"^www\.", "")
    cluster = corpus.cluster_id(title, F.regexp_extract("html", '<html lang="([a-z]+)"', 1), host, F.lit(None).cast("string"))
    return pages.groupBy(cluster.alias("cluster")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query(r"""WITH k AS (SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\p{L}\p{N}]+'), lambda w: w <> ''))) AS w FROM part),
c AS (SELECT w, min(p_partkey) AS class_id, count(*) AS n FROM k GROUP BY w),
l AS (SELECT a.w, sum(b.n) AS links FROM c a, c b WHERE 100 * len(list_intersect(a.w, b.w)) >= 60 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) GROUP BY a.w)
SELECT p_partkey, class_id, (links - 1)::BIGINT AS n_links FROM k JOIN c USING (w) JOIN l USING (w)""")
def j11_title_classes(spark, sf_dir):
    """All part titles: the class of equal token sets and the number of parts with a similar title. Classes meet, copies don't."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return joins.title_classes(parts, "p_partkey", "title", 60)


_FOLD = "translate({}, 'áàâäãåéèêëíìîïóòôöõúùûüçñý', 'aaaaaaeeeeiiiiooooouuuucny')"


@query(rf"""WITH w AS (SELECT doc_id, lang AS own, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents),
c AS (SELECT own AS lang, word, count(*) AS n FROM w WHERE own IS NOT NULL GROUP BY ALL), t AS (SELECT word, sum(n) AS total FROM c GROUP BY word),
m AS (SELECT c.word, c.lang FROM c JOIN t USING (word) WHERE c.n >= 0.9 * t.total QUALIFY row_number() OVER (PARTITION BY c.lang ORDER BY c.n DESC, c.word) <= 40),
v AS (SELECT doc_id, coalesce(a.lang, b.lang) AS lang, count(*) AS v FROM w LEFT JOIN m a ON a.word = w.word LEFT JOIN m b ON b.word = {_FOLD.format('w.word')} WHERE coalesce(a.lang, b.lang) IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, coalesce(sum(v) FILTER (lang = 'en'), 0) AS own, coalesce(sum(v) FILTER (lang <> 'en'), 0) AS others, max({{'v': v, 'lang': lang}}) FILTER (lang <> 'en') AS top FROM v GROUP BY doc_id),
d AS (SELECT doc_id, trim(coalesce(text, '')) AS x, len(regexp_extract_all(text, '\p{{L}}')) AS l, len(regexp_extract_all(text, '\p{{L}}')) - len(regexp_extract_all(text, '[A-Za-z]')) AS a FROM documents)
SELECT doc_id, CASE WHEN x = '' OR (top IS NULL AND coalesce(others, 0) < 2 AND coalesce(a, 0) / greatest(coalesce(l, 0), 1) < 0.08) THEN 'en' WHEN own >= 2 AND others >= 1 THEN 'mixed' WHEN top IS NOT NULL THEN top.lang WHEN own > 0 THEN 'en' ELSE 'unknown' END AS detected FROM d LEFT JOIN s USING (doc_id)""")
def c23_learned_markers(spark, sf_dir):
    """The language of every text by markers learned from the labelled texts of all languages."""
    docs = read(spark, sf_dir, "documents")
    return meaning.detect_language(docs, "doc_id", "text", meaning.language_markers(docs, "lang", "text")).select("doc_id", "detected")


@query("""WITH r AS (SELECT doc_id, text, list_filter([CASE WHEN coalesce(text, '') = '' THEN 'missing id or text' END, CASE WHEN NOT n_chars > 1000 THEN 'missing metadata.chunk_index' END, CASE WHEN lang <> 'en' THEN 'missing metadata.total_chunks' END], lambda e: e IS NOT NULL) AS errors FROM documents),
k AS (SELECT e, count(*) AS n FROM (SELECT unnest(errors) AS e FROM r) GROUP BY e)
SELECT count(*) AS rows, count(*) FILTER (len(errors) > 0) AS bad_rows, median(greatest(1, length(text) // 4)) AS token_p50, avg(greatest(1, length(text) // 4)) AS token_mean, max(greatest(1, length(text) // 4)) AS token_max, (SELECT string_agg(e || '=' || n, '; ' ORDER BY e) FROM k) AS errors FROM r""")
def c22_chunk_errors(spark, sf_dir):
    """Documents as chunks whose metadata holds what the table has of them: what is wrong with how many, and their tokens."""
    docs = read(spark, sf_dir, "documents")
    fixed = [F.lit(x) for k in ("document_id", "content_hash", "ingest_version", "doc_kind") for x in (k, "x")]
    meta = F.create_map(*fixed, F.lit("chunk_index"), F.when(F.col("n_chars") > 1000, "0"), F.lit("total_chunks"), F.when(F.col("lang") == "en", "1"))
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata"))
    report = checks.chunk_report(checks.chunk_errors(rows), F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    listed = F.array_join(F.transform(F.map_entries("by_error"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")
    return report.withColumn("errors", listed).drop("by_error")


@query("""WITH k AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'bigquery' WHEN 'SMALL' THEN 'news' WHEN 'LARGE' THEN 'policy' ELSE 'other' END AS kind, CASE WHEN p_size > 25 THEN p_size / 200 END AS corpus, CASE WHEN p_name LIKE 'small%' THEN 'ranked_table' WHEN p_name LIKE 'red%' THEN 'row' ELSE '' END AS enrichment, p_retailprice < 950 AS numeric, p_size % 2 = 0 AS comparing, CASE WHEN p_size < 10 THEN 'no_time' END AS relaxed FROM part),
b AS (SELECT *, CASE kind WHEN 'bigquery' THEN 0.12 WHEN 'news' THEN 0.04 WHEN 'policy' THEN 0.06 ELSE 0 END AS s FROM k)
SELECT p_partkey, round(greatest(s, coalesce(corpus, s)) + CASE WHEN kind = 'bigquery' THEN CASE WHEN numeric THEN 0.1 WHEN comparing THEN 0.06 ELSE 0 END ELSE 0 END + CASE WHEN enrichment <> '' THEN CASE WHEN numeric THEN 0.05 WHEN comparing THEN 0.04 ELSE 0.05 END ELSE 0 END
  + CASE WHEN enrichment = 'ranked_table' THEN CASE WHEN numeric THEN 0.15 WHEN comparing THEN 0.1 ELSE 0.15 END ELSE 0 END + CASE WHEN relaxed IS NULL THEN 0.05 ELSE 0 END, 6) AS boost FROM b""")
def x2_context_boost(spark, sf_dir):
    """Parts as rows of context: kind by type, corpus boost by size, enrichment by name, numeric and comparing questions by price and size."""
    kind = F.when(F.col("p_type") == "ECONOMY", "bigquery").when(F.col("p_type") == "SMALL", "news").when(F.col("p_type") == "LARGE", "policy").otherwise("other")
    enrichment = F.when(F.col("p_name").startswith("small"), "ranked_table").when(F.col("p_name").startswith("red"), "row").otherwise("")
    boost = retrieval.context_boost(kind, F.when(F.col("p_size") > 25, F.col("p_size") / 200), enrichment, F.lit(False), F.when(F.col("p_size") < 10, "no_time"), F.col("p_retailprice") < 950, F.col("p_size") % 2 == 0)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(boost, 6).alias("boost"))
