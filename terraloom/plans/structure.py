"""Queries on sections, byte budgets, places, stamped claims, bibliography and context keys, at full strength beside the earlier ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import corpus, meaning, structure
from terraloom.plans.base import query, read

_CASES = " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{r}'" for r, p in structure.TITLES) + " " + " ".join(f"WHEN len(list_intersect(string_split(path, '/'), {words})) > 0 THEN '{r}'" for r, words in structure.ROLES.items())


@query(rf"""WITH RECURSIVE e AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, trim(text) AS t, role = 'user' AS head, role <> 'user' AND len(string_split(text, chr(10))) >= 4 AS tab, least(len(string_split(text, chr(10))) - 1, 6) AS level
  FROM conversations WHERE trim(coalesce(text, '')) <> ''),
h AS (SELECT *, array_to_string(string_split(regexp_replace(t, '\s+', ' ', 'g'), ' ')[1:5], ' ') AS name FROM e),
f AS (
  SELECT conv_id, 0::BIGINT AS n, []::VARCHAR[] AS path, []::VARCHAR[] AS titles FROM (SELECT DISTINCT conv_id FROM h)
  UNION ALL
  SELECT h.conv_id, h.n, CASE WHEN head THEN list_append(f.path[1:least(len(f.path), CASE WHEN level > 0 THEN level ELSE least(len(f.path) + 1, 4) END - 1)],
      coalesce(nullif(left(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), 120), ''), 'section')) ELSE f.path END,
    CASE WHEN head THEN list_append(f.titles[1:least(len(f.path), CASE WHEN level > 0 THEN level ELSE least(len(f.path) + 1, 4) END - 1)], left(name, 200)) ELSE f.titles END
  FROM f JOIN h ON h.conv_id = f.conv_id AND h.n = f.n + 1),
s AS (SELECT h.*, f.path, f.titles, sum((head OR tab)::INT) OVER (PARTITION BY h.conv_id ORDER BY h.n) AS run FROM h JOIN f ON f.conv_id = h.conv_id AND f.n = h.n),
b AS (
  SELECT conv_id, min(n) AS n, any_value(path) AS path, any_value(titles) AS titles, 'prose' AS kind, string_agg(t, chr(10) || chr(10) ORDER BY n) AS text FROM s WHERE NOT head AND NOT tab GROUP BY conv_id, run
  UNION ALL SELECT conv_id, n, list_append(CASE WHEN len(path) > 0 THEN path ELSE ['body'] END, 'table'), titles, 'table', t FROM s WHERE tab
  UNION ALL SELECT conv_id, 0, [], [], 'prose', string_agg(name, chr(10) || chr(10) ORDER BY n) FROM s GROUP BY conv_id HAVING bool_and(head)),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS block, coalesce(nullif(array_to_string(path, '/'), ''), 'body') AS path, coalesce(titles[-1], 'body') AS title, kind, text FROM b)
SELECT conv_id, block, path, title, kind, text, CASE WHEN kind = 'table' THEN 'table' WHEN regexp_matches(path, '{'|'.join(structure.BOILERPLATE)}') THEN 'boilerplate' {_CASES} ELSE 'content' END AS role FROM o""")
def c13_structure_blocks(spark, sf_dir):
    """Conversations as documents: what users say heads a section as deep as it has lines, answers of four lines or more are tables; with each block's role."""
    rows = read(spark, sf_dir, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    lines = F.size(F.split("text", "\n"))
    head = F.array_join(F.slice(F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " "), 1, 5), " ")
    kind = F.when(F.col("role") == "user", "title").when(lines >= 4, "table").otherwise("text")
    elements = rows.select("conv_id", "turn", kind.alias("kind"), F.when(F.col("role") == "user", head).otherwise(F.trim("text")).alias("text"), F.least(lines - 1, F.lit(6)).alias("level"))
    found = structure.element_blocks(elements, "conv_id", "turn")
    return found.withColumn("role", structure.section_role(F.col("path"), F.col("title"), F.col("kind"))).withColumn("block", F.col("block").cast("long"))


@query("""WITH d AS (SELECT doc_id, lower(text) AS t, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\n'), 1) AS n FROM d),
q AS (SELECT *, trim(line) = '' AS blank FROM p), r AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM q)
SELECT doc_id, 0 AS block, 'body' AS path, 'body' AS title, 'prose' AS kind, string_agg(para, chr(10) || chr(10) ORDER BY g) AS text
FROM (SELECT doc_id, g, string_agg(trim(line), chr(10) ORDER BY n) AS para FROM r WHERE NOT blank GROUP BY doc_id, g) GROUP BY doc_id""".replace("\\\\", "\\"))
def c13_text_blocks(spark, sf_dir):
    """Blocks of whole document texts in one pass."""
    return structure.text_blocks(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("block", F.col("block").cast("long"))


_BUDGET = 3000


@query(f"""WITH s AS (SELECT doc_id, source, text, strlen(coalesce(text, '')) AS n, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id) - strlen(coalesce(text, '')) AS before FROM documents),
k AS (SELECT *, {_BUDGET} - before AS room FROM s WHERE before <= {_BUDGET} AND (n <= {_BUDGET} - before OR {_BUDGET} - before > 32))
SELECT source, doc_id, n > room AS truncated, CASE WHEN n <= room THEN text ELSE regexp_replace(left(text, (SELECT max(c) FROM range(0, {_BUDGET} + 1) r(c) WHERE c <= room AND strlen(left(text, c::BIGINT)) <= room - 3)::BIGINT), '\\s+$', '') || '…' END AS text FROM k""")
def w5_crossing_row(spark, sf_dir):
    """What fits into the byte budget of each source, with as much of the crossing text as is left."""
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return structure.byte_budget(rows, "source", ["doc_id"], "text", _BUDGET)


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS word FROM documents),
names AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS n FROM w GROUP BY word QUALIFY n <= 40),
ranked AS (SELECT word, row_number() OVER (ORDER BY length(word) DESC, n) AS place FROM names),
d AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x) AS ws FROM documents),
c AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS word FROM d) JOIN names USING (word) GROUP BY doc_id, word),
m AS (SELECT doc_id, c.word, k, place, count(*) OVER (PARTITION BY doc_id) AS all_n, count(*) FILTER (k >= 2) OVER (PARTITION BY doc_id) AS often FROM c JOIN ranked r ON r.word = c.word),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, place) AS n FROM m WHERE all_n <= 3 OR k >= 2 OR often = 0)
SELECT d.doc_id, coalesce((SELECT string_agg(word, '; ' ORDER BY n) FROM x WHERE x.doc_id = d.doc_id AND n <= CASE WHEN all_n > 3 AND often = 0 THEN 5 ELSE 12 END), '') AS places FROM d""")
def c10_places_of_focus(spark, sf_dir):
    """Whole texts of all languages with the 40 most frequent longer words of the corpus as names; the operator's own list are the countries."""
    docs = read(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), 0)).alias("word")).groupBy("word").count()
    names = [r["word"] for r in words.orderBy(F.desc("count"), "word").limit(40).collect()]
    return docs.select("doc_id", F.array_join(structure.places_of_focus(F.col("text"), names, {}), "; ").alias("places"))


def _first(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(t, '(?i){pattern}') THEN length(string_split_regex(t, '(?i){pattern}')[1]) + 1 ELSE 0 END"


def _sentence(pattern: str) -> str:
    before, hit = f"string_split_regex(t, '(?i){pattern}')[1]", f"regexp_extract(t, '(?i){pattern}')"
    return f"WHEN regexp_matches(t, '(?i){pattern}') THEN trim(regexp_replace(regexp_extract({before}, '[^.]*$') || {hit} || regexp_extract(substring(t, length({before}) + length({hit}) + 1), '^[^.]*\\.?'), '\\s+', ' ', 'g'))"


@query(rf"""WITH d AS (SELECT doc_id, source, lang, trim(coalesce(text, '')) AS t FROM documents),
p AS (SELECT *, {_first(corpus.RISE)} AS rise, {_first(corpus.FALL)} AS fall, {_first(corpus.STABLE)} AS stable, regexp_extract(t, '(?i){corpus.PERCENT}', 1) AS sign, regexp_extract(t, '(?i){corpus.PERCENT}', 2) AS num, regexp_extract(t, '(?i){corpus.PERCENT}', 3) AS yearly,
  CASE {_sentence(corpus.PERCENT)} {_sentence(corpus.FALL)} {_sentence(corpus.RISE)} {_sentence(corpus.STABLE)} END AS s FROM d),
w AS (SELECT *, CASE WHEN rise > 0 AND (fall = 0 OR rise <= fall) THEN 'increasing' WHEN fall > 0 THEN 'decreasing' WHEN stable > 0 THEN 'stable' ELSE 'unknown' END AS word FROM p),
m AS (SELECT *, CASE WHEN num <> '' THEN CASE WHEN sign IN ('-', '−', '–') OR (sign = '' AND word = 'decreasing') THEN -num::DOUBLE ELSE num::DOUBLE END END AS magnitude FROM w),
u AS (SELECT *, CASE WHEN word = 'unknown' AND magnitude < 0 THEN 'decreasing' WHEN word = 'unknown' AND magnitude > 0 THEN 'increasing' ELSE word END AS dir FROM m),
v AS (SELECT *, dir <> 'unknown' OR magnitude IS NOT NULL AS usable FROM u)
SELECT doc_id, CASE WHEN usable THEN CASE WHEN length(s) > 300 THEN rtrim(left(s, 299)) || '…' ELSE s END END AS finding, CASE WHEN usable THEN CASE WHEN lang = 'en' THEN source ELSE lang END END AS metric, CASE WHEN usable THEN dir END AS direction,
  CASE WHEN usable THEN magnitude END AS magnitude, CASE WHEN num <> '' THEN CASE WHEN yearly <> '' THEN 'pct_yoy' ELSE 'pct' END END AS unit FROM v""")
def c17_stamped_claims(spark, sf_dir):
    """Claims of whole texts stamped on their metadata twice, which changes nothing: English ones have a structured item, all a domain."""
    docs = read(spark, sf_dir, "documents")
    meta = F.map_filter(F.create_map(F.lit("item"), F.when(F.col("lang") == "en", F.col("source")), F.lit("domains"), F.concat("lang", F.lit("; other"))), lambda k, v: v.isNotNull())
    rows = docs.select("doc_id", "text", meta.alias("meta"))
    stamped = structure.stamp_claims(structure.stamp_claims(rows, "text", "meta"), "text", "meta")
    get = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    return stamped.select("doc_id", get("finding"), get("metric"), get("direction"), get("magnitude").cast("double").alias("magnitude"), get("unit"))


@query(rf"""WITH r AS (
  SELECT 'page' AS kind, page_id AS id, url AS url, '' AS title, '' AS authors, '' AS year, '' AS document, '' AS text FROM pages
  UNION ALL SELECT 'document', doc_id, '', '', '', '', '', text FROM documents
  UNION ALL SELECT 'order', o_orderkey, '', o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'Clerk ' || o_custkey % 7 ELSE '' END, CASE WHEN o_orderstatus = 'O' THEN year(o_orderdate)::VARCHAR ELSE '' END, CASE WHEN o_orderstatus = 'P' THEN 'Order ' || o_custkey ELSE '' END, '' FROM orders),
n AS (SELECT *, lower(trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g'))) AS ti, lower(trim(regexp_replace(authors, '\s+', ' ', 'g'))) AS au, left(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), 240) AS tx, regexp_replace(trim(url), '#.*$', '') AS bare FROM r),
k AS (SELECT kind, id, CASE WHEN starts_with(trim(url), 'http') THEN 'url:' || lower(regexp_replace(bare, '\?.*$', '') || CASE WHEN len(list_filter(string_split(CASE WHEN contains(bare, '?') THEN regexp_extract(bare, '\?(.*)$', 1) ELSE '' END, '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(utm_|fbclid|li_)'))) > 0
    THEN '?' || array_to_string(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(utm_|fbclid|li_)')), '&') ELSE '' END)
  WHEN ti <> '' AND (au <> '' OR year <> '') THEN 'work:' || left(ti, 160) || '|' || left(au, 120) || '|' || year WHEN document <> '' AND ti <> '' THEN 'doc:' || lower(document) || '|' || left(ti, 80)
  WHEN tx <> '' THEN 'text:' || left(sha1(tx), 16) ELSE 'id:' || id END AS key FROM n)
SELECT kind, min(id) AS first_id, key, count(*) AS n FROM k GROUP BY kind, key""")
def d2_key_ladder(spark, sf_dir):
    """Pages by URL, documents by text, orders as works of a title with authors, year or document: the first row and the number of rows of each key."""
    pages, docs, orders = read(spark, sf_dir, "pages", "documents", "orders")
    names = ["url", "title", "authors", "year", "document", "text"]
    shape = lambda df, kind, key, **given: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), *[given.get(n, F.lit("")).alias(n) for n in names])
    status = lambda s, c: F.when(F.col("o_orderstatus") == s, c).otherwise("")
    work = {"title": F.col("o_orderpriority"), "authors": status("F", F.concat(F.lit("Clerk "), (F.col("o_custkey") % 7).cast("string"))), "year": status("O", F.year("o_orderdate").cast("string")), "document": status("P", F.concat(F.lit("Order "), F.col("o_custkey").cast("string")))}
    rows = shape(pages, "page", "page_id", url=F.col("url")).unionByName(shape(docs, "document", "doc_id", text=F.col("text"))).unionByName(shape(orders, "order", "o_orderkey", **work))
    key = structure.context_key({n: F.col(n) for n in names}, F.col("id"))
    return rows.groupBy("kind", key.alias("key")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@query()
def c20_bibliography_of_texts(spark, sf_dir):
    """What the heads of whole texts and of pages' main text tell of title, authors, year, journal, DOI and pages."""
    docs, pages = read(spark, sf_dir, "documents", "pages")
    texts = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.regexp_replace(F.regexp_replace("html", "(?s)<[^>]*>", "\n"), "&[a-z]+;", " ").alias("text")))
    found = structure.bibliography(F.col("text"))
    return texts.select("kind", "id", *[found[c].alias(c) for c in structure.BIBLIOGRAPHY])
