"""Queries on what texts are about, on findings, page text and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import text as tx
from terraloom.operators import corpus, meaning
from terraloom.plans.base import query, read

_WORD = lambda w: "".join(c if c.isalnum() or c == " " else "\\" + c for c in w)


def _counted(words: list[str]) -> str:
    """SQL that counts words among those of a text (w), words with a mark in it with doubled separators (dd), and phrases as they stand (t)."""
    plain = [w for w in words if w.isalnum()]
    parts = [f"len(list_filter(w, lambda x: x IN ({', '.join(repr(w) for w in plain)})))"] if plain else []
    for w in words:
        if not w.isalnum():
            parts.append(f"len(regexp_extract_all(t, '{_WORD(w)}'))" if " " in w else rf"len(regexp_extract_all(dd, '(?:^|[^\p{{L}}\p{{N}}_]){_WORD(w)}(?:[^\p{{L}}\p{{N}}_]|$)'))")
    return " + ".join(parts)


def _taxonomy_sql(lexicon: dict[str, list[str]], most: int) -> str:
    rows = ", ".join(f"{{'s': {_counted(words)}, 'i': {i}, 'name': '{name}'}}" for i, (name, words) in enumerate(lexicon.items()))
    return f"""WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
d AS (SELECT *, regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+') AS w, regexp_replace(t, '([^\\p{{L}}\\p{{N}}_-])', '\\1\\1', 'g') AS dd FROM l), r AS (SELECT doc_id, unnest([{rows}]) AS x FROM d),
k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY x.s DESC, x.i) AS n FROM r WHERE x.s > 0)
SELECT d.doc_id, coalesce(string_agg(x.name, '; ' ORDER BY n) FILTER (WHERE n <= {most}), 'agriculture') AS domains FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY 1"""


@query(_taxonomy_sql(meaning.TAXONOMY, 4))
def c9_taxonomy(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(meaning.taxonomy(F.col("text"), meaning.TAXONOMY), "; ").alias("domains"))


_BODY = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i)\\n\\s*{e}\\s*\\n') THEN string_split_regex(t, '(?i)\\n\\s*{e}\\s*\\n')[1]" for e in meaning.ENDINGS) + " ELSE t END"


@query(rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, source, {_BODY} AS body FROM d)
SELECT doc_id, CASE WHEN NOT (regexp_matches(body, '(?i)\bdoi:\s*10\.') OR regexp_matches(lower(body), '\bjournal of\b') OR contains(lower(coalesce(source, '')), '1-s2.0') OR regexp_matches(substring(lower(body), 1, 8000), '\babstract\b'))
AND {' + '.join(f"contains(lower(body), '{m}')::INT" for m in meaning.OFFICIAL)} >= 2 THEN 'government_report' ELSE 'academic_article' END AS info_type FROM b""")
def c11_document_type(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", meaning.document_type(F.col("text"), F.col("source")).alias("info_type"))


@query("""SELECT event_id, CASE WHEN try_cast(props->>'k' AS INT) IN (1, 2, 3) THEN try_cast(props->>'k' AS INT) WHEN event_type IN ('academic', 'policy') THEN 1 WHEN event_type = 'user_submitted' THEN 3 ELSE 2 END AS tier FROM events""")
def c19_authority_tier(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", meaning.authority(F.get_json_object("props", "$.k"), F.col("event_type")).alias("tier"))


@query()
def c17_findings(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", meaning.finding(F.col("text")).alias("finding"))


@query()
def c1_page_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", meaning.page_title(F.col("html")).alias("title"), meaning.page_text("html").alias("text"))


@query(r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_type || ' (' || p_name || ')/' || p_brand), '[\p{L}\p{N}]+[^\p{L}\p{N}]*|[^\p{L}\p{N}]+'), lambda p: upper(p[1:1]) || p[2:]), '') AS label FROM part""")
def f6_initcap(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", meaning.initcap_words(F.concat("p_type", F.lit(" ("), "p_name", F.lit(")/"), "p_brand")).alias("label"))


#: ISO 3166 codes of the nations in the table.
ISO2 = {"DZ": "Algeria", "AR": "Argentina", "BR": "Brazil", "CA": "Canada", "EG": "Egypt", "ET": "Ethiopia", "FR": "France", "DE": "Germany", "IN": "India", "ID": "Indonesia", "IR": "Iran", "IQ": "Iraq", "JP": "Japan", "JO": "Jordan", "KE": "Kenya", "MA": "Morocco", "MZ": "Mozambique", "PE": "Peru", "CN": "China", "RO": "Romania", "SA": "Saudi Arabia", "VN": "Vietnam", "RU": "Russia", "GB": "United Kingdom", "US": "United States"}


@query(f"""WITH i(code, country) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in ISO2.items())}) SELECT c_custkey, substring(upper(n_name), 1, 2) AS code, country FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN i ON substring(upper(n_name), 1, 2) = code""")
def f23_iso2_names(spark, sf_dir):
    names = spark.createDataFrame(list(ISO2.items()), "code string, country string")
    customers, nations = read(spark, sf_dir, "customer", "nation")
    coded = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.upper(F.substring("n_name", 1, 2)).alias("code"))
    return coded.join(F.broadcast(names), "code", "left").select("c_custkey", "code", "country")


@query()
def d1_three_keys(spark, sf_dir):
    title = tx.normalize_title(meaning.page_title(F.col("html")))
    host = F.lower(F.regexp_extract("url", r"//(?:www\.)?([^/?#]*)", 1))
    rows = read(spark, sf_dir, "pages").select("page_id", F.nullif(tx.normalize_url(F.col("url")), F.lit("")).alias("url"), F.when(title != "", F.concat_ws("|", title, host)).alias("title"), meaning.page_text("html").alias("text"))
    rows = rows.select("page_id", "url", "title", F.when(F.col("text") != "", F.md5("text")).alias("body"))
    return corpus.greedy_dedup(rows, "page_id", ["url", "title", "body"])
