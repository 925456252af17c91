"""Warehouse queries: harmonising, star schema, joins, aggregates, windows, metric questions, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from terraloom.operators import checks, harmonise, joins, metrics, star
from terraloom.operators.metrics import MetricTable
from terraloom.plans.base import query, read

PARTY = StructType([StructField("party_id", LongType()), StructField("party_name", StringType()), StructField("nation_key", IntegerType()), StructField("balance", DoubleType()), StructField("segment", StringType()), StructField("kind", StringType())])


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with year and the supplier's nation: the metric table of the questions below."""
    line, supplier, nation = read(spark, sf_dir, "lineitem", "supplier", "nation")
    placed = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return placed.select("n_name", "l_shipdate", F.year("l_shipdate").alias("year"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_partkey")


QUANTITY = MetricTable("shipped", geo="n_name", year="year", value="l_quantity", discriminators={"l_returnflag": "A"}, date="l_shipdate")
_SHIPPED = "(SELECT n_name, year(l_shipdate) AS year, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1_read_layer(spark, sf_dir):
    return read(spark, sf_dir, "nation")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def s2_extract_partition(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(500)


@query("SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_acctbal AS balance, s_suppkey::VARCHAR || '|' || s_name AS source_natural_key FROM supplier")
def p1_rename_and_cast(spark, sf_dir):
    mapping = {"supplier_id": ("s_suppkey", "bigint"), "supplier_name": ("s_name", "string"), "balance": ("s_acctbal", "double")}
    return harmonise.rename_and_cast(read(spark, sf_dir, "supplier"), mapping, ["s_suppkey", "s_name"])


@query("""SELECT c_custkey AS party_id, c_name AS party_name, c_nationkey AS nation_key, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def p2_union_harmonise(spark, sf_dir):
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    return harmonise.union_harmonise(
        PARTY,
        (customer, {"party_id": "c_custkey", "party_name": "c_name", "nation_key": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment", "kind": F.lit("customer")}),
        (supplier, {"party_id": "s_suppkey", "party_name": "s_name", "nation_key": "s_nationkey", "balance": "s_acctbal", "kind": F.lit("supplier")}),
    )


@query("""SELECT o_orderkey AS row_key, 'order' AS measure_type, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, o_totalprice AS metric_value FROM orders
UNION ALL SELECT l_orderkey, 'line', year(l_shipdate)::INT, month(l_shipdate)::INT, l_extendedprice FROM lineitem""")
def p3_two_measure_union(spark, sf_dir):
    orders, line = read(spark, sf_dir, "orders", "lineitem")
    one = lambda df, key, kind, date, value: df.select(F.col(key).alias("row_key"), F.lit(kind).alias("measure_type"), F.year(date).alias("year"), F.month(date).alias("month"), F.col(value).alias("metric_value"))
    return one(orders, "o_orderkey", "order", "o_orderdate", "o_totalprice").unionByName(one(line, "l_orderkey", "line", "l_shipdate", "l_extendedprice"))


@query("""SELECT * FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS large, CASE WHEN p_retailprice > 1500 THEN p_retailprice END AS dear FROM part) WHERE large IS NOT NULL OR dear IS NOT NULL""")
def p4_all_null_filter(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("large"), F.when(F.col("p_retailprice") > 1500, F.col("p_retailprice")).alias("dear"))
    return harmonise.drop_all_null(part, ["large", "dear"])


@query("SELECT DISTINCT p_type, p_brand FROM part WHERE lower(p_type) LIKE '%economy%' OR lower(p_type) LIKE '%promo%'")
def p6_keyword_family(spark, sf_dir):
    return harmonise.keyword_family(read(spark, sf_dir, "part").select("p_type", "p_brand"), "p_type", ["economy", "promo"])


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_brand), '#1$|#2$') THEN 1 WHEN regexp_matches(lower(p_brand), '#1') THEN 2 ELSE 3 END AS tier,
CASE WHEN regexp_matches(lower(p_type), 'economy') THEN 'primary' WHEN regexp_matches(lower(p_type), 'standard|promo') THEN 'derived' ELSE 'other' END AS data_level FROM part""")
def p7_case_buckets(spark, sf_dir):
    tier = harmonise.case_map(F.col("p_brand"), [("#1$|#2$", 1), ("#1", 2)], 3)
    level = harmonise.case_map(F.col("p_type"), [("economy", "primary"), ("standard|promo", "derived")], "other")
    return read(spark, sf_dir, "part").select("p_partkey", tier.alias("tier"), level.alias("data_level"))


@query("SELECT n_nationkey, n_name FROM nation WHERE CASE lower(trim(n_name)) WHEN 'nation_9' THEN 'nation_3' ELSE lower(trim(n_name)) END IN ('nation_3', 'nation_5', 'nation_8')")
def p8_allow_list(spark, sf_dir):
    names = spark.createDataFrame([(" Nation_3",), ("NATION_5",), ("nation_8 ",)], "name string")
    return harmonise.allow_list(read(spark, sf_dir, "nation"), "n_name", names, {"nation_9": "nation_3"}).select("n_nationkey", "n_name")


@query("""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(source || '; ' || upper(source) || ' ;' || lang || ';;', ';'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
e AS (SELECT doc_id, list_filter(parts, lambda x, i: list_position(list_transform(parts, lambda y: lower(y)), lower(x)) = i) AS places FROM d)
SELECT doc_id, array_to_string(places, ';') AS geo_countries, places[1] AS geo_primary, CASE WHEN len(places) = 0 THEN 'unknown' WHEN len(places) = 1 THEN 'country' ELSE 'multi_country' END AS geo_scope FROM e""")
def p9_place_list(spark, sf_dir):
    raw = F.concat(F.col("source"), F.lit("; "), F.upper("source"), F.lit(" ;"), F.col("lang"), F.lit(";;"))
    docs = read(spark, sf_dir, "documents").select("doc_id", harmonise.clean_list(raw).alias("places"))
    scope = F.when(F.size("places") == 0, "unknown").when(F.size("places") == 1, "country").otherwise("multi_country")
    return docs.select("doc_id", F.array_join("places", ";").alias("geo_countries"), F.get("places", F.lit(0)).alias("geo_primary"), scope.alias("geo_scope"))


@query("""SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS element, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS metric_value FROM lineitem""")
def p10_unpivot_metrics(spark, sf_dir):
    return harmonise.unpivot_metrics(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("SELECT event_id, event_type FROM events WHERE props IS NOT NULL AND trim(props) <> '' AND event_type NOT IN ('error') AND NOT contains(lower(props), '\"k\": 7')")
def p12_usable_rows(spark, sf_dir):
    return harmonise.usable(read(spark, sf_dir, "events"), "props", "event_type", ["error"], ['"k": 7']).select("event_id", "event_type")


@query("SELECT n_nationkey, md5(n_nationkey::VARCHAR || '|' || n_name || '|' || coalesce(n_regionkey::VARCHAR, '')) AS nation_key FROM nation")
def k1_surrogate_key(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", star.surrogate_key("n_nationkey", "n_name", "n_regionkey").alias("nation_key"))


@query("SELECT DISTINCT c_mktsegment, md5(c_mktsegment) AS segment_key, DATE '2000-01-01' AS valid_from, NULL::DATE AS valid_to, true AS is_current FROM customer")
def k2_dimension(spark, sf_dir):
    return star.dimension(read(spark, sf_dir, "customer"), "segment_key", ["c_mktsegment"])


@query("""SELECT md5(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR) AS shipment_key, md5(l_partkey::VARCHAR) AS part_key, md5(l_suppkey::VARCHAR) AS supplier_key,
md5(strftime(l_shipdate, '%Y-%m-%d')) AS time_key, l_quantity::DOUBLE AS quantity FROM lineitem WHERE l_returnflag = 'R'""")
def k3_fact(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    spec = star.FactSpec("shipment", ["l_orderkey", "l_linenumber"], {"part_key": ["l_partkey"], "supplier_key": ["l_suppkey"], "time_key": ["day"]}, {"quantity": "l_quantity"}, "l_returnflag = 'R'")
    return star.fact(line, spec).withColumn("quantity", F.col("quantity").cast("double"))


@query("""SELECT md5(strftime(d, '%Y-%m-%d')) AS time_key, d AS date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month, monthname(d) AS month_name, (dayofweek(d) + 1)::INT AS day_of_week,
((dayofyear(d) + 6 - dayofweek(d)) // 7)::INT AS week, dayofweek(d) IN (0, 6) AS is_weekend, (year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END)::INT AS fiscal_year
FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)""")
def k4_time_dimension(spark, sf_dir):
    return star.time_dimension(read(spark, sf_dir, "orders"), "o_orderdate")


@query("""SELECT r_name, n_name, s_name, md5(r_name || '|' || coalesce(n_name, '') || '|' || coalesce(s_name, '')) AS geo_key
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def k5_geography(spark, sf_dir):
    region, nation, supplier = read(spark, sf_dir, "region", "nation", "supplier")
    rows = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("r_name", "n_name", "s_name", star.surrogate_key("r_name", "n_name", "s_name").alias("geo_key"))


@query("SELECT o_orderstatus, status_name, status_key, count(*) AS n FROM orders JOIN (SELECT *, md5(o_orderstatus) AS status_key FROM (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'partial')) v(o_orderstatus, status_name)) USING (o_orderstatus) GROUP BY ALL")
def k6_seed_dimension(spark, sf_dir):
    status = star.seed(spark, [("F", "filled"), ("O", "open"), ("P", "partial")], "o_orderstatus string, status_name string", "status_key", ["o_orderstatus"])
    return read(spark, sf_dir, "orders").join(F.broadcast(status), "o_orderstatus").groupBy("o_orderstatus", "status_name", "status_key").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'minimal' WHEN p_size <= 25 THEN 'stressed' WHEN p_size <= 40 THEN 'crisis' ELSE p_name END AS phase_name FROM part")
def k7_phase_label(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", F.when(size <= 10, "minimal").when(size <= 25, "stressed").when(size <= 40, "crisis").otherwise(F.col("p_name")).alias("phase_name"))


@query("SELECT md5(c_name || '|' || coalesce(c_mktsegment, '')) AS person_key, coalesce(c_name, '') || ' (' || coalesce(c_mktsegment, 'none') || ')' AS full_name, c_nationkey FROM customer")
def k8_person_dimension(spark, sf_dir):
    name = F.concat(F.coalesce("c_name", F.lit("")), F.lit(" ("), F.coalesce("c_mktsegment", F.lit("none")), F.lit(")"))
    return read(spark, sf_dir, "customer").select(star.surrogate_key("c_name", "c_mktsegment").alias("person_key"), name.alias("full_name"), "c_nationkey")


@query("SELECT s_suppkey AS party_id, s_name AS party_name, s_nationkey AS nation_key, NULL::DOUBLE AS balance, NULL::VARCHAR AS segment, NULL::VARCHAR AS kind FROM supplier")
def k9_facade(spark, sf_dir):
    return star.facade(read(spark, sf_dir, "supplier"), PARTY, {"party_id": "s_suppkey", "party_name": "s_name", "nation_key": "s_nationkey"})


@query("SELECT p_brand, sum(l_quantity)::DOUBLE AS quantity, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand")
def j1_star_join(spark, sf_dir):
    line, part, supplier = read(spark, sf_dir, "lineitem", "part", "supplier")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.groupBy("p_brand").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, s_suppkey, c_custkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey = s_suppkey")
def j2_fanout_join(spark, sf_dir):
    nation, supplier, customer = read(spark, sf_dir, "nation", "supplier", "customer")
    joined = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.join(customer, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_custkey") == F.col("s_suppkey")), "left").select("n_nationkey", "n_name", "s_suppkey", "c_custkey")


@query("""WITH a AS (SELECT round(l_discount, 2) AS lat, round(l_tax, 2) AS lon, count(*) AS lines FROM lineitem WHERE l_returnflag = 'A' AND l_discount < 0.08 GROUP BY ALL),
b AS (SELECT round(l_discount, 2) AS lat, round(l_tax, 2) AS lon, count(*) AS returns FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.03 GROUP BY ALL)
SELECT coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon, lines, returns FROM a FULL JOIN b ON a.lat = b.lat AND a.lon = b.lon""")
def j3_grid_full_join(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").withColumns({"lat": F.round("l_discount", 2), "lon": F.round("l_tax", 2)})
    cells = lambda where, name: line.where(where).groupBy("lat", "lon").agg(F.count("*").alias(name))
    return joins.grid_full_join(cells("l_returnflag = 'A' AND l_discount < 0.08", "lines"), cells("l_returnflag = 'R' AND l_discount > 0.03", "returns"))


@query("SELECT r_regionkey, r_name, y::INT AS year FROM region, range(2000, 2027) t(y)")
def j4_calendar_bridge(spark, sf_dir):
    return joins.calendar_bridge(read(spark, sf_dir, "region"), 2000, 2026)


@query(f"""WITH y AS (SELECT n_name, year, round(sum(l_quantity), 4) AS total FROM {_SHIPPED} GROUP BY ALL)
SELECT a.n_name, a.year::INT AS year, a.total AS curr, b.total AS prev, round(a.total - b.total, 4) AS delta FROM y a JOIN y b ON a.n_name = b.n_name AND a.year = b.year + 1""")
def j5_year_self_join(spark, sf_dir):
    totals = shipped(spark, sf_dir).groupBy("n_name", "year").agg(F.round(F.sum("l_quantity"), 4).alias("total"))
    w = W.partitionBy("n_name").orderBy("year")
    rows = totals.withColumns({"prev": F.lag("total").over(w), "before": F.lag("year").over(w)}).where(F.col("before") == F.col("year") - 1)
    return rows.select("n_name", "year", F.col("total").alias("curr"), "prev", F.round(F.col("total") - F.col("prev"), 4).alias("delta"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en')")
def j8_unseen_hashes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("content_hash"))
    return joins.unseen(docs, docs.where("lang = 'en'"), "content_hash").select("doc_id", "content_hash")


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT vec_id AS site_id, x, y FROM p WHERE vec_id % 10 = 0)
SELECT vec_id, arg_min(site_id, (sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), site_id)) AS site_id, round(min(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2)), 9) AS distance FROM p, s GROUP BY vec_id""")
def j9_nearest_site(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    sites = points.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "site_id")
    return joins.nearest(points, sites, "vec_id", "site_id", "x", "y", cell=0.02).withColumn("distance", F.round("distance", 9))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def j10_declared_enrichment(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders", "customer")
    out = joins.enrich(orders.where("o_orderstatus = 'P'"), customer, joins.JoinSpec("orders", "customer", [("o_custkey", "c_custkey")]))
    return out.select("o_orderkey", F.col("customer_c_name").alias("c_name"), F.col("customer_c_mktsegment").alias("c_mktsegment"))


@query("""WITH t AS (SELECT p_partkey, p_name || ' ' || lower(p_brand) AS title FROM part), k AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM t),
a AS (SELECT * FROM k WHERE p_partkey % 20 = 0)
SELECT a.p_partkey, k.p_partkey AS other, round(len(list_intersect(a.w, k.w)) / (len(a.w) + len(k.w) - len(list_intersect(a.w, k.w))), 9) AS similarity
FROM a, k WHERE 100 * len(list_intersect(a.w, k.w)) >= 85 * (len(a.w) + len(k.w) - len(list_intersect(a.w, k.w)))""")
def j11_title_match(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("title"))
    return joins.title_match(part.where("p_partkey % 20 = 0"), part.withColumnRenamed("p_partkey", "other"), "p_partkey", "other", "title").withColumn("similarity", F.round("similarity", 9))


@query("SELECT d.l_orderkey, d.l_partkey, m.l_extendedprice, m.l_tax FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) d LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice, max(l_tax) AS l_tax FROM lineitem GROUP BY 1) m USING (l_orderkey)")
def j12_dedupe_attach(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    return joins.attach_max(line.select("l_orderkey", "l_partkey"), line, ["l_orderkey"], ["l_extendedprice", "l_tax"])


@query("""SELECT l_returnflag, l_linestatus, year(l_shipdate)::INT AS year, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL""")
def a1_group_aggregate(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""SELECT name, year::INT AS year, count(*) AS n FROM (SELECT 'orders' AS name, year(o_orderdate) AS year FROM orders UNION ALL SELECT 'events', year(ts) FROM events) WHERE year IS NULL OR year BETWEEN 1995 AND 2024 GROUP BY ALL""")
def a3_indicator_coverage(spark, sf_dir):
    orders, events = read(spark, sf_dir, "orders", "events")
    rows = harmonise.union_tagged({"orders": orders.select(F.year("o_orderdate").alias("year")), "events": events.select(F.year("ts").alias("year"))}, "name")
    return metrics.coverage(rows, ["name"], "year", 1995, 2024)


@query("SELECT l_suppkey, count(DISTINCT l_returnflag) AS flags FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT l_returnflag) < 3")
def a4_having_distinct(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("flags")).where("flags < 3")


@query("""SELECT round(l_discount, 2) AS lat, round(l_tax, 2) AS lon, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS returned FROM lineitem GROUP BY 1, 2""")
def a6_grid_aggregate(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.round("l_discount", 2).alias("lat"), F.round("l_tax", 2).alias("lon")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), 6).alias("returned"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE lang IS NULL OR trim(lang) = '') AS missing_lang, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing_text,
round(100.0 * count(*) FILTER (WHERE lang IS NULL OR trim(lang) = '') / count(*), 4)::DOUBLE AS pct_lang, round(100.0 * count(*) FILTER (WHERE text IS NULL OR trim(text) = '') / count(*), 4)::DOUBLE AS pct_text FROM documents GROUP BY source""")
def a8_completeness(spark, sf_dir):
    return metrics.completeness(read(spark, sf_dir, "documents"), ["lang", "text"], "source")


@query("""SELECT count(*) AS n, quantile_cont(t, 0.5)::DOUBLE AS p50, round(avg(t), 6) AS mean, max(t) AS most FROM (SELECT greatest(1, length(text) // 4)::BIGINT AS t FROM documents)""")
def a9_token_stats(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select(F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("t"))
    return t.agg(F.count("*").alias("n"), F.percentile("t", 0.5).alias("p50"), F.round(F.avg("t"), 6).alias("mean"), F.max("t").alias("most"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events WHERE event_type <> 'view'), 6) AS share FROM events WHERE event_type <> 'view' GROUP BY 1")
def a10_status_share(spark, sf_dir):
    counts = read(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("event_type", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


@query("SELECT event_type, k AS key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def a11_payload_census(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query(f"""SELECT n_name, year::INT AS year, total, row_number() OVER (PARTITION BY year ORDER BY total DESC, n_name)::INT AS rank FROM (SELECT n_name, year, round(sum(l_quantity), 4) AS total FROM {_SHIPPED} GROUP BY ALL)""")
def w1_rank(spark, sf_dir):
    totals = shipped(spark, sf_dir).groupBy("n_name", "year").agg(F.round(F.sum("l_quantity"), 4).alias("total"))
    return metrics.ranked(totals, ["year"], [F.desc("total"), F.col("n_name")])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def w2_best_per_key(spark, sf_dir):
    return metrics.first_per_key(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")])


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS total_chunks FROM conversations")
def w3_chunk_index(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("chunk_index"), F.count("*").over(W.partitionBy("conv_id")).alias("total_chunks"))


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 50000")
def w5_budget_cut(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return metrics.budget_cut(docs, ["source"], [F.col("doc_id")], F.col("size"), 50_000).select("source", "doc_id", "running")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS rank FROM events) WHERE rank <= 3")
def t2_top_n_per_group(spark, sf_dir):
    return metrics.ranked(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 3).select("user_id", "event_id", "rank")


@query(f"SELECT n_name, total FROM (SELECT n_name, round(sum(l_quantity), 4) AS total FROM {_SHIPPED} WHERE l_returnflag = 'A' AND year = 1997 GROUP BY 1) ORDER BY total DESC, n_name LIMIT 10")
def m1_rank_by_sum(spark, sf_dir):
    return metrics.rank_by_sum(shipped(spark, sf_dir), QUANTITY, year=1997)


@query(f"""WITH s AS (SELECT * FROM {_SHIPPED} WHERE l_returnflag = 'A'), m AS (SELECT max(year) AS newest FROM s)
SELECT year::INT AS year, l_linestatus, round(sum(l_quantity), 4) AS total FROM s, m WHERE year > newest - 5 GROUP BY ALL ORDER BY 1, 2 LIMIT 100""")
def m2_time_series(spark, sf_dir):
    return metrics.time_series(shipped(spark, sf_dir), QUANTITY, grain="l_linestatus", last_years=5)


@query(f"""WITH s AS (SELECT n_name, round(sum(CASE WHEN year = 1998 THEN l_quantity END), 4) AS curr, round(sum(CASE WHEN year = 1997 THEN l_quantity END), 4) AS prev FROM {_SHIPPED} WHERE l_returnflag = 'A' GROUP BY 1)
SELECT n_name, curr, prev, round(curr - prev, 4) AS delta FROM s WHERE curr IS NOT NULL AND prev IS NOT NULL ORDER BY delta DESC, n_name LIMIT 10""")
def m3_yoy_delta(spark, sf_dir):
    return metrics.yoy_delta(shipped(spark, sf_dir), QUANTITY, 1998)


@query(f"""WITH s AS (SELECT n_name, round(sum(l_quantity), 4) AS total FROM {_SHIPPED} WHERE l_returnflag = 'A' GROUP BY 1) SELECT n_name, total, round(total / (SELECT sum(total) FROM s), 6) AS share FROM s ORDER BY total DESC, n_name LIMIT 5""")
def m4_share_of_total(spark, sf_dir):
    return metrics.share_of_total(shipped(spark, sf_dir), QUANTITY, limit=5)


@query(f"""SELECT n_name, year::INT AS year, round(avg(l_extendedprice), 4) AS average FROM {_SHIPPED} WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_7') AND l_linestatus = 'F' AND year = (SELECT max(year) FROM {_SHIPPED} WHERE l_linestatus = 'F') GROUP BY ALL""")
def m5_latest_snapshot(spark, sf_dir):
    table = MetricTable("shipped", geo="n_name", year="year", value="l_extendedprice")
    return metrics.latest_snapshot(shipped(spark, sf_dir), table, "l_linestatus = 'F'", ["NATION_1", "NATION_2", "NATION_7"])


@query(f"SELECT year::INT AS year, l_partkey, l_quantity FROM {_SHIPPED} WHERE n_name = 'NATION_4' AND l_returnflag = 'A' ORDER BY year, l_partkey, l_quantity LIMIT 200")
def m6_entity_series(spark, sf_dir):
    return metrics.entity_series(shipped(spark, sf_dir), QUANTITY, "NATION_4", ["l_partkey", "l_quantity"])


@query(f"SELECT n_name, round(avg(l_extendedprice), 4) AS total FROM {_SHIPPED} GROUP BY 1 ORDER BY total DESC, n_name LIMIT 10")
def m7_price_rank(spark, sf_dir):
    return metrics.rank_by_sum(shipped(spark, sf_dir), MetricTable("prices", geo="n_name", year="year", value="l_extendedprice"), measure="price")


_TREND = f"""SELECT n_name, l_linestatus, round(sum(CASE WHEN year = 1996 THEN l_quantity END), 4) AS prior, round(sum(CASE WHEN year = 1998 THEN l_quantity END), 4) AS value FROM {_SHIPPED} WHERE year IN (1996, 1998) GROUP BY ALL"""
_DIRECTION = "CASE WHEN prior IS NULL OR value IS NULL OR prior = 0 THEN 'unknown' WHEN abs((value - prior) / abs(prior)) <= 0.02 THEN 'stable' WHEN value > prior THEN 'increasing' ELSE 'decreasing' END"


@query(f"SELECT n_name, l_linestatus, prior, value, {_DIRECTION} AS direction, CASE WHEN prior <> 0 THEN round(100 * (value - prior) / abs(prior), 4) END AS pct FROM ({_TREND})")
def m8_bracketing_trend(spark, sf_dir):
    return metrics.bracketing_trend(shipped(spark, sf_dir), QUANTITY, 1997, "l_linestatus", ["n_name"])


@query(f"""WITH d AS (SELECT n_name, list(DISTINCT {_DIRECTION}) FILTER (WHERE {_DIRECTION} <> 'unknown') AS d FROM ({_TREND}) GROUP BY 1)
SELECT n_name, CASE WHEN len(d) = 1 THEN d[1] ELSE 'unknown' END AS direction, coalesce(len(d), 0) > 1 AS mixed FROM d""")
def m9_aligned_direction(spark, sf_dir):
    return metrics.align_directions(metrics.bracketing_trend(shipped(spark, sf_dir), QUANTITY, 1997, "l_linestatus", ["n_name"]), ["n_name"])


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'widget') THEN 'widget' WHEN contains(lower(p_name), 'small') THEN 'small' WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN contains(lower(p_name), 'red') THEN 'red' ELSE 'any' END AS value FROM part""")
def m10_default_discriminator(spark, sf_dir):
    return metrics.default_discriminator(read(spark, sf_dir, "part"), "p_partkey", "p_name", ["red", "ring", "small", "widget"], "any")


@query(f"SELECT n_name, year::INT AS year, l_quantity FROM {_SHIPPED} WHERE year IN (1997, 1999) AND l_returnflag = 'A'")
def m11_broadened_year(spark, sf_dir):
    gap = shipped(spark, sf_dir).where("year <> 1998")
    return metrics.broaden(gap, QUANTITY, 1998).select("n_name", "year", "l_quantity")


@query(f"""WITH t AS (SELECT year, n_name, round(sum(l_quantity), 4) AS total FROM {_SHIPPED} GROUP BY ALL)
SELECT year::INT AS year, count(*) AS n, string_agg(n_name, '|' ORDER BY total DESC, n_name) AS labels, max(total) AS top_value, least(1.0, count(*) / 10)::DOUBLE AS coverage FROM t GROUP BY 1 HAVING count(*) >= 2""")
def m13_consolidated_ranking(spark, sf_dir):
    totals = shipped(spark, sf_dir).groupBy("year", "n_name").agg(F.round(F.sum("l_quantity"), 4).alias("total"))
    return metrics.consolidate(totals, "year", "n_name", "total")


@query("""SELECT s_suppkey, CASE WHEN n_name IS NOT NULL AND n_regionkey = 1 THEN 3 WHEN n_name IS NOT NULL THEN 2 ELSE 1 END AS tier, 'supplier:s_suppkey=' || s_suppkey || ';s_name=' || s_name AS source_id FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def m14_provenance(spark, sf_dir):
    supplier, nation = read(spark, sf_dir, "supplier", "nation")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").withColumn("area", F.when(F.col("n_regionkey") == 1, F.col("n_name")))
    return metrics.provenance(rows, "supplier", ["s_suppkey", "s_name"], "area", "n_name").select("s_suppkey", "tier", "source_id")


@query("""SELECT test, failures FROM (
SELECT 'not_null' AS test, (SELECT count(*) FROM orders WHERE o_orderkey IS NULL OR o_custkey IS NULL) AS failures
UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'accepted_values', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
UNION ALL SELECT 'recency', (SELECT CASE WHEN max(o_orderdate) >= TIMESTAMP '1999-01-01' - INTERVAL 400 DAY THEN 0 ELSE 1 END FROM orders)
UNION ALL SELECT 'no_future_years', (SELECT count(*) FROM orders WHERE year(o_orderdate) > 1998)
UNION ALL SELECT 'not_negative', (SELECT count(*) FROM customer WHERE c_acctbal < 0))""")
def q6_test_runner(spark, sf_dir):
    orders, line, customer = read(spark, sf_dir, "orders", "lineitem", "customer")
    return checks.run(
        checks.not_null(orders, ["o_orderkey", "o_custkey"]), checks.unique(line, ["l_orderkey", "l_linenumber"]), checks.accepted_values(orders, "o_orderstatus", ["F", "O"]),
        checks.recency(orders, "o_orderdate", 400, "1999-01-01"), checks.failing(orders, "year(o_orderdate) > 1998", "no_future_years"), checks.failing(customer, "c_acctbal < 0", "not_negative"),
    )


@query("""SELECT sum(n)::BIGINT AS rows_before, sum(n * greatest(coalesce(m, 1), 1))::BIGINT AS rows_after, sum(CASE WHEN m IS NULL THEN n ELSE 0 END)::BIGINT AS unmatched
FROM (SELECT c_nationkey AS k, count(*)::BIGINT AS n FROM customer GROUP BY 1) LEFT JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS m FROM supplier GROUP BY 1) USING (k)""")
def q7_fanout_report(spark, sf_dir):
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    return metrics.fanout_report(customer.withColumnRenamed("c_nationkey", "k"), supplier.withColumnRenamed("s_nationkey", "k"), ["k"])


@query("""WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) <= 1996 ), n AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) > (SELECT max(y) FROM t))
SELECT o_orderkey, o_custkey, o_totalprice, y::INT AS y FROM t UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, y::INT FROM n""")
def r1_incremental_upsert(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    return star.upsert(orders.where("y <= 1996"), orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"], "y")


@query("""WITH n AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) >= 1996)
SELECT o_orderkey, o_totalprice, y::INT AS y FROM n UNION ALL SELECT o_orderkey, o_totalprice, year(o_orderdate)::INT FROM orders WHERE year(o_orderdate) < 1996""")
def r2_late_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    return star.upsert(orders.where("y <= 1996"), orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"], "y", "late_ok")


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL")
def r6_day_buckets(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("day"), "n")


@query("SELECT DISTINCT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM (SELECT user_id, min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events GROUP BY 1)")
def r7_day_slices(spark, sf_dir):
    spans = read(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    return spans.select("user_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, sid""")
def r9_sessions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("first_ts"), "n")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def s10_as_of_restore(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("ts <= timestamp'2024-01-10 00:00:00'")
    return rows.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
