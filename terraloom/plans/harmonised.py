"""More warehouse queries: set operations, top-k merges, scalar functions over tables, composed jobs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.functions import text as tx
from terraloom.operators import harmonise, joins, metrics, star
from terraloom.plans.base import query, read
from terraloom.plans.warehouse import _SHIPPED, shipped


@query("SELECT p_partkey AS farm_code, p_size AS pct_c, p_name AS \"order\" FROM part")
def p5_odd_names(spark, sf_dir):
    odd = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("Farm code"), F.col("p_size").alias("%C"), F.col("p_name").alias("order"))
    return harmonise.rename_and_cast(odd, {"farm_code": ("Farm code", "bigint"), "pct_c": ("%C", "int"), "order": ("order", "string")})


@query("SELECT p_type, p_brand, md5(p_type || '|' || p_brand) AS breed_key FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def k11_distinct_dimension(spark, sf_dir):
    return star.dimension(read(spark, sf_dir, "part"), "breed_key", ["p_type", "p_brand"], scd=False)


@query("""SELECT md5(event_id::VARCHAR || '|' || event_type) AS reading_key, md5(user_id::VARCHAR) AS sensor_key, substring(coalesce(strftime(ts, '%Y-%m-%d'), '2000'), 1, 4) AS year, value::DOUBLE AS value FROM events WHERE event_type = 'click'""")
def k12_source_fact(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("year", F.substring(F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("2000")), 1, 4))
    spec = star.FactSpec("reading", ["event_id", "event_type"], {"sensor_key": ["user_id"]}, {"value": "value"}, "event_type = 'click'", ["year"])
    return star.fact(rows, spec).withColumn("value", F.col("value").cast("double"))


@query(f"WITH t AS (SELECT n_name, round(sum(l_quantity), 4) AS total FROM {_SHIPPED} GROUP BY 1) SELECT n_name, total, round(total - (SELECT avg(total) FROM t), 4) AS above FROM t")
def j6_one_row_total(spark, sf_dir):
    t = shipped(spark, sf_dir).groupBy("n_name").agg(F.round(F.sum("l_quantity"), 4).alias("total"))
    return t.crossJoin(F.broadcast(t.agg(F.avg("total").alias("_mean")))).select("n_name", "total", F.round(F.col("total") - F.col("_mean"), 4).alias("above"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')")
def j7_literal_semi_join(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")).select("c_custkey", "c_mktsegment")


@query("""SELECT p_type, year(l_shipdate)::INT AS year, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def a2_annual_summary(spark, sf_dir):
    line, part = read(spark, sf_dir, "lineitem", "part")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy("p_type", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def a5_distinct_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct()


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS price, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
def a7_measure_semantics(spark, sf_dir):
    how = lambda c, measure: F.round(F.avg(c), 4) if metrics.MetricTable("part", "p_brand", "y", c).aggregate(measure) == "avg" else F.sum(c)
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(how("p_retailprice", "retail price").alias("price"), how("p_size", "size").alias("size"))


@query("SELECT conv_id, turn, n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n FROM conversations) WHERE n <= 2")
def w4_chunk_cap(spark, sf_dir):
    return metrics.ranked(read(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], [F.col("turn")], 2, "n")


@query("SELECT event_type, n, round(n / (SELECT count(*) FROM events), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def w8_ratio_to_total(spark, sf_dir):
    t = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("_all")))).select("event_type", "n", F.round(F.try_divide("n", "_all"), 6).alias("share"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def w10_first_seen(spark, sf_dir):
    return metrics.first_per_key(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def t1_clamped_top_k(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(metrics.clamp(5000))


@query("""WITH u AS (SELECT user_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, value * 1.5 FROM events WHERE event_type = 'view')
SELECT user_id, max(value) AS best FROM u GROUP BY 1 ORDER BY best DESC, user_id LIMIT 20""")
def t3_merged_lists(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    lists = events.where("event_type = 'click'").select("user_id", "value").unionByName(events.where("event_type = 'view'").select("user_id", (F.col("value") * 1.5).alias("value")))
    return lists.groupBy("user_id").agg(F.max("value").alias("best")).orderBy(F.desc("best"), "user_id").limit(20)


@query("""WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n, count(DISTINCT event_type) OVER () AS k FROM events)
SELECT event_type, event_id, value FROM r WHERE n <= greatest(3, ceil(20 / k)) ORDER BY value DESC, event_id LIMIT 20""")
def t4_balanced_fetch(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    groups = events.agg(F.count_distinct("event_type").alias("_k"))
    rows = metrics.ranked(events.select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")], 20, "_n").crossJoin(F.broadcast(groups))
    return rows.where(F.col("_n") <= F.greatest(F.lit(3), F.ceil(20 / F.col("_k")))).select("event_type", "event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("SELECT 'customer' AS _raw_table, c_nationkey AS nation_key, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, NULL FROM supplier")
def u2_tagged_union(spark, sf_dir):
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    return harmonise.union_tagged({"customer": customer.select(F.col("c_nationkey").alias("nation_key"), F.col("c_mktsegment").alias("segment")), "supplier": supplier.select(F.col("s_nationkey").alias("nation_key"))})


@query("SELECT c_nationkey AS nation_key FROM customer UNION SELECT s_nationkey FROM supplier")
def u3_union_distinct(spark, sf_dir):
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    return customer.select(F.col("c_nationkey").alias("nation_key")).unionByName(supplier.select(F.col("s_nationkey").alias("nation_key"))).distinct()


@query("SELECT event_id, TRY_CAST(event_type AS BIGINT) AS broken, TRY_CAST(substring(props, 7, 2) AS BIGINT) AS k, CASE WHEN value = 0 THEN NULL ELSE round(100 / value, 6) END AS ratio FROM events")
def f3_safe_cast_and_divide(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.col("event_type").try_cast("bigint").alias("broken"), F.substring("props", 7, 2).try_cast("bigint").alias("k"), F.round(F.try_divide(F.lit(100.0), "value"), 6).alias("ratio"))


@query("SELECT r_name, n_name, coalesce(alias, n_name) AS name FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (VALUES ('NATION_1', 'Ivory Coast'), ('NATION_2', 'Tanzania')) v(code, alias) ON code = n_name WHERE r_name IN ('AFRICA', 'ASIA')")
def f17_zone_members(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region", "nation")
    aliases = spark.createDataFrame([("NATION_1", "Ivory Coast"), ("NATION_2", "Tanzania")], "code string, alias string")
    members = region.where(F.col("r_name").isin("AFRICA", "ASIA")).join(nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return members.join(F.broadcast(aliases), F.col("code") == F.col("n_name"), "left").select("r_name", "n_name", F.coalesce("alias", "n_name").alias("name"))


@query(f"SELECT rank || '. ' || n_name || ': ' || total::BIGINT AS line FROM (SELECT n_name, round(sum(l_quantity), 4) AS total, row_number() OVER (ORDER BY round(sum(l_quantity), 4) DESC, n_name) AS rank FROM {_SHIPPED} GROUP BY 1)")
def f18_ranked_lines(spark, sf_dir):
    totals = shipped(spark, sf_dir).groupBy("n_name").agg(F.round(F.sum("l_quantity"), 4).alias("total"))
    rows = totals.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), "n_name")))  # one row per nation
    return rows.select(F.concat(F.col("rank").cast("string"), F.lit(". "), "n_name", F.lit(": "), F.col("total").cast("bigint").cast("string")).alias("line"))


@query("""WITH p AS (SELECT vec_id, degrees((embedding[1] * 1e7) / 6378137.0) AS lon, degrees(atan(sinh((embedding[2] * 1e7) / 6378137.0))) AS lat, label FROM embeddings),
g AS (SELECT round(lat, 0) + 0 AS lat, round(lon, 0) + 0 AS lon, count(*) AS n, round(avg(label), 6) AS mean FROM p WHERE vec_id % 2 = 0 GROUP BY 1, 2),
h AS (SELECT round(lat, 0) + 0 AS lat, round(lon, 0) + 0 AS lon, count(*) AS m FROM p WHERE vec_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(g.lat, h.lat) AS lat, coalesce(g.lon, h.lon) AS lon, n, mean, m FROM g FULL JOIN h ON g.lat = h.lat AND g.lon = h.lon""")
def m16_soil_grid(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 1e7
    lon, lat = tx.mercator_to_wgs84(at(0), at(1))
    points = read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.round(lon, 0) + 0.0).alias("lon"), (F.round(lat, 0) + 0.0).alias("lat"))
    one = points.where("vec_id % 2 = 0").groupBy("lat", "lon").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("mean"))
    return joins.grid_full_join(one, points.where("vec_id % 2 = 1").groupBy("lat", "lon").agg(F.count("*").alias("m")), 0)
