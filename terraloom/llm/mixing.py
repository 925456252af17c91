"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 1, DataFrame functions only).

Every document gets the exponential key -ln(u) / quality, u a hash of its id. A source whose target is
e whole times its words and a rest takes every document e times (complete epochs), then documents in
key order until the prefix sum of words fills the rest; the document at the edge is taken in part, so a
source's words are its target rounded down.

No source is gathered anywhere for its prefix sum. Keys fall into fixed-width buckets of their
distribution; bucket sums are aggregated with map-side partials, and a running sum over the bounded
number of buckets of a source finds the one bucket where the budget ends. Only that bucket is sorted.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; sources
whose words are 0 get target 0; null, non-positive and missing quality weights count as 1; rows with
equal keys (repeated ids) are ordered by size and then arbitrarily, which changes no sum; an empty table
gives an empty result; a very long text counts whole, and at the edge its first words are taken. Extra columns are not read, and
pass through `mixed_documents` under any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.common import GAP, cut, table, word_count

BUCKETS = 4096
MAX_EPOCHS = 3


def targets(sizes: DataFrame, weights: list[float], cap: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows (source, source_size): weights repeat over the sources by code point.

    The words of all sources are shared by weight; a share above cap x source_size stops there and the excess goes
    to the others by weight, until none is above. In order of cap x size / weight the capped sources come
    first, so one running sum decides it. Rows are sources, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    a = ranked.withColumn("_cap", cap * F.col("source_size").cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
    line = W.orderBy("_r", F.col("source").asc_nulls_last())
    before = line.rowsBetween(W.unboundedPreceding, -1)
    after = line.rowsBetween(W.currentRow, W.unboundedFollowing)
    b = a.select(
        "*",
        F.sum(F.col("source_size").cast("double")).over(every).alias("_all"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_capped"),
        F.sum("_w").over(after).alias("_left"),
        F.row_number().over(line).alias("_n"),
    )
    # The level that the sources from here on would get a unit of weight, if all before are capped.
    c = b.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
    d = c.withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_n", "_level"))).over(every).getField("_level"))
    share = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return d.select("source", "source_size", share.alias("target"))


def uniform(key: F.Column) -> F.Column:
    """A number in (0, 1) with 52 bits from the MD5 of a column's string form (null: the empty string)."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: list[float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of docs.

    quality has rows (doc_id, weight), unique by doc_id; a document's keys are scaled by it.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    if quality is not None:
        base = base.join(quality.select(F.col("doc_id").alias("_id"), F.col("weight").cast("double").alias("_q")), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        base = base.withColumn("_q", F.lit(None).cast("double"))
    q = F.when(F.col("_q") > 0, F.col("_q")).otherwise(1.0)
    key = -F.log(uniform(F.col("doc_id"))) / q
    base = cut(base.select("doc_id", "source", "size", key.alias("_key")).withColumn("_bucket", F.floor(BUCKETS * (1 - F.exp(-F.col("_key")))).cast("int")))

    buckets = cut(base.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")))
    goal = cut(targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights or [1.0, 2.0, 3.0]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = goal.withColumn("_epochs", epochs).withColumn("_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    line = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(line), F.lit(0)))
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_rest")
    edge = (
        sums.join(p, F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("_s", "source_size", "target", "_epochs", "_rest")
        .agg(F.max(F.when((F.col("_before") < F.col("_rest")) & (F.col("_words") > 0), F.struct("_bucket", "_before"))).alias("_edge"))
        .select("_s", "source_size", "target", "_epochs", "_rest", F.col("_edge._bucket").alias("_at"), (F.col("_rest") - F.col("_edge._before")).alias("_room"))
    )
    joined = base.join(cut(edge), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    whole = F.col("_epochs") * F.col("size")
    out = ("doc_id", "size", "source", "source_size", "target")
    sure = joined.where(F.col("_at").isNull() | (F.col("_bucket") != F.col("_at"))).select(*out, (whole + F.when(F.col("_bucket") < F.col("_at"), F.col("size")).otherwise(0)).alias("taken"))
    inside = W.partitionBy("source").orderBy("_key", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    split = joined.where(F.col("_bucket") == F.col("_at")).withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_room") - F.col("_run")))
    return sure.unionByName(split.select(*out, (whole + part).cast("long").alias("taken")))


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for labelled good quality, 0.5 for bad; the worst label of a document counts."""
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.when(F.min("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, weights: list[float] | None = None) -> DataFrame:
    """The mix as rows of docs: a row for each complete epoch a document is in, and one cut to its first words for a part.

    Documents of which nothing is taken go. Ids must be unique here: the plan is joined back by doc_id.
    A part is its first words joined by single spaces, and n_chars, if there is one, follows the text.
    """
    plan = mix(docs, quality, weights).where("taken > 0").select(F.col("doc_id").alias("id"), "size", "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(plan, F.col("row.doc_id").eqNullSafe(F.col("id")))
    each = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy")
    rows = rows.select("row", "size", "taken", each).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    head = F.array_join(F.slice(F.filter(F.split("row.text", GAP), lambda x: x != ""), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH q AS (
  SELECT doc_id AS q_id, CASE WHEN min(quality) = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w
  FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / coalesce(w, 1.0::DOUBLE) AS k
  FROM documents LEFT JOIN q ON doc_id = q_id),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY ratio, source NULLS LAST) AS n
  FROM r),
t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, n) FROM l WHERE level <= ratio) * w), cap)::DOUBLE AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT doc_id, size, source_size, target, epochs, floor(target - epochs * source_size)::BIGINT AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - run)))::BIGINT AS taken FROM p
"""
