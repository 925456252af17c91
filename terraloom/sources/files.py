"""Readers and writers of chunk records, articles, lane records and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

CHUNK = "id string, text string, metadata map<string,string>, _corrupt_record string"


def read_layer(spark: SparkSession, root: str, layer: str, table: str, schema: StructType | str | None = None) -> DataFrame:
    """A named table of a layer's folder; with a schema, nothing is inferred."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root.rstrip('/')}/{layer}/{table}")


def extract_partition(df: DataFrame, where: str, path: str, order: Sequence[str] = (), limit: int | None = None) -> None:
    """A filtered copy, capped if asked for, in place of what is at path."""
    rows = df.where(where)
    rows = rows.orderBy(*order) if order else rows
    (rows.limit(limit) if limit else rows).write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of JSON lines. Broken lines, empty ids or texts and metadata that is no object are left out."""
    rows = spark.read.schema(CHUNK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = F.col("_corrupt_record").isNull() & (F.trim("id") != "") & (F.trim("text") != "") & F.col("metadata").isNotNull()
    return rows.where(good).drop("_corrupt_record")


def write_chunks(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_articles(df: DataFrame, path: str, country: str, published: str) -> None:
    """Articles in folders by country slug and year of publication; missing ones go to `unknown`."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(country), F.lit("unknown"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    year = F.coalesce(F.substring(F.col(published).cast("string"), 1, 4), F.lit("unknown"))
    df.withColumns({"country_slug": F.when(slug == "", "unknown").otherwise(slug), "pub_year": year}).write.mode("overwrite").partitionBy("country_slug", "pub_year").parquet(path)


def read_front_matter(spark: SparkSession, path: str, fields: Sequence[str], root: str = "") -> DataFrame:
    """Texts with a header between two `---` lines: path, the header's fields and body. A missing country is the first folder below root."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    head = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    header, body = F.regexp_extract("value", head, 1), F.regexp_extract("value", head, 2)
    value = lambda k: F.regexp_extract(header, rf"(?m)^{k}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    out = files.select("path", *[F.when(value(k) != "", value(k)).alias(k) for k in fields], F.when(F.col("value").rlike(head), body).otherwise(F.col("value")).alias("body"))
    if "country" in fields and root:
        folder = F.regexp_extract("path", rf"{root.rstrip('/')}/([^/]+)/", 1)
        out = out.withColumn("country", F.coalesce("country", F.when(folder != "", folder)))
    return out


def read_lanes(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """JSON records whose fields go by several names: the first that is set counts."""
    names = sorted({a for group in aliases.values() for a in group})
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).json(path)
    return rows.select(*[F.coalesce(*[F.col(f"`{a}`") for a in group]).alias(name) for name, group in aliases.items()])


def payload(df: DataFrame, allowed: Sequence[str], most: int = 1000) -> DataFrame:
    """The allowed columns that exist; arrays, maps and structs as JSON of at most `most` characters."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    flat = lambda c: F.substring(F.to_json(F.col(c)), 1, most) if isinstance(kinds[c], (ArrayType, MapType, StructType)) else F.col(c)
    return df.select(*[flat(c).alias(c) for c in allowed if c in kinds])


def write_csv(df: DataFrame, path: str, rank_by: str | None = None) -> None:
    """Rows with a header line, in rank order if one is given."""
    (df.orderBy(rank_by) if rank_by else df).write.mode("overwrite").option("header", True).csv(path)


def route(df: DataFrame, kind: str, targets: Mapping[str, str], path: str, default: str = "other") -> None:
    """Rows in a folder for each target of their kind; a rerun replaces them."""
    target = F.lit(default)
    for k, t in targets.items():
        target = F.when(F.col(kind) == k, t).otherwise(target)
    df.withColumn("target", target).write.mode("overwrite").partitionBy("target").parquet(path)


def as_of(log: DataFrame, key: Sequence[str], loaded: str, moment: str) -> DataFrame:
    """The newest row of each key in an append-only log at a moment; of equally new ones the greatest by the other columns in order."""
    seen = log.where(F.col(loaded) <= F.lit(moment).cast("timestamp"))
    values = [c for c in log.columns if c not in key]
    return seen.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(loaded, *values)).alias("_row")).select(*key, "_row.*")


def catalogue(spark: SparkSession, database: str | None = None) -> DataFrame:
    """A row for each column of each table that the session's catalogue knows."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")


def rebuild(df: DataFrame, path: str, parts: Sequence[str], id_col: str) -> None:
    """Replace the rows of df's ids in a folder partitioned by `parts`; all other rows stay, and a rerun, also after a failure midway, gives the same folder.

    Only partitions that df belongs to, or that hold an old row of one of its ids, are rewritten (dynamic partition overwrite). What they will hold is written to the
    shared folder of checkpoints first, as a job cannot read what it overwrites; each partition is replaced by files that hold it whole, so a run that fails between two
    of them leaves old ones that the next run finds again.
    """
    spark = df.sparkSession
    from terraloom.operators.state import cut

    new = cut(df)
    try:
        old = spark.read.schema(df.schema).parquet(path)
        old.limit(1).count()
    except AnalysisException:
        new.write.mode("overwrite").partitionBy(*parts).parquet(path)
        return
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in parts])
    ids = new.select(id_col).distinct()
    moved = old.join(ids, id_col, "left_semi").select(*parts).distinct()
    touched = new.select(*parts).distinct().unionByName(moved).distinct()
    kept = old.alias("a").join(touched.alias("b"), same("a", "b"), "left_semi").join(ids, id_col, "left_anti")
    whole = cut(kept.select(*df.columns).unionByName(new))
    # A partition that loses its last row is removed from the listing by hand, for the writer only replaces what it has rows for.
    gone = touched.alias("a").join(whole.select(*parts).distinct().alias("b"), same("a", "b"), "left_anti").collect()
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs
    for row in gone:
        at = "/".join(f"{c}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(row[c])) if row[c] is not None else '__HIVE_DEFAULT_PARTITION__'}" for c in parts)
        target = fs.Path(f"{path}/{at}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
