"""Aligning differently shaped tables to one contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rename_and_cast(df: DataFrame, mapping: Mapping[str, tuple[str, str]], source_key: Sequence[str] = (), loaded_at: bool = False) -> DataFrame:
    """Columns {new: (old, type)}, a natural key of the source columns joined by '|', and on request the load time."""
    out = [F.col(f"`{old}`").try_cast(kind).alias(new) for new, (old, kind) in mapping.items()]
    if source_key:
        out.append(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in source_key]).alias("source_natural_key"))
    if loaded_at:
        out.append(F.current_timestamp().alias("loaded_at"))
    return df.select(*out)


def align(df: DataFrame, contract: StructType, columns: Mapping[str, str | Column] | None = None) -> DataFrame:
    """df in the shape of a contract: named expressions where given, else columns of the same name, else typed nulls."""
    columns = columns or {}
    out = []
    for f in contract.fields:
        given = columns.get(f.name, f.name if f.name in df.columns else None)
        value = F.lit(None) if given is None else F.col(given) if isinstance(given, str) else given
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def union_harmonise(contract: StructType, *sources: tuple[DataFrame, Mapping[str, str | Column]]) -> DataFrame:
    """UNION ALL of sources, each aligned to the contract."""
    return reduce(DataFrame.unionByName, [align(df, contract, columns) for df, columns in sources])


def union_tagged(tables: Mapping[str, DataFrame], tag: str = "_raw_table") -> DataFrame:
    """UNION ALL by name with the table's name in a column; missing columns are null."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in at least one of the columns."""
    return df.dropna(how="all", subset=list(columns))


def keyword_family(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Distinct rows whose column holds one of the words, case-insensitively."""
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(column)).contains(w.lower()) for w in words])
    return df.where(hit).distinct()


def case_map(column: Column, cases: Sequence[tuple[str, object]], default: object) -> Column:
    """The value of the first pattern (a regular expression) that the lower-cased column matches."""
    out, text = None, F.lower(column)
    for pattern, value in cases:
        out = F.when(text.rlike(pattern), F.lit(value)) if out is None else out.when(text.rlike(pattern), F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def allow_list(df: DataFrame, column: str, names: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Rows whose trimmed, lower-cased name is in the one-column table names, after aliases."""
    key = F.trim(F.lower(F.col(column)))
    for bad, good in (aliases or {}).items():
        key = F.when(key == bad, F.lit(good)).otherwise(key)
    allowed = names.select(F.trim(F.lower(F.col(names.columns[0]))).alias("_allowed")).distinct()
    return df.join(allowed, key == F.col("_allowed"), "left_semi")


def clean_list(column: Column, separator: str = ";") -> Column:
    """Trimmed, non-empty entries of a separated list, the first of entries equal but for case."""
    parts = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(parts, F.lower)
    return F.filter(parts, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def unpivot_metrics(df: DataFrame, keys: Sequence[str], measures: Sequence[str], element: str = "element", value: str = "metric_value") -> DataFrame:
    """A row for each measure: the keys, the measure's name and its value as a double."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(list(keys), list(measures), element, value)


def stub(spark: SparkSession, contract: StructType) -> DataFrame:
    """An empty table of the contract."""
    return spark.createDataFrame([], contract)


def usable(df: DataFrame, text: str, status: str | None = None, bad_status: Sequence[str] = ("error",), markers: Sequence[str] = ()) -> DataFrame:
    """Rows that have text, no bad status and no failure marker in the text."""
    keep = F.col(text).isNotNull() & (F.trim(F.col(text).cast("string")) != "")
    if status:
        keep &= ~F.coalesce(F.col(status).isin(list(bad_status)), F.lit(False))
    for m in markers:
        keep &= ~F.lower(F.col(text).cast("string")).contains(m.lower())
    return df.where(keep)
