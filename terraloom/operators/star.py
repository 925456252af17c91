"""Star schema: hashed keys, dimensions, facts, incremental upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terraloom.operators.harmonise import align


def surrogate_key(*columns: str | Column, sep: str = "|") -> Column:
    """MD5 of the columns' text joined by sep; nulls count as empty, so no key is null. Format doubles before: their text form varies."""
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat(*[x for t in texts for x in (F.lit(sep), t)][1:]))


def dimension(df: DataFrame, key: str, natural: Sequence[str], attributes: Sequence[str] = (), scd: bool = True) -> DataFrame:
    """Distinct natural columns and attributes with their key and current-version columns."""
    out = df.select(*natural, *attributes).distinct().withColumn(key, surrogate_key(*natural))
    if scd:
        out = out.withColumns({"valid_from": F.to_date(F.lit("2000-01-01")), "valid_to": F.lit(None).cast("date"), "is_current": F.lit(True)})
    return out


@dataclass
class FactSpec:
    """grain: columns of the fact's own key. keys: foreign key name -> natural columns. measures: name -> column."""

    name: str
    grain: Sequence[str]
    keys: Mapping[str, Sequence[str]]
    measures: Mapping[str, str]
    where: str = "true"
    carry: Sequence[str] = field(default_factory=tuple)


def fact(df: DataFrame, spec: FactSpec) -> DataFrame:
    """The fact's key, foreign keys, carried columns and DECIMAL(38,9) measures, from the rows that spec.where keeps."""
    return df.where(spec.where).select(
        surrogate_key(*spec.grain).alias(f"{spec.name}_key"),
        *[surrogate_key(*cols).alias(k) for k, cols in spec.keys.items()],
        *spec.carry,
        *[F.col(c).cast("decimal(38,9)").alias(m) for m, c in spec.measures.items()],
    )


def time_dimension(dates: DataFrame, column: str, fiscal_start: int = 7) -> DataFrame:
    """A row per distinct date. Weeks count from the first Sunday (0 before it); fiscal years are named by their end."""
    d = F.col("date")
    week = F.floor((F.dayofyear(d) + 6 - (F.dayofweek(d) - 1)) / 7)
    return dates.select(F.to_date(column).alias("date")).where(d.isNotNull()).distinct().select(
        surrogate_key(F.date_format(d, "yyyy-MM-dd")).alias("time_key"), "date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), F.dayofweek(d).alias("day_of_week"), week.cast("int").alias("week"), F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        (F.year(d) + F.when(F.month(d) >= fiscal_start, 1).otherwise(0)).alias("fiscal_year"),
    )


def seed(spark: SparkSession, rows: Sequence[tuple], schema: str, key: str, natural: Sequence[str]) -> DataFrame:
    """A dimension of fixed rows."""
    return dimension(spark.createDataFrame(list(rows), schema), key, natural, [c for c in spark.createDataFrame([], schema).columns if c not in natural], scd=False)


def facade(df: DataFrame, contract: StructType, renamed: Mapping[str, str]) -> DataFrame:
    """An existing table under a full contract: renamed columns, typed nulls for the rest."""
    return align(df, contract, renamed)


def audit_row(spark: SparkSession, tag: str) -> DataFrame:
    """One row with a run key from the time and a tag."""
    now = F.current_timestamp()
    return spark.range(1).select(F.md5(F.concat_ws("|", now.cast("string"), F.lit(tag))).alias("audit_key"), now.alias("run_at"), F.lit(tag).alias("tag"))


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str], period: str, mode: str = "reference", lag: int = 0) -> DataFrame:
    """target after merging the rows of new beyond its highest period, new rows winning on key.

    mode "reference": strictly beyond it, so late rows of the last period never arrive; "late_ok": from `lag` periods
    before it. An empty or all-null target takes everything. The high-water mark is read first, as one value, so that it reaches the scan of
    new as a literal. Of new rows with one key, the last period's stays, and of those the greatest by the other columns in order.
    """
    mark = target.agg(F.max(period)).first()[0]
    beyond = F.lit(True)
    if mark is not None:
        mark = F.lit(mark).cast(target.schema[period].dataType)
        beyond = F.col(period) > mark if mode == "reference" else F.col(period) >= mark - lag
    rest = [c for c in new.columns if c not in key]
    picked = new.where(beyond).groupBy(*key).agg(F.max(F.struct(period, *[c for c in rest if c != period])).alias("_row"))
    fresh = picked.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in new.columns])
    return target.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh)
