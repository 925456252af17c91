"""Metric questions over long tables: ranks, series, changes, shares, trends, snapshots, coverage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Measure words that call for a mean.
AVERAGED = r"per capita|rate|index|share|yield|price"


@dataclass
class MetricTable:
    """What a metric table's columns mean. discriminators: columns whose values must never be added up, with a default value each.
    date: the stored date that the year comes from, if there is one; years asked for then reach the scan as a range of it."""

    name: str
    geo: str
    year: str
    value: str
    product: str | None = None
    discriminators: Mapping[str, str] = field(default_factory=dict)
    agg: str | None = None
    date: str | None = None

    def aggregate(self, measure: str = "") -> str:
        """sum or avg: as declared, else by the measure's words."""
        return self.agg or ("avg" if re.search(AVERAGED, f"{measure} {self.value}", re.I) else "sum")


def in_years(df: DataFrame, t: MetricTable, first: int, last: int) -> DataFrame:
    """Rows of the years from first to last."""
    if t.date:
        bound = lambda y: F.lit(f"{y}-01-01").cast(dict(df.dtypes)[t.date])
        df = df.where((F.col(t.date) >= bound(first)) & (F.col(t.date) < bound(last + 1)))
    return df.where(F.col(t.year).between(first, last))


def clamp(limit: int, most: int = 100) -> int:
    return max(1, min(limit, most))


def select_rows(df: DataFrame, t: MetricTable, year: int | tuple[int, int] | None = None, countries: Sequence[str] = (), products: Sequence[str] = (), discriminators: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of one question. A discriminator without a value takes its default; without either the question is refused."""
    chosen = dict(t.discriminators) | dict(discriminators or {})
    if missing := [k for k, v in chosen.items() if not v]:
        raise ValueError(f"values of {missing} would be mixed")
    if year is not None:
        df = in_years(df, t, *(year if isinstance(year, tuple) else (year, year)))
    if countries:
        df = df.where(F.col(t.geo).isin(list(countries)))
    if products and t.product:
        df = df.where(F.col(t.product).isin(list(products)))
    for k, v in chosen.items():
        df = df.where(F.col(k) == v)
    return df


def _total(t: MetricTable, measure: str = "") -> Column:
    value = F.col(t.value).cast("double")
    return F.round(F.avg(value) if t.aggregate(measure) == "avg" else F.sum(value), 4)


def rank_by_sum(df: DataFrame, t: MetricTable, grain: str | None = None, limit: int = 10, measure: str = "", **filters) -> DataFrame:
    """grain, total: the highest totals first, ties by grain."""
    g = grain or t.geo
    rows = select_rows(df, t, **filters).groupBy(g).agg(_total(t, measure).alias("total"))
    return rows.orderBy(F.desc("total"), g).limit(clamp(limit))


def time_series(df: DataFrame, t: MetricTable, grain: str | None = None, limit: int = 100, last_years: int = 10, **filters) -> DataFrame:
    """year, (grain,) total over the last years that have rows."""
    rows = select_rows(df, t, **filters)
    newest = rows.agg(F.max(t.year).alias("_newest"))
    keys = [F.col(t.year).alias("year"), *([F.col(grain)] if grain else [])]
    recent = rows.crossJoin(F.broadcast(newest)).where(F.col(t.year) > F.col("_newest") - last_years)
    return recent.groupBy(*keys).agg(_total(t).alias("total")).orderBy("year", *([grain] if grain else [])).limit(clamp(limit, 200))


def yoy_delta(df: DataFrame, t: MetricTable, year: int, limit: int = 10, **filters) -> DataFrame:
    """geo, curr, prev, delta for grains with rows in both years, in one aggregation."""
    rows = select_rows(df, t, year=(year - 1, year), **filters)
    at = lambda y: F.round(F.sum(F.when(F.col(t.year) == y, F.col(t.value).cast("double"))), 4)
    both = rows.groupBy(t.geo).agg(at(year).alias("curr"), at(year - 1).alias("prev")).where("curr IS NOT NULL AND prev IS NOT NULL")
    return both.withColumn("delta", F.round(F.col("curr") - F.col("prev"), 4)).orderBy(F.desc("delta"), t.geo).limit(clamp(limit))


def share_of_total(df: DataFrame, t: MetricTable, grain: str | None = None, limit: int = 10, **filters) -> DataFrame:
    """grain, total, share; the denominator holds all filtered rows, also those beyond the limit. Only one row per grain meets the total."""
    g = grain or t.geo
    rows = select_rows(df, t, **filters).groupBy(g).agg(F.round(F.sum(F.col(t.value).cast("double")), 4).alias("total"))
    whole = rows.agg(F.sum("total").alias("_all"))
    return rows.crossJoin(F.broadcast(whole)).select(g, "total", F.round(F.try_divide("total", "_all"), 6).alias("share")).orderBy(F.desc("total"), g).limit(clamp(limit))


def latest_snapshot(df: DataFrame, t: MetricTable, scope: str = "true", countries: Sequence[str] = (), year: int | None = None) -> DataFrame:
    """geo, year, average of the newest year of the scope (not of the countries asked for)."""
    rows = df.where(scope)
    newest = rows.agg(F.max(t.year).alias("_newest")) if year is None else None
    if countries:
        rows = rows.where(F.col(t.geo).isin(list(countries)))
    rows = rows.where(F.col(t.year) == year) if newest is None else rows.crossJoin(F.broadcast(newest)).where(F.col(t.year) == F.col("_newest"))
    return rows.groupBy(t.geo, F.col(t.year).alias("year")).agg(F.round(F.avg(F.col(t.value).try_cast("double")), 4).alias("average"))


def entity_series(df: DataFrame, t: MetricTable, country: str, columns: Sequence[str], limit: int = 200, **filters) -> DataFrame:
    """The rows of one country, by year and the chosen columns."""
    return select_rows(df, t, countries=[country], **filters).select(t.year, *columns).orderBy(t.year, *columns).limit(clamp(limit, 200))


def direction(prior: Column, value: Column, band: float = 0.02) -> Column:
    """increasing, decreasing or stable within the band of the prior value; unknown if that is missing or 0."""
    change = (value - prior) / F.abs(prior)
    return F.when(prior.isNull() | value.isNull() | (prior == 0), "unknown").when(F.abs(change) <= band, "stable").when(change > 0, "increasing").otherwise("decreasing")


def bracketing_trend(df: DataFrame, t: MetricTable, year: int, element: str, grain: Sequence[str] = ()) -> DataFrame:
    """grain, element, prior (year - 1), value (year + 1), direction, pct in one aggregation."""
    at = lambda y: F.round(F.sum(F.when(F.col(t.year) == y, F.col(t.value).cast("double"))), 4)
    rows = in_years(df, t, year - 1, year + 1).where(F.col(t.year) != year).groupBy(*grain, element).agg(at(year - 1).alias("prior"), at(year + 1).alias("value"))
    pct = F.when((F.col("prior") != 0) & F.col("value").isNotNull(), F.round(100 * (F.col("value") - F.col("prior")) / F.abs("prior"), 4))
    return rows.select(*grain, element, "prior", "value", direction(F.col("prior"), F.col("value")).alias("direction"), pct.alias("pct"))


def align_directions(trends: DataFrame, grain: Sequence[str]) -> DataFrame:
    """One direction for each grain: that of all its known ones if they agree, else unknown and mixed."""
    known = F.collect_set(F.when(F.col("direction") != "unknown", F.col("direction")))
    rows = trends.groupBy(*grain).agg(known.alias("_d"))
    return rows.select(*grain, F.when(F.size("_d") == 1, F.get("_d", F.lit(0))).otherwise("unknown").alias("direction"), (F.size("_d") > 1).alias("mixed"))


def broaden(df: DataFrame, t: MetricTable, year: int, **filters) -> DataFrame:
    """The rows of a year, or if there are none those of the years around it; the place is never dropped."""
    exact = select_rows(df, t, year=year, **filters)
    return exact if not exact.isEmpty() else select_rows(df, t, year=(year - 1, year + 1), **filters)


def default_discriminator(questions: DataFrame, question_id: str, text: str, samples: Sequence[str], preferred: str) -> DataFrame:
    """question_id, value: the sample whose words a question names (longest first, then by name), else the preferred one."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.filter(F.array(*[F.lit(s) for s in sorted(samples, key=lambda s: (-len(s), s))]), lambda s: F.contains(lower, F.lower(s)))
    return questions.select(question_id, F.coalesce(F.get(hits, F.lit(0)), F.lit(preferred)).alias("value"))


def consolidate(results: DataFrame, query_id: str, label: str, value: str, full: int = 10) -> DataFrame:
    """Queries with two rows or more as one record: ranked labels and values, and coverage = min(1, rows / full)."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("s"), F.col(label).alias("label"), F.col(value).alias("value"))))
    rows = results.groupBy(query_id).agg(F.count("*").alias("n"), ranked.alias("_r")).where("n >= 2")
    return rows.select(query_id, "n", F.array_join(F.transform("_r", lambda x: x["label"].cast("string")), "|").alias("labels"), F.get("_r", F.lit(0))["value"].alias("top_value"), F.least(F.lit(1.0), F.col("n") / full).alias("coverage"))


def provenance(df: DataFrame, name: str, keys: Sequence[str], region: str | None, country: str | None) -> DataFrame:
    """Tier 3 for regional, 2 for national, 1 for other rows, and a source id table:key=value;..."""
    has = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") if c else F.lit(False)
    tier = F.when(has(region), 3).when(has(country), 2).otherwise(1)
    pairs = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]
    return df.withColumns({"tier": tier, "source_id": F.concat(F.lit(f"{name}:"), F.concat_ws(";", *pairs))})


def coverage(rows: DataFrame, keys: Sequence[str], year: str, first: int, last: int) -> DataFrame:
    """Rows for each key and year in range; rows without a year pass."""
    return rows.where(F.col(year).isNull() | F.col(year).between(first, last)).groupBy(*keys, year).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, fields: Sequence[str], by: str | None = None) -> DataFrame:
    """Missing values of each field, count and percent, in one pass."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    rows = df.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), *[F.count_if(blank(c)).alias(f"missing_{c}") for c in fields])
    return rows.withColumns({f"pct_{c}": F.round(100 * F.col(f"missing_{c}") / F.col("n"), 4) for c in fields})


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int | None = None, name: str = "rank") -> DataFrame:
    """Numbered rows of each partition; with n, the first n (Spark limits such windows before the shuffle)."""
    rows = df.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(*order)))
    return rows.where(F.col(name) <= n) if n else rows


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; rows with a null key all stay."""
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    return ranked(df.where(f"NOT ({null})"), keys, order, 1, "_n").drop("_n").unionByName(df.where(null))


def budget_cut(df: DataFrame, partition: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """The rows of each partition whose running size stays within the budget. Sizes are not negative, so the first overflow ends it."""
    running = F.sum(size).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("running", running).where(F.col("running") <= budget)


def fanout_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows_before, rows_after, unmatched of a left join, without running it: counts per key are joined instead."""
    a, b = left.groupBy(*on).agg(F.count("*").alias("l")), right.groupBy(*on).agg(F.count("*").alias("r"))
    j = a.join(b, list(on), "left")
    return j.agg(F.sum("l").alias("rows_before"), F.sum(F.col("l") * F.coalesce("r", F.lit(1))).alias("rows_after"), F.sum(F.when(F.col("r").isNull(), F.col("l")).otherwise(0)).alias("unmatched"))
