"""Quality rules with risk-controlled thresholds (operator 10, DataFrame functions only).

Base rules look at each text alone. On top of them, each rule metric gets a cutoff per stratum
(language), chosen on labelled documents: a cutoff is valid when the exact binomial tail shows, at a
confidence shared out over all strata, rules and cutoffs (Bonferroni), that it rejects at most its part
of `risk` of the good documents. The strictest valid cutoff is applied; a stratum without enough labels
gets none, and then the base rules decide alone.

Defined cases: a null or empty text has no words and fails the base rules; a null stratum is a stratum
of its own; labels that are null, or of unknown documents, count for nothing; repeated labels of a
document count once (the worst wins); repeated rows are judged one by one; a very long text is one row; scores at a cutoff
pass; extra columns of any name pass through `filter_documents` and are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import GAP, cut, small, stage, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Rule metric -> cutoffs tried, from lenient to strict; a document is rejected above the cutoff.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_share": [0.29, 0.25, 0.2, 0.15, 0.1, 0.05],
    "word_length": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0],
    "shortness": [1 / 2, 1 / 2.5, 1 / 3, 1 / 3.5, 1 / 4],
}


def with_metrics(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, each under `prefix`.

    The row is carried as one struct through the steps, so no column of the input can clash with them.
    """
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    a = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    b = a.select(
        "row",
        F.filter(F.split(text, GAP), lambda x: x != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    c = b.select(
        "row",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("h"),
    )
    d = c.withColumn(
        "win",
        F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    ).drop("h")
    # Equal windows are neighbours once sorted; only texts that have any are sorted.
    e = d.withColumn(
        "s",
        F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("win")
    near = lambda x, j: F.coalesce(F.get("s", j).getField("h") == x.getField("h"), F.lit(False))
    f = e.withColumn("p", F.array_sort(F.transform(F.filter("s", lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x.getField("i")))).drop("s")
    covered = F.when(
        F.size("p") > 1,
        F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), F.lit(WINDOW).cast("long"), lambda acc, j: acc + F.least(F.lit(WINDOW), F.get("p", j) - F.get("p", j - 1)).cast("long")),
    ).otherwise(F.lit(0).cast("long"))
    g = f.withColumn("n_repeat_words", covered).drop("p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    names = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return g.select("row.*", *[F.col(n).alias(prefix + n) for n in names], failed.alias(prefix + "base_failed"))


def _scores(prefix: str = "") -> dict[str, F.Column]:
    col = lambda n: F.col(prefix + n).cast("double")
    share = lambda a, b: F.when(col(b) > 0, col(a) / col(b)).otherwise(0.0)
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "shortness": share("n_words", "word_chars"),
    }


def _log_gamma(x: F.Column) -> F.Column:
    """ln gamma for x >= 1 by Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    back = F.log(x)
    for i in range(1, 8):
        back = back + F.log(x + float(i))
    return series - back


def binomial_tail(k: F.Column, n: F.Column, p: F.Column, terms: int = 5000) -> F.Column:
    """P(Bin(n, p) <= k) for k < n p, from the top term downwards; 1 where k >= n p (no evidence).

    Each term is the one above it times a ratio below 1 that keeps falling, so `terms` of them hold the
    sum to double precision for n up to about 10^7, and the geometric rest is added as an upper bound.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(p) + (n - k) * F.log(1 - p))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc, j):
        at = k - j + 1
        term = acc["term"] * at / (n - at + 1) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    last = F.least(k, F.lit(float(terms))).cast("int")
    run = F.when(last >= 1, F.aggregate(F.sequence(F.lit(1), last), start, step)).otherwise(start)
    rest = F.when(k > terms, run["term"] * terms).otherwise(0.0)
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), top * (run["sum"] + rest)))


def calibrate(metrics: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", risk: float = 0.02, delta: float = 0.05, rules: dict[str, list[float]] | None = None) -> DataFrame:
    """One row per stratum: `stratum` and the strictest valid cutoff of each rule (null: none is valid).

    All labelled documents that pass the base rules take part. Counts per stratum come from one
    aggregation with map-side partial sums; what is left is strata x rules x cutoffs rows.
    """
    rules = rules or RULES
    good = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1").select("_id")
    held = metrics.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_id"), "left_semi")
    scores = _scores()
    hits = [F.count_if(scores[r] > c).alias(f"{r}#{i}") for r, cs in rules.items() for i, c in enumerate(cs)]
    counts = cut(held.groupBy(F.col(stratum_col).alias("stratum")).agg(F.count("*").alias("n"), *hits))
    tests = max(1, counts.count()) * sum(map(len, rules.values()))
    share = risk / len(rules)
    long = counts.select(
        "stratum",
        "n",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"`{r}#{i}`").alias("k")) for r, cs in rules.items() for i, c in enumerate(cs)])).alias("t"),
    ).select("stratum", "n", "t.*")
    valid = long.where(binomial_tail(F.col("k"), F.col("n"), F.lit(share)) <= delta / tests)
    return cut(valid.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules]))


def with_verdict(df: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang", prefix: str = "", rules: dict[str, list[float]] | None = None) -> DataFrame:
    """Add `{prefix}kept`. The cutoffs are a row per stratum; up to 10,000 of them are broadcast, so texts are not dealt by stratum."""
    rules = rules or RULES
    scores = _scores(prefix)
    named = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(f"cut_{r}").alias(f"_cut_{r}") for r in rules])
    joined = df.join(small(named, 10_000), F.col(stratum_col).eqNullSafe(F.col("_stratum")), "left")
    above = F.lit(False)
    for r in rules:
        above = above | F.coalesce(scores[r] > F.col(f"_cut_{r}"), F.lit(False))
    return joined.withColumn(f"{prefix}kept", ~(F.col(f"{prefix}base_failed") | above)).drop(*named.columns)


def score(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for every row of docs. Texts are read once."""
    slim = docs.select("doc_id", F.col(stratum_col).alias("lang"), "text")
    metrics = stage(with_metrics(slim).drop("text"), "quality")
    out = with_verdict(metrics, calibrate(metrics, labels, risk=risk, delta=delta))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with their columns. The counts are computed again in the second pass rather than joined back, so no text is shuffled."""
    slim = docs.select("doc_id", F.col(stratum_col).alias("lang"), "text")
    metrics = stage(with_metrics(slim).drop("text"), "quality")
    cutoffs = calibrate(metrics, labels, risk=risk, delta=delta)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(stratum_col).alias("lang"), "text")
    judged = with_verdict(with_metrics(whole, prefix="_q_"), cutoffs, prefix="_q_")
    # An explode rather than a filter: Catalyst would push a filter below the steps and repeat them inside it.
    return judged.select(F.explode(F.when(F.col("_q_kept"), F.array("whole"))).alias("row")).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
