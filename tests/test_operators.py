import random
import tracemalloc
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from terraloom.functions import text as tx
from terraloom.operators import checks, corpus, harmonise, joins, metrics, retrieval, star
from terraloom.operators.metrics import MetricTable
from terraloom.plans import registry


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


@pytest.mark.parametrize(
    ("text", "direction", "magnitude", "unit"),
    [
        ("Maize yields declined by 12% YoY in Kenya's Rift Valley.", "decreasing", -12.0, "pct_yoy"),
        ("Rice production increased 8.5% this season across Senegal.", "increasing", 8.5, "pct"),
        ("Market prices remained stable through the quarter.", "stable", None, None),
        ("National cereal output changed by -5% year-on-year.", "decreasing", -5.0, "pct_yoy"),
        ("The workshop convened stakeholders from several ministries.", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_claims(spark, text, direction, magnitude, unit):
    assert one(spark, **corpus.claims(F.lit(text).cast("string"))) == {"direction": direction, "magnitude": magnitude, "unit": unit}


def test_claims_query_reads_whole_texts(spark, tmp_path):
    long = "Some words on the harvest and its storage come first. " * 20
    rows = [(1, f"{long}Yields increased by 8.5% year-on-year."), (2, long), (3, None), (4, f"{long}\nPrices fell.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.direction, r.magnitude, r.unit) for r in registry.queries()["c17_claims"](spark, str(tmp_path)).collect()}
    assert out == {1: ("increasing", 8.5, "pct_yoy"), 2: (None, None, None), 3: (None, None, None), 4: ("decreasing", None, None)}


@pytest.mark.parametrize(
    ("text", "date"),
    [("2025-01-15", "2025-01-15"), ("2025-01-15T12:30:00Z", "2025-01-15"), ("2025-03", "2025-03-01"), ("2024", "2024-01-01"), ("Fri, 25 Sep 2024 12:00:00 GMT", "2024-09-25"), ("Fri, 25 Se", None), ("not a date", None), ("on 2023-02-03, late", "2023-02-03"), ("2023-02-31", None), (None, None)],
)
def test_iso_date(spark, text, date):
    assert one(spark, d=tx.iso_date(F.lit(text).cast("string")))["d"] == date


def test_text_functions(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    got = one(spark, u=tx.uuid5(ns, F.lit("chunk|é|3")), w=tx.whole_word(F.lit("rain in Niger."), "niger"), n=tx.whole_word(F.lit("Nigeria"), "niger"), s=tx.slug(F.lit(" A (b)--C! ")), d=tx.normalize_doi(F.lit("see https://doi.org/10.1234/Ab.c).")), c=tx.truncate_words(F.lit("one two three"), 8))
    assert got == {"u": str(uuid.uuid5(uuid.UUID(ns), "chunk|é|3")), "w": True, "n": False, "s": "a_b_c", "d": "10.1234/ab.c", "c": "one two"}
    urls = {"HTTPS://WWW.A.example//x//y/?utm_source=1&b=2#f": "https://a.example/x/y?b=2", "http://a.example": "http://a.example/", "": ""}
    for u, want in urls.items():
        assert one(spark, u=tx.normalize_url(F.lit(u)))["u"] == want
    years = {"yields since 2019": (2019, 2024), "past 3 years": (2021, 2024), "2015 to 2018": (2015, 2018), "in 2020": (2020, 2020), "never": None}
    for t, want in years.items():
        got = one(spark, y=tx.year_range(F.lit(t), 2024))["y"]
        assert (tuple(got) if got else None) == want


def test_trends(spark):
    t = MetricTable("m", geo="geo", year="year", value="v")
    rows = [("a", "Production", 2019, 100.0), ("a", "Production", 2021, 120.0), ("a", "Yield", 2019, 2000.0), ("a", "Yield", 2021, 2200.0), ("b", "Production", 2019, 100.0), ("b", "Production", 2021, 120.0), ("b", "Yield", 2019, 2200.0), ("b", "Yield", 2021, 2000.0), ("c", "Yield", 2021, 5.0)]
    trend = metrics.bracketing_trend(spark.createDataFrame(rows, "geo string, element string, year int, v double"), t, 2020, "element", ["geo"])
    by = {(r.geo, r.element): r for r in trend.collect()}
    assert (by["a", "Production"].prior, by["a", "Production"].value, by["a", "Production"].direction, by["a", "Production"].pct) == (100.0, 120.0, "increasing", 20.0)
    assert by["c", "Yield"].direction == "unknown"
    assert {r.geo: (r.direction, r.mixed) for r in metrics.align_directions(trend, ["geo"]).collect()} == {"a": ("increasing", False), "b": ("unknown", True), "c": ("unknown", False)}


def test_discriminators_are_never_mixed(spark):
    df = spark.createDataFrame([("a", 2020, "x", 1.0)], "geo string, year int, kind string, v double")
    with pytest.raises(ValueError, match="mixed"):
        metrics.rank_by_sum(df, MetricTable("m", "geo", "year", "v", discriminators={"kind": ""}))
    assert MetricTable("m", "g", "y", "v").aggregate("yield per hectare") == "avg"


def test_soft_score_golden(spark):
    score = lambda country, year, domain: retrieval.soft_score(F.lit(country), F.lit(False), F.lit("Kenya"), F.lit(year), F.lit(2020), F.lit(2020), F.lit(domain))
    got = one(spark, a=score("Kenya", 2020, True), b=score("Nigeria", 2015, False))
    assert got["a"] == pytest.approx(0.5) and got["b"] == -0.5


def test_diversity_packing_golden(spark):
    kinds = ["news"] * 20 + ["policy"] * 2 + ["report", "paper", "structured"]
    items = spark.createDataFrame([(1, k, i) for i, k in enumerate(kinds)], "q int, kind string, rank int")
    out = retrieval.diversity_pack(items, "q", "kind", "rank", ["news", "policy", "report", "paper"]).orderBy("position").collect()
    assert out[0].kind == "structured" and len(out) == 14 and {r.kind for r in out} == set(kinds)


def test_greedy_dedup_follows_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = [(i, f"u{rng.randrange(12)}", f"t{rng.randrange(15)}" if rng.random() < 0.8 else None, f"b{rng.randrange(40)}") for i in range(80)]
    seen, want = [{}, {}, {}], {}
    for i, *keys in rows:
        hit = next((s[k] for s, k in zip(seen, keys) if k is not None and k in s), None)
        want[i] = hit
        if hit is None:
            for s, k in zip(seen, keys):
                s[k] = i
    df = spark.createDataFrame(rows, "id int, u string, t string, b string")
    assert {r.id: r.duplicate_of for r in corpus.greedy_dedup(df, "id", ["u", "t", "b"]).collect()} == want


def test_recent_history_follows_the_sequential_rule(spark):
    rng = random.Random(8)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * rng.randrange(60)) for c in range(60) for t in range(rng.randint(1, 9))]
    frame = pd.DataFrame(rows, columns=["conv", "turn", "role", "text"])
    for pairs, cap in ((1, 40), (2, 90), (3, 150), (4, 10)):
        want = set()
        for c, g in frame.groupby("conv"):
            tail = g.sort_values("turn").tail(2 * pairs).to_dict("records")
            size = lambda ms: sum(len(m["role"]) + len(m["text"]) + 4 for m in ms)
            while len(tail) > 1 and size(tail) > cap:
                tail = tail[2:]
            while tail and size(tail) > cap:
                tail = tail[1:]
            want |= {(c, m["turn"]) for m in tail}
        got = corpus.recent_history(spark.createDataFrame(rows, "conv int, turn int, role string, text string"), "conv", "turn", pairs, cap)
        assert {(r.conv, r.turn) for r in got.collect()} == want


def test_chunks_hold_all_words_within_the_limit():
    rng = random.Random(1)
    text = " ".join(rng.choice(["short.", "a much longer word", "end!", "x" * 90]) for _ in range(700))
    parts = corpus.split_chunks(text, 100, 15)
    assert all(len(p) // 4 <= 100 for p in parts)
    assert set(text.split()) == {w for p in parts for w in p.split()}
    assert corpus.split_chunks("", 100, 15) == []


def test_heading_blocks(spark):
    df = spark.createDataFrame([(1, "# A\ntext one\n## B\ntext two\n# C\ntext three"), (2, None)], "id long, t string")
    assert [(r.block, r.path, r.text) for r in corpus.heading_blocks(df, "id", "t").orderBy("block").collect()] == [(0, "A", "text one"), (1, "A > B", "text two"), (2, "C", "text three")]


def test_nearest_matches_brute_force(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-50, 50), rng.uniform(-5, 5)) for i in range(200)] + [(900, 4000.0, -3000.0)]
    sites = [(i, rng.uniform(-40, 60), rng.uniform(-5, 5)) for i in range(25)]
    got = joins.nearest(spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(sites, "s int, x double, y double"), "p", "s", "x", "y").collect()
    assert {r.p: r.s for r in got} == {p: min(sites, key=lambda s: ((x - s[1]) ** 2 + (y - s[2]) ** 2, s[0]))[0] for p, x, y in points}


def test_upsert_modes(spark):
    target = spark.createDataFrame([(1, 2020, "old"), (2, 2021, "old")], "k int, y int, v string")
    new = spark.createDataFrame([(2, 2021, "new"), (3, 2021, "late"), (4, 2022, "new")], "k int, y int, v string")
    rows = lambda **a: {(r.k, r.v) for r in star.upsert(target, new, ["k"], "y", **a).collect()}
    assert rows() == {(1, "old"), (2, "old"), (4, "new")}
    assert rows(mode="late_ok") == {(1, "old"), (2, "new"), (3, "late"), (4, "new")}
    assert star.upsert(target.limit(0), new, ["k"], "y").count() == 3


def test_contracts_and_lists(spark):
    contract = StructType([StructField("a", LongType()), StructField("b", StringType())])
    assert harmonise.align(spark.createDataFrame([(1,)], "a int"), contract).schema == contract
    assert harmonise.stub(spark, contract).count() == 0
    assert one(spark, x=harmonise.clean_list(F.lit("Kenya; kenya ;; Mali;KENYA")))["x"] == ["Kenya", "Mali"]
    assert star.audit_row(spark, "t").count() == 1
    with pytest.raises(ValueError, match="must not be joined"):
        joins.enrich(spark.range(1), spark.range(1), joins.JoinSpec("a", "b", [("id", "id")], forbidden=True))


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    got = {r.test: r.failures for r in checks.run(checks.not_null(df, ["k"]), checks.unique(df, ["k"]), checks.accepted_values(df, "v", ["a", "b"])).collect()}
    assert got == {"not_null": 1, "unique": 1, "accepted_values": 1}


def test_keywords_end_at_other_letters(spark):
    """As in SQL, only ASCII letters, digits and underscores belong to a word."""
    got = one(spark, s=tx.keyword_scores(F.lit("oféx éthe the-the thé_the of\u0301 andy a_of"), {"x": ["the"], "y": ["of", "and"]}))["s"]
    assert [(r["score"], r["name"]) for r in got] == [(3, "x"), (2, "y")]


def test_slices_of_texts_and_tiles_of_scores():
    """What Python holds at once follows neither the batch nor the number of vectors."""
    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "t": ["x" * 60, None, "y" * 50, "z" * 300, "", "w"]})
    parts = list(corpus.text_slices(batch, 1, 100))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5]]
    rng = np.random.default_rng(1)
    v, q = rng.integers(-2, 3, (500, 4)).astype(float), rng.integers(-2, 3, (7, 4)).astype(float)
    part = pd.DataFrame({"d": rng.permutation(500), "e": list(v)})
    make = lambda **how: retrieval._top(list(range(7)), retrieval._unit(q), part, 9, "q", "d", "e", **how)
    whole = make(some=512, tile=10**6)
    assert whole.reset_index(drop=True).equals(make(some=3, tile=16).reset_index(drop=True))
    scores = np.round(retrieval._unit(q) @ retrieval._unit(v).T, 9)
    assert whole["d"].tolist() == [d for row in scores for _, d in sorted(zip(-row, part["d"], strict=True))[:9]]
    tracemalloc.start()
    retrieval._top(list(range(512)), np.ones((512, 4)), pd.DataFrame({"d": range(20_000), "e": list(rng.random((20_000, 4)))}), 10, "q", "d", "e")
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
