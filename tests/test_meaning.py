import html
import re

import pytest
from pyspark.sql import functions as F

from terraloom.operators import meaning


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Soil erosion and soil fertility after the flood", ["Land Use & Soil Health", "Agricultural Environmental & Climate"]),
        ("exports export customs; harvest; ministry policy", ["Agricultural International Trade (Exports & Imports)", "Agricultural Policy & Institutional", "Agricultural Production & Yield"]),
        ("smallholder", ["agriculture", "Agricultural Gender, Youth & Inclusion"]),
        ("food securityfood security", ["agriculture", "Agricultural Nutrition & Food Security"]),
        ("nothing of it", ["agriculture"]),
        (None, ["agriculture"]),
    ],
)
def test_taxonomy(spark, text, want):
    assert one(spark, d=meaning.taxonomy(F.lit(text).cast("string"), meaning.TAXONOMY)).d == want


def test_taxonomy_keeps_the_best(spark):
    text = F.lit("soil climate bank digital yield policy women")
    assert len(one(spark, d=meaning.taxonomy(text, meaning.TAXONOMY, 4)).d) == 4
    assert len(one(spark, d=meaning.taxonomy(text, meaning.TAXONOMY, 6)).d) == 6


@pytest.mark.parametrize(
    ("text", "file", "want"),
    [
        ("The Government of X and the Ministry of Y", "a.pdf", "government_report"),
        ("The Government of X and the Ministry of Y. Abstract", "a.pdf", "academic_article"),
        ("The Government of X and the Ministry of Y", "1-S2.0-x.pdf", "academic_article"),
        ("A Policy Brief of the Ministry of Y\n References \ndoi: 10.1/2 Journal of Z", "a", "government_report"),
        ("Ministry of Y", None, "academic_article"),
        (None, None, "academic_article"),
    ],
)
def test_document_type(spark, text, file, want):
    assert one(spark, t=meaning.document_type(F.lit(text).cast("string"), F.lit(file).cast("string"))).t == want


@pytest.mark.parametrize(("explicit", "info", "kind", "want"), [("3", "policy", "news", 3), ("9", "Policy ", "news", 1), ("x", None, "user_submitted", 3), (None, "?", "news", 2), (None, None, None, 2)])
def test_authority(spark, explicit, info, kind, want):
    assert one(spark, t=meaning.authority(F.lit(explicit).cast("string"), F.lit(info).cast("string"), F.lit(kind).cast("string"))).t == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("First words. Yields  increased\nby 8 percent here. Then prices fell.", "Yields increased by 8 percent here."),
        ("It grew. Prices fell again", "Prices fell again"),
        ("All is stable. Nothing else", "All is stable."),
        ("no sign of it", None),
        ("", None),
        (None, None),
    ],
)
def test_finding(spark, text, want):
    assert one(spark, f=meaning.finding(F.lit(text).cast("string"))).f == want


def test_long_findings_are_cut(spark):
    got = one(spark, f=meaning.finding(F.lit("word " * 100 + "fell"))).f
    assert len(got) <= 300 and got.endswith("…")


def test_page_text_and_title(spark):
    long = "A sentence of the article. " * 12
    rows = [
        (1, f"<title>T  t</title><nav>menu</nav><article><p>{long}</p><aside>x</aside></article><p>after</p>"),
        (2, f'<meta content="O" property="og:title"><title>T</title><article>short</article><main>{long}</main>'),
        (3, "<header>h</header><p>all &amp; <b>of</b> it</p><script>s()</script>"),
        (4, None),
    ]
    out = {r.i: (r.title, r.text) for r in spark.createDataFrame(rows, "i int, html string").select("i", meaning.page_title(F.col("html")).alias("title"), meaning.page_text("html").alias("text")).collect()}
    assert out == {1: ("T t", long.strip()), 2: ("O", long.strip()), 3: (None, "all & of it"), 4: (None, "")}


def test_page_text_query_against_a_plain_pass(spark, sf):
    """On the table's pages, dropping skipped elements and tags by patterns gives the same words."""
    from terraloom.plans import registry

    got = {r.page_id: r.text for r in registry.queries()["c1_page_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        m = re.search(r"(?is)<article.*?</article>", r.html or "")
        plain = lambda s: " ".join(html.unescape(re.sub(r"(?s)<!--.*?-->|<[^>]*>", "\x00", re.sub(r"(?is)<(script|style|nav|footer|header|aside|noscript)\b.*?</\1>", "\x00", s))).replace("\x00", " ").split())
        if m and len(plain(m[0])) > 200:
            assert got[r.page_id].replace(" ", "") == plain(m[0]).replace(" ", "")


def test_every_country_asked_for_counts(spark):
    from terraloom.operators import metrics

    t = metrics.MetricTable("m", "country", "year", "value")
    rows = spark.createDataFrame([(f"c{i}",) for i in range(50)], f"`{t.geo}` string")
    assert metrics.select_rows(rows, t, countries=[f"c{i}" for i in range(40)]).count() == 40


def test_three_key_deduplication_in_order(spark, tmp_path):
    """A row is judged by url, then title on its host, then body, against rows that are no duplicates themselves."""
    from terraloom.plans import registry

    body = lambda t, x: f"<title>{t}</title><p>{x}</p>"
    rows = [
        (1, "https://a.org/x", body("One", "first")),
        (2, "https://www.a.org/x/?utm_source=y", body("Two", "second")),
        (3, "https://a.org/y", body("ONE!", "third")),
        (4, "https://b.org/y", body("One", "fourth")),
        (5, "https://c.org/z", body("Five", "fourth")),
        (6, "https://d.org/z", body("Two", "second")),
        (7, "https://d.org/q", body("two", "seventh")),
        (8, None, None),
        (9, None, None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r.duplicate_of for r in registry.queries()["d1_three_keys"](spark, str(tmp_path)).collect()}
    assert out == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: None, 7: 6, 8: None, 9: None}
    # Pages without url, title and text match nothing; page texts hold the title element's words, so 5 differs from 4 in its body.


def test_labels_share_one_pass(spark):
    """Single words of all labels are found in one pass; only other ones are counted apart."""
    rows = spark.createDataFrame([("Farm farms ai main post-harvest harvest food security",)], "t string")
    found = rows.select(meaning.taxonomy(F.col("t"), {"a": ["farm", "ai"], "b": ["harvest", "post-harvest"], "c": ["food security"]}).alias("x"))
    assert found.first()["x"] == ["b", "a", "c"]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_count") == 2
