"""Titles, headlines, off-topic results, hubs and page text against rules and known cases."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import markup
from terraloom.operators import joins, meaning


def test_titles_and_headlines(spark):
    rows = [("Google News", "Item", "Item"), ("A long enough title", "Item", "A long enough title"), ("short", "", "short"), (None, "Item", "Item"), ("Some Error 400 page", "Item", "Item"), ("", None, "")]
    df = spark.createDataFrame(rows, "p string, i string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", meaning.title_ladder(F.col("p"), F.col("i")).alias("got")).collect())
    rows = [("T", "", True), ("", "x" * 119, True), (None, "x" * 120, False), ("A Title", "a  title", True), ("Title", "Title " + "y" * 39, True), ("Title", "Title " + "y" * 60, False), ("A long title of news", "long title", True)]
    df = spark.createDataFrame(rows, "t string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", meaning.headline_only(F.col("t"), F.col("b")).alias("got")).collect())


def test_off_topic_and_hubs(spark):
    rows = [
        ("", "Kenya", "x", "empty"), ("see https://www.a.org/x http://b.org HTTP://A.org https://c.org", "Kenya", "x", "hosts"), ("maize in kenya https://a.org", "Kenya", "x", None), ("about the burkina region", "Burkina Faso", "x", None),
        ("x", "Mali", "It is so", "no title"), ("maize prices rose", "Mali", "Maize prices in Bamako", None), ("maize rose", "Mali", "Maize prices in Bamako", "subject"), ("maize", "", "Maize says", None),
    ]
    df = spark.createDataFrame(rows, "b string, c string, t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("*", meaning.off_topic(F.col("b"), F.col("c"), F.col("t")).alias("got")).collect())
    urls = [("https://a.org", True), ("https://a.org/", True), ("https://a.org/News/?x=1", True), ("https://a.org/story-1", False), ("https://a.org/news/story", False), (None, True), ("http://a.org/#x", True)]
    df = spark.createDataFrame(urls, "u string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("*", meaning.hub_url(F.col("u")).alias("got")).collect())


def test_page_titles(spark):
    pages = ['<meta property=og:title content="It\'s &quot;a\">', "<META name=x><meta content='A \"b\" c' data-x property = 'og:title'/>", "<meta property='og:title' content=''><title>\n T\n x</title>", "<title></title>", "<meta property='og:titles' content='no'><title>yes</title>", None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    got = {r["i"]: r["t"] for r in df.select("i", meaning.page_title(F.col("h")).alias("t")).collect()}
    assert got == {0: 'It\'s &quot;a', 1: 'A "b" c', 2: "T x", 3: None, 4: "yes", 5: None}


@pytest.mark.parametrize(
    ("page", "text"),
    [("a<b>c</b> d < e", "a c d < e"), ("x<!-- <p>no --> y", "x y"), ("<p title='a > b'>t</p>", "t"), ("<nav>n<nav>m</nav>o</nav>p", "p"), ("</nav>a<footer>b", "a"), ("<script>if (a<b) '</nav>'</script>z", "z"), ("a <p", "a"), ("&lt;p&gt; &amp;", "<p> &"), (None, "")],
)
def test_visible_text(page, text):
    assert markup.main_text(page) == text


def test_visible_text_is_linear():
    for page in ("<article>" * 100_000, "<a b " * 100_000, "<a x='" * 100_000, "<!--" * 200_000, "<script>" * 100_000, "<" * 500_000, "</nav>" * 100_000, "<aside>" * 100_000):
        began = time.time()
        markup.main_text(page)
        assert time.time() - began < 3, page[:12]


def test_title_classes(spark):
    titles = ["Red ring small", "small RED ring", "red ring", "blue bolt", None, "", "red ring small extra"]
    rows = list(enumerate(titles))
    sets = {i: frozenset((t or "").lower().split()) for i, t in rows}
    got = {r["i"]: (r["class_id"], r["n_links"]) for r in joins.title_classes(spark.createDataFrame(rows, "i int, t string").withColumn("t", F.coalesce("t", F.lit(""))), "i", "t", 60).collect()}
    for i, s in sets.items():
        same = [j for j, x in sets.items() if x == s]
        near = [j for j, x in sets.items() if j != i and (x == s or (x and s and 100 * len(x & s) >= 60 * len(x | s)))]
        assert got[i] == (min(same), len(near))


def test_title_classes_are_held_and_rows_are_not(spark):
    """Rows of few classes pass broadcast classes and those of many a sorted join; titles are cut into tokens once for the classes and once for the rows."""
    rows = spark.range(400).selectExpr("id AS i", "concat_ws(' ', 'a', 'b', 'c', 'w' || id % 7) AS t")
    few, many = joins.title_classes(rows, "i", "t", 60), joins.title_classes(rows, "i", "t", 60, few=6)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(i, i % 7, 399) for i in range(400)]
    ran = few._jdf.queryExecution()
    assert ran.optimizedPlan().toString().count("split(") == 1
    assert "rightHint=(strategy=broadcast)" in ran.optimizedPlan().toString() and "SortMergeJoin" in many._jdf.queryExecution().sparkPlan().toString()


def test_query_blocks_meet_corpus_slices(spark):
    """Queries beyond a block give what a broadcast of all gives."""
    import numpy as np

    from terraloom.operators import retrieval

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(90)] + [(90, None), (91, [0.0] * 6)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    queries = corpus.withColumnRenamed("doc_id", "query_id").where("query_id % 2 = 0 OR query_id > 88")
    want = sorted(map(tuple, retrieval.dense_top_k(queries, corpus, 5).collect()))
    got = retrieval.dense_top_k(queries, corpus, 5, block=7, rows=20)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 5 * 47
    assert retrieval.dense_top_k(queries.limit(0), corpus, 5).count() == 0


def test_languages(spark):
    from terraloom.operators import meaning

    markers = spark.createDataFrame([("le", "fr"), ("déjà", "fr"), ("und", "de"), ("der", "de"), ("habari", "sw"), ("the", "en"), ("of", "en"), ("unico", "es")], "word string, lang string")
    rows = [
        ("", "en"), (None, "en"), ("hello world", "en"), ("le chat", "fr"), ("DEJA le vu", "fr"), ("und der und le", "de"), ("the king of le chat", "mixed"), ("ééé èèè àà", "unknown"), ("único", "es"), ("the of", "en"),
        ("bonjour a tous, der", "de"), ("bonjour a tous", "fr"), ("bonjour le der", "fr"), ("مرحبا le le", "ar"), ("habari", "sw"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, want string")
    got = meaning.detect_language(df, "i", "t", markers, {"am": r"\p{IsEthiopic}", "ar": r"\p{IsArabic}"}, [("fr", r"(?i)\bbonjour\b")]).join(df, "i").collect()
    assert all(r["detected"] == r["want"] for r in got), [(r["t"], r["detected"], r["want"]) for r in got if r["detected"] != r["want"]]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = meaning.detect_language(docs, "doc_id", "text", meaning.language_markers(docs, "lang", "text")).join(docs.select("doc_id", "lang"), "doc_id")
    assert truth.where("detected = lang").count() >= 0.85 * truth.count()  # the rest is short, or mixed by the rule


def test_chunk_errors(spark):
    from terraloom.operators import checks

    full = dict.fromkeys(checks.CHUNK_FIELDS, "x")
    rows = [("a", "t", full, None), ("", "t", full, None), ("b", None, {}, None), (None, None, None, "{broken"), ("c", "t", None, None)]
    df = checks.chunk_errors(spark.createDataFrame(rows, "id string, text string, metadata map<string,string>, _corrupt_record string"))
    got = [r["errors"] for r in df.collect()]
    missing = [f"missing metadata.{k}" for k in checks.CHUNK_FIELDS]
    assert got == [[], ["missing id or text"], ["missing id or text", *missing], ["not JSON"], missing]
    r = checks.chunk_report(df, F.coalesce(F.length("text"), F.lit(0))).first()
    assert (r["rows"], r["bad_rows"], r["token_max"], r["by_error"]["not JSON"]) == (5, 4, 1, 1)
    assert checks.chunk_report(df.limit(0), F.lit(1)).first()["rows"] == 0


def test_copies_of_titles_meet_once(spark):
    """Copies multiply the pairs, but only sets are compared, and the pairs of rows are not shuffled."""
    rows = spark.range(400).select(F.col("id").alias("i"), F.concat(F.lit("Red ring number "), (F.col("id") % 4).cast("string")).alias("t"))
    found = joins.title_match(rows, rows.withColumnRenamed("i", "j"), "i", "j", "t", 60)
    assert found.count() == 400 * 400
    assert found.groupBy("similarity").count().orderBy("similarity").collect() == [(0.6, 400 * 300), (1.0, 400 * 100)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate"), "pairs of rows are aggregated, hence shuffled"


def test_bm25_reads_texts_once_and_shuffles_no_pairs(spark):
    """Broadcast queries give what joins give: ties, repeated and null ids, empty and null texts, terms of no text and queries given twice."""
    from terraloom.operators import retrieval

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(words[int(x)] for x in rng.zipf(1.6, n) % 30)
    texts = [(i, text(int(rng.integers(1, 40)))) for i in range(300)] + [(7, "w1 w2"), (7, "w1 w2"), (7, "w3 w1 w1"), (None, "w1 w4"), (None, None), (400, None), (401, " "), (402, "W1, w1!")]
    texts += [(500 + i, texts[i][1]) for i in range(50)]
    asked = [(str(i), text(6)) for i in range(20)] + [("a", "w1 never"), ("a", "w1 w2"), (None, "w3"), ("b", "never"), ("c", None)]
    corpus, queries = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(asked, "query_id string, text string")
    found = retrieval.bm25(queries, corpus, 7)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in retrieval.bm25(queries, corpus, 7, block=0).collect()), key=str)
    assert {r[0] for r in got} == {str(i) for i in range(20)} | {"a", None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert retrieval.bm25(queries.where("query_id = 'b'"), corpus, 7).count() == 0 == retrieval.bm25(queries.limit(0), corpus, 7).count() == retrieval.bm25(queries, corpus.limit(0), 7).count()


def test_counts_are_scored_across_batches():
    """A document whose counts come in several batches is scored as one."""
    import pyarrow as pa

    from terraloom.operators import retrieval

    ids = pa.Table.from_arrays([pa.array(["q"])], ["id"])
    sent = type("Sent", (), {"value": (ids, np.ones(4), [(np.array([0]), np.array([1.0]))] * 4, 10.0)})
    rows = [(d, 10, [t], [1 + (d + t) % 3]) for d in range(20_000) for t in range(4)]
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    whole = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["d", "_len", "_t", "_tf"])
    score = lambda d: sum(f * 2.2 / (f + 1.2) for f in (1 + (d + t) % 3 for t in range(4)))
    found = {}
    for batch in retrieval._scores(sent, 5, 1.2, 0.75, ["query_id", "d", "score"])(iter([whole.slice(i, 4999) for i in range(0, len(rows), 4999)])):
        found |= {r["d"]: r["score"] for r in batch.to_pylist()}
    assert len(found) >= 5 and all(abs(s - score(d)) < 1e-6 for d, s in found.items())
    assert sorted(sorted(found), key=lambda d: (-found[d], d))[:5] == sorted(range(20_000), key=lambda d: (-round(score(d), 6), d))[:5]
