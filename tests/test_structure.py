"""Sections, budgets, places, stamped claims, bibliography, context keys and rebuilt folders against sequential rules and known cases."""

import re

import pytest
from pyspark.sql import functions as F

from terraloom.operators import context, corpus, structure
from terraloom.sources import files


def walk(elements):
    """Blocks of one document, element by element, as the survey has it."""
    out, path, titles, held = [], [], [], []

    def close():
        if body := "\n\n".join(held).strip():
            out.append(("/".join(path) or "body", titles[-1] if titles else "body", "prose", body))
        held.clear()

    for kind, text, level in elements:
        text = text.strip()
        if not text:
            continue
        if kind in ("title", "header"):
            close()
            level = level if level > 0 else min(len(path) + 1, 4)
            while len(path) >= level:
                path.pop()
                titles.pop()
            path.append(re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")[:120] or "section")
            titles.append(text[:200])
        elif kind == "table":
            close()
            out.append((("/".join(path) or "body") + "/table", titles[-1] if titles else "body", "table", text))
        else:
            held.append(text)
    close()
    if not out and (joined := "\n\n".join(t.strip() for _, t, _ in elements if t.strip())):
        out.append(("body", "body", "prose", joined))
    return out


ELEMENTS = {
    1: [("text", "before", 0), ("title", "Results & Discussion", 1), ("text", "a", 0), ("text", "b", 0), ("table", "|x|", 0), ("header", "Sub", 2), ("text", "c", 0), ("title", "Deep", 6), ("text", "d", 0), ("title", "Top", 1), ("text", "e", 0)],
    2: [("title", "A", 0), ("title", "B", 0), ("title", "C", 0), ("title", "D", 0), ("title", "E", 0), ("text", "x", 0)],
    3: [("title", "Only", 0), ("title", "Headings", 0)],
    4: [("table", "t", 0), ("text", " ", 0), ("text", "x", 0)],
    5: [("title", "!!!", 3), ("table", "t", 0)],
}


def test_blocks_of_elements(spark):
    rows = [(i, n, *e) for i, es in ELEMENTS.items() for n, e in enumerate(es)]
    df = spark.createDataFrame(rows, "id int, n int, kind string, text string, level int").repartition(3)
    got = {}
    for r in structure.element_blocks(df, "id", "n").orderBy("id", "block").collect():
        got.setdefault(r["id"], []).append((r["path"], r["title"], r["kind"], r["text"]))
    assert got == {i: walk(es) for i, es in ELEMENTS.items()}


def test_blocks_of_texts(spark):
    text = "intro\nline two\n\n# Methods\nsome text\n\nmore\n| a | b |\n| 1 | 2 |\nafter\n## Sub part\n\n# References\n[1] x"
    long = "\n\n".join(f"{'#' * (i % 4 + 1)} H{i}\npara {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "# only"), (5, long)], "id int, text string")
    got = structure.text_blocks(df, "id", "text")
    assert [tuple(r)[2:] for r in got.where("id = 1").orderBy("block").collect()] == [
        ("body", "body", "prose", "intro\nline two"),
        ("methods", "Methods", "prose", "some text\n\nmore"),
        ("methods/table", "Methods", "table", "| a | b |\n| 1 | 2 |"),
        ("methods", "Methods", "prose", "after"),
        ("references", "References", "prose", "[1] x"),
    ]
    assert got.where("id = 4").first()["text"] == "only"
    assert got.where("id = 5").count() == 20_000 and got.count() == 20_006
    roles = got.where("id = 1").select("block", structure.section_role(F.col("path"), F.col("title"), F.col("kind")).alias("r")).orderBy("block").collect()
    assert [r["r"] for r in roles] == ["content", "methods", "table", "methods", "references"]


def test_roles(spark):
    rows = [("a/resume/x", "", "prose", "abstract"), ("body", "Acknowledgments", "prose", "acknowledgements"), ("www_site/results", "", "prose", "boilerplate"), ("x", "Bibliographie", "prose", "references"), ("results/table", "", "table", "table"), ("annexes", "Appendix B", "prose", "appendix"), ("méthodes", "", "prose", "methods"), ("resultsx", None, "prose", "content"), (None, None, None, "content"), ("issn_1234", "Abstract", "prose", "boilerplate")]
    df = spark.createDataFrame(rows, "p string, t string, k string, want string")
    out = df.select("want", structure.section_role(F.col("p"), F.col("t"), F.col("k")).alias("got")).select("*", structure.semantic_lane(F.col("got")).alias("lane")).collect()
    assert all(r["got"] == r["want"] and r["lane"] == (r["got"] if r["got"] in ("table", "abstract") else "content") for r in out)


def budget_rows(rows, budget):
    out, used = [], 0
    for i, text in rows:
        size = len((text or "").encode())
        if used + size <= budget:
            out.append((i, text, False))
            used += size
            continue
        if budget - used > 32:
            out.append((i, context.cut_bytes(text, budget - used), True))
        break
    return out


@pytest.mark.parametrize("budget", [0, 40, 500, 2500, 10**9])
def test_byte_budget(spark, budget):
    rows = [(k, i, None if i % 17 == 3 else "é日x" * ((i * 7) % 40)) for k, n in (("hot", 300), ("b", 5), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, text string").repartition(5)
    got = sorted((tuple(r) for r in structure.byte_budget(df, "k", ["i"], "text", budget).collect()), key=repr)
    want = [(k, *r) for k in ("hot", "b", None) for r in budget_rows([(i, t) for x, i, t in rows if x == k], budget)]
    assert got == sorted(want, key=repr)


def places(text, names, same):
    body = text or ""
    for e in ("References", "Bibliography", "Works Cited"):
        if m := re.search(rf"\n\s*{e}\s*\n", body, re.I):
            body = body[: m.start()]
            break
    counts = {}
    for c in sorted(names, key=len, reverse=True):
        if n := len(re.findall(rf"\b{re.escape(c)}\b", body, re.I)):
            counts[same.get(c, c)] = counts.get(same.get(c, c), 0) + n
    ranked = sorted(counts.items(), key=lambda x: -x[1])
    out = [c for c, n in ranked if n >= (2 if len(ranked) > 3 else 1)][:12]
    return out or [c for c, _ in ranked[:5]]


def test_places(spark):
    texts = [
        "Kenya and NIGERIA, not Nigerian; Niger twice: Niger.", "Guinea-Bissau borders Guinea. Mali, Togo, Chad, Mali", "DRC, Congo and the Democratic Republic of the Congo; South Sudan", "Ghana\nReferences\nMali Mali Mali",
        "Ghana Mali Togo Chad Benin Kenya", "x\n bibliography \nKenya", None, "", " ".join(f"{c}, {c}" for c in structure.COUNTRIES),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", structure.places_of_focus(F.col("t")).alias("p")).collect()}
    assert got == {i: places(t, structure.COUNTRIES, structure.SAME_PLACE) for i, t in enumerate(texts)}


def test_stamped_claims(spark):
    rows = [
        (1, "Maize yields declined by 12% YoY in Kenya's Rift Valley.", {"domains": "yield; other"}),
        (2, "Rice production increased 8.5% this season across Senegal.", {"indicator": "Rice output. Long text", "domains": "x"}),
        (3, "The workshop convened stakeholders.", {"indicator": "x"}),
        (4, "Prices rose.", {"finding": "kept", "direction": "decreasing"}),
        (5, "nothing", {"insight_text": "Exports fell by 3%.", "unit": "own", "finding": " "}),
        (6, "Market prices remained stable through the quarter.", None),
        (7, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, text string, meta map<string,string>")
    once = structure.stamp_claims(df, "text", "meta")
    got = {r["i"]: r["meta"] for r in once.collect()}
    assert got[1] == {"domains": "yield; other", "finding": "Maize yields declined by 12% YoY in Kenya's Rift Valley.", "metric": "yield", "direction": "decreasing", "magnitude": "-12.0", "unit": "pct_yoy"}
    assert got[2]["metric"] == "Rice output" and got[2]["magnitude"] == "8.5" and got[2]["unit"] == "pct"
    assert got[3] == {"indicator": "x"} and got[4] == rows[3][2] and got[7] is None
    assert got[5]["unit"] == "own" and got[5]["direction"] == "decreasing" and got[5]["finding"] == "Exports fell by 3%." and "metric" not in got[5]
    assert got[6] == {"finding": "Market prices remained stable through the quarter.", "direction": "stable"}
    assert {r["i"]: r["meta"] for r in structure.stamp_claims(once, "text", "meta").collect()} == got


def test_context_keys(spark):
    columns = ["doi", "url", "title", "authors", "year", "document", "text"]
    rows = [
        ("https://DX.doi.org/10.1/AB", "http://x", "t", "a", "1", "d", "x", "doi:10.1/ab"),
        (" ", "HTTP://x", "My  Title", "", "2020", "d", "x", "work:my title||2020"),
        (None, "https://A.b/c?UTM_x=1&Id=2&fbclid=3#frag", None, None, None, None, None, "url:https://a.b/c?id=2"),
        (None, "https://a.b/c?utm_x=1", None, None, None, None, None, "url:https://a.b/c"),
        (None, None, "T", None, None, "Doc.pdf", "x", "doc:doc.pdf|t"),
        (None, None, None, None, None, "d", " Some  Text ", "text:" + __import__("hashlib").sha1(b"some text").hexdigest()[:16]),
        (None, "ftp://x", None, "a", "2020", None, None, "id:6"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in columns) + ", want string")
    got = df.select("i", "want", structure.context_key({c: F.col(c) for c in columns}, F.col("i")).alias("key")).collect()
    assert all(r["key"] == r["want"] for r in got), got


def test_bibliography(spark):
    head = "Food Policy Review Vol. 12 (2019)\n\nDROUGHT AND MAIZE YIELDS IN EASTERN AFRICAN HIGHLANDS\n\nJane Doe1*, Amina Diallo2 School of Economics\n\nAbstract\ndoi: 10.1016/j.foodpol.2019.01.002.\n(2019): 101-120\n"
    other = "A Study of the Long Rains and Their Effects\nISSN 1234-5678\nno. 4: 7-19 in 2003 or 1890"
    df = spark.createDataFrame([(1, head), (2, other), (3, None), (4, "plain words only here and nothing else at all"), (5, "x" * 5000 + head)], "i int, text string")
    found = structure.bibliography(F.col("text"))
    table = df.select("i", *[found[c].alias(c) for c in structure.BIBLIOGRAPHY])
    got = {r["i"]: tuple(r)[1:] for r in table.collect()}
    assert got[1] == ("DROUGHT AND MAIZE YIELDS IN EASTERN AFRICAN HIGHLANDS", "Jane Doe, Amina Diallo", "2019", "Food Policy Review", "10.1016/j.foodpol.2019.01.002", "101-120")
    assert got[2] == ("A Study of the Long Rains and Their Effects", None, "2003", None, None, "7-19")
    assert got[3] == got[4] == got[5] == (None,) * 6
    sidecar = spark.createDataFrame([(1, "Own title", " "), (3, None, "Me")], "i int, article_title string, authors string")
    merged = {r["i"]: (r["article_title"], r["authors"], r["doi"], r["bibliography_source"]) for r in structure.with_sidecar(table, sidecar, "i").collect()}
    assert merged[1] == ("Own title", "Jane Doe, Amina Diallo", "10.1016/j.foodpol.2019.01.002", "sidecar+heuristic")
    assert merged[3] == (None, "Me", None, "sidecar+heuristic") and merged[2][3] == "heuristic"


def test_rebuild_by_id(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "id int, kind string, value string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted((tuple(r) for r in spark.read.schema(schema).parquet(path).select("id", "kind", "value").collect()), key=repr)
    files.rebuild(make([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "x"), (5, "c d", "x")]), path, ["kind"], "id")
    untouched = sorted(p.name for p in (tmp_path / "store" / "kind=b").iterdir())
    for _ in range(2):  # a second run changes nothing
        files.rebuild(make([(2, "a", "new"), (4, "a", "moved"), (5, "e", "moved"), (6, "f/g", "added")]), path, ["kind"], "id")
        assert read() == sorted([(1, "a", "x"), (2, "a", "new"), (3, "b", "x"), (4, "a", "moved"), (5, "e", "moved"), (6, "f/g", "added")], key=repr)
    assert untouched == sorted(p.name for p in (tmp_path / "store" / "kind=b").iterdir())
    # A run that failed after one of its partitions leaves rows of an id in two; the next run mends them.
    make([(2, "b", "half"), (3, "b", "x")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)
    files.rebuild(make([(2, "b", "whole")]), path, ["kind"], "id")
    assert read() == sorted([(1, "a", "x"), (2, "b", "whole"), (3, "b", "x"), (4, "a", "moved"), (5, "e", "moved"), (6, "f/g", "added")], key=repr)


def test_names_share_one_pass(spark):
    rows = spark.createDataFrame([("Guinea-Bissau, Niger and Nigeria; niger, Guinea, Nigeria nigerian",)], "t string")
    found = rows.select(structure.places_of_focus(F.col("t"), ["Niger", "Nigeria", "Guinea", "Guinea-Bissau"], {}).alias("x"))
    assert found.first()["x"] == ["Nigeria", "Guinea", "Niger"]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_count") == 1


def test_only_texts_with_a_trend_are_read(spark):
    """The gate lets every text through that one of the patterns matches."""
    words = "increase increased increases increasing rise rises rising risen grew growth up upward higher improve improving surge surged surges climb climbed gain gained expand expanded decrease decreasing decline declining drop dropped fall falling fallen fell down downward lower reduce reducing"
    words += " shrink shrinking slump slumped contract contracted worsen worsened stable unchanged flat steady stagnant plateau plateaued no  change remained stable 5% 5.5 percent 5 percentage  points 3pp -2% yoy"
    texts = [f"x {w} y" for w in words.split()] + [f"éx,{w.upper()},é" for w in words.split()] + ["no\n change", "remains flat", "7 pp", "nothing of 5 kinds", "upon riskless contraction", "sup 5 pupils"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    matched = F.lit(False)
    for p in (corpus.RISE, corpus.FALL, corpus.STABLE, corpus.PERCENT):
        matched = matched | F.col("t").rlike("(?i)" + p)
    got = rows.select("t", matched.alias("m"), corpus.states_trend(F.col("t")).alias("g")).collect()
    assert sum(r["m"] for r in got) > 60 and not [r["t"] for r in got if r["m"] and not r["g"]]
    assert not {r["t"]: r["g"] for r in got}["nothing of 5 kinds"]
