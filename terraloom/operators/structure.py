"""Sections and tables of texts, their roles, budgets by bytes, places, bibliography, claims stamped on metadata, keys of context."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.functions import text as tx
from terraloom.operators import context, corpus, meaning
from terraloom.operators.state import cut

Element = tuple[str, str, int]

#: Bytes of text whose rows are made at once.
SLICE = 1 << 20
#: Deepest level of a heading without a level of its own.
DEEPEST = 4


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_")[:120] or "section"


def text_elements(text: str) -> Iterator[Element]:
    """(kind, text, level) of a text: Markdown headings, runs of lines that begin with a bar as tables, and paragraphs."""
    kind, held = "", []
    for line in [*text.splitlines(), ""]:
        line = line.strip()
        heading = re.match(r"(#{1,6})\s+(.*\S)", line)
        now = "" if heading or not line else "table" if line.startswith("|") else "text"
        if held and now != kind:
            yield kind, "\n".join(held), 0
            held = []
        if heading:
            yield "title", heading[2], len(heading[1])
        elif line:
            held.append(line)
        kind = now


def fold(elements: Iterable[Element]) -> Iterator[tuple[str, str, str, str]]:
    """(path, title, kind, text) of the blocks of one text.

    A heading closes the block before it and stands at its level, or one below the last (up to `DEEPEST`) if it has none; all headings from its level on end.
    Prose between headings and tables is one block; a table is its own.
    """
    path: list[tuple[str, str]] = []
    prose: list[str] = []
    headings, any_block = [], False
    for kind, text, level in [*elements, ("", "", 0)]:
        text = (text or "").strip()
        if not text and kind:
            continue
        if kind in ("title", "header", "table", "") and prose:
            yield "/".join(s for s, _ in path) or "body", path[-1][1] if path else "body", "prose", "\n\n".join(prose)
            prose, any_block = [], True
        if kind in ("title", "header"):
            del path[(level if level > 0 else min(len(path) + 1, DEEPEST)) - 1 :]
            path.append((slug(text), text[:200]))
            headings.append(text)
        elif kind == "table":
            yield "/".join([*(s for s, _ in path), "table"]) if path else "body/table", path[-1][1] if path else "body", "table", text
            any_block = True
        elif kind:
            prose.append(text)
    if headings and not any_block:  # nothing but headings
        yield "body", "body", "prose", "\n\n".join(headings)


_BLOCK = "block int, path string, title string, kind string, text string"


def _batch(ids: pa.Array, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)]], ["id", "block", "path", "title", "kind", "text"])


def text_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, block, path, title, kind, text of the blocks of whole texts, in one pass without a shuffle. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, size = [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, block in enumerate(fold(text_elements(text or ""))):
                    rows.append(i)
                    found.append((n, *block))
                size += len(text or "")
                if size > SLICE:
                    yield _batch(batch.column(0), rows, found)
                    rows, found, size = [], [], 0
            yield _batch(batch.column(0), rows, found)

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_BLOCK}")


def element_blocks(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """id, block, path, title, kind, text from rows (id, order, kind, text, level) of elements; the elements of one document meet in one group."""

    def run(table: pa.Table) -> pa.Table:
        at = sorted(range(len(table)), key=table.column(order).to_pylist().__getitem__)
        kinds, texts, levels = (table.column(c).to_pylist() for c in ("kind", "text", "level"))
        found = [(n, *b) for n, b in enumerate(fold((kinds[i] or "text", texts[i], levels[i] or 0) for i in at))]
        return pa.Table.from_batches([_batch(table.column(id_col).combine_chunks(), [0] * len(found), found)]).rename_columns([id_col, "block", "path", "title", "kind", "text"])

    return df.select(id_col, order, F.lower("kind").alias("kind"), "text", F.col("level").cast("int").alias("level")).groupBy(id_col).applyInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, {_BLOCK}")


#: Roles of sections by a part of their path, English and French, in order; before them, by how a title begins; and marks of boilerplate.
ROLES: dict[str, list[str]] = {
    "abstract": ["abstract", "resume", "resumé", "summary"],
    "introduction": ["introduction", "intro", "background", "contexte", "context"],
    "methods": ["methods", "methodology", "materials_and_methods", "materials", "methods_and_materials", "methodes", "materiel_et_methodes", "méthodes"],
    "results": ["results", "findings", "resultats", "résultats"],
    "discussion": ["discussion", "interpretation"],
    "conclusion": ["conclusion", "conclusions", "concluding_remarks"],
    "acknowledgements": ["acknowledgements", "acknowledgments", "acknowledgement", "remerciements", "funding", "financial_support", "grant_support"],
    "references": ["references", "bibliography", "bibliographie", "literature_cited", "works_cited", "cited_references"],
    "appendix": ["appendix", "appendices", "supplementary", "supplemental", "annexe", "annexes"],
}
TITLES = [("acknowledgements", "^(?:acknowledg|remerciements)"), ("references", "^(?:references?$|bibliograph)"), ("abstract", "^abstract$"), ("appendix", "^append")]
BOILERPLATE = ["journal_homepage", "elsevier", "springer", "wiley", "doi_org", "https?_", "www_", "available_online", "copyright", "all_rights_reserved", "open_access", "creative_commons", "issn", "isbn", "article_history", "received_date", r"land_use_policy_\d", "sciencedirect", "sci_hub"]
LEFT_OUT = ["acknowledgements", "references", "boilerplate", "appendix"]


def section_role(path: Column, title: Column, kind: Column) -> Column:
    """The role of a block: a table, boilerplate by its path, a role by its title, one by a part of its path, or content."""
    p, t = F.lower(F.coalesce(path, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    out = F.when(kind == "table", "table").when(p.rlike("|".join(BOILERPLATE)), "boilerplate")
    for role, pattern in TITLES:
        out = out.when(t.rlike(f"(?i){pattern}"), role)
    for role, parts in ROLES.items():
        out = out.when(F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, parts))), role)
    return out.otherwise("content")


def semantic_lane(role: Column) -> Column:
    """The lane in which a section of a role is searched."""
    return F.when(role.isin("table", "abstract"), role).otherwise("content")


def byte_budget(df: DataFrame, key: str, order: Sequence[str], text: str, budget: int, least: int = 32) -> DataFrame:
    """The rows of each key, in order, whose texts fit into `budget` UTF-8 bytes together, with `truncated`; of the row that crosses it as much as is left, if that is more
    than `least` bytes, with an ellipsis; none after it. Null texts count 0 bytes.

    Sums are made in two levels over a range partitioning by key and order: partitions of a key that begin beyond the budget are dropped before any row of them is
    sorted, so no key is sorted in one task. `order` must tell the rows of a key apart.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = cut(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("k"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], size.alias("size")).repartitionByRange("k", *[f"o{i}" for i in range(len(order))]).withColumn("part", F.spark_partition_id()))
    before = W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("k", "part").agg(F.sum("size").alias("held")).select(F.col("k").alias("key"), F.col("part").alias("p"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    near = rows.join(starts.where(F.col("start") <= budget), F.col("k").eqNullSafe(F.col("key")) & (F.col("part") == F.col("p")))
    inside = W.partitionBy("k", "part").orderBy(*[f"o{i}" for i in range(len(order))]).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = near.withColumn("before", F.col("start") + F.sum("size").over(inside) - F.col("size"))
    left = budget - F.col("before")
    kept = placed.where((F.col("size") <= left) | (left > least))
    full = F.col(f"row.`{text}`")

    @F.pandas_udf("string")
    def shorten(values, most):
        return values.combine(most, lambda t, m: t if t is None else context.cut_bytes(t, int(m)))

    crossing = F.col("size") > left
    columns = [F.when(crossing, shorten(full, left)).otherwise(full).alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns]
    return kept.where(left >= 0).select(*columns, crossing.alias("truncated"))


#: Countries of the corpus, and names that stand for another.
COUNTRIES = [
    "Algeria", "Angola", "Benin", "Botswana", "Burkina Faso", "Burundi", "Cameroon", "Cape Verde", "Central African Republic", "Chad", "Comoros", "Congo", "Djibouti", "Egypt", "Equatorial Guinea", "Eritrea", "Eswatini", "Ethiopia", "Gabon", "Gambia",
    "Ghana", "Guinea", "Guinea-Bissau", "Ivory Coast", "Cote d'Ivoire", "Kenya", "Lesotho", "Liberia", "Libya", "Madagascar", "Malawi", "Mali", "Mauritania", "Mauritius", "Morocco", "Mozambique", "Namibia", "Niger", "Nigeria", "Rwanda",
    "Sao Tome and Principe", "Senegal", "Seychelles", "Sierra Leone", "Somalia", "South Africa", "South Sudan", "Sudan", "Tanzania", "Togo", "Tunisia", "Uganda", "Zambia", "Zimbabwe", "DRC", "Democratic Republic of the Congo",
]
SAME_PLACE = {"DRC": "Democratic Republic of the Congo", "Congo": "Democratic Republic of the Congo"}


def places_of_focus(text: Column, names: Sequence[str] = COUNTRIES, same: Mapping[str, str] = SAME_PLACE, most: int = 12, few: int = 5) -> Column:
    """Names that a text mentions before its endings, most mentions first, ties by the longer and then the earlier name.

    A mention is the name as whole words, whatever its case, also within a longer name (`Guinea` in `Guinea-Bissau`). With more than three candidates those with two
    mentions count, or the first `few` if there are none.
    """
    ordered = sorted(names, key=lambda n: (-len(n), list(names).index(n)))
    rank: dict[str, int] = {}
    for n in ordered:
        rank.setdefault(same.get(n, n), len(rank))

    single = [n.lower() for n in ordered if tx.is_word(n)]

    def look(x: Column) -> Column:
        counts = []
        for name, place in rank.items():
            n = F.lit(0)
            for alias in (a.lower() for a in ordered if same.get(a, a) == name):
                if tx.is_word(alias):
                    n = n + F.size(x["w"]) - F.size(F.array_remove(x["w"], alias))
                else:  # a longer name may hold another one, so it is counted by itself
                    n = n + F.when(F.contains(x["t"], F.lit(alias)), F.regexp_count(x["t"], F.lit(rf"(?<![\p{{L}}\p{{N}}_]){tx._quote(alias)}(?![\p{{L}}\p{{N}}_])"))).otherwise(0)
            counts.append(F.struct((-n).alias("minus"), F.lit(place).alias("place"), F.lit(name).alias("name")))
        return F.array_sort(F.filter(F.array(*counts), lambda c: c["minus"] < 0))

    # As an array's element the text is prepared and searched for all single words once, not for every name.
    searched = lambda body: F.struct(body.alias("t"), tx.whole_words(body, single).alias("w"))
    found = F.get(F.transform(F.transform(F.array(F.lower(meaning.main_text(text))), searched), look), F.lit(0))

    def choose(found: Column) -> Column:
        often = F.when(F.size(found) > 3, F.filter(found, lambda c: c["minus"] <= -2)).otherwise(found)
        return F.transform(F.when(F.size(often) > 0, F.slice(often, 1, most)).otherwise(F.slice(found, 1, few)), lambda c: c["name"])

    return F.get(F.transform(F.array(found), choose), F.lit(0))


#: Keys of metadata that name a metric, the lanes whose text is read for claims, and the fields of a claim.
METRIC_KEYS = ["metric", "metric_text", "Measure", "measure", "indicator", "element", "item", "product"]
LANES = ["metric_text", "insight_text", "recommendation_text"]


def stamp_claims(df: DataFrame, text: str, meta: str) -> DataFrame:
    """df with the claim of each text filled into its metadata (a map of strings), where it states a direction or a magnitude.

    Only absent or empty fields are filled, and rows that have a finding and a direction are left as they are, so a second run changes nothing. The text is the first
    lane of the metadata that is not empty, else the row's. The metric is the first clause of the first structured key, else the first domain.
    """
    old = F.coalesce(F.col(meta), F.create_map().cast("map<string,string>"))
    has = lambda k: F.trim(F.coalesce(F.try_element_at(old, F.lit(k)), F.lit("")))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    body = F.coalesce(first(*map(has, LANES)), F.col(text))
    done = (has("finding") != "") & (has("direction") != "")
    # A text is read once, and only where its row is not done and it may state a trend.
    read = F.when(~done & corpus.states_trend(body), F.struct(*[c.alias(k) for k, c in corpus.claims(body).items()], meaning.finding(body).alias("finding")))
    df = df.withColumn("_claim", read)
    claim = {k: F.col("_claim")[k] for k in ("direction", "magnitude", "unit", "finding")}
    domain = F.trim(F.get(F.split(F.trim(F.get(F.split(has("domains"), ";"), F.lit(0))), ","), F.lit(0)))
    clause = lambda k: F.substring(F.trim(F.get(F.split(has(k), r"\."), F.lit(0))), 1, 128)
    # The first structured key that is not empty decides, even if its first clause is.
    structured = F.coalesce(*[F.when(has(k) != "", clause(k)) for k in METRIC_KEYS])
    metric = F.when(structured.isNotNull() & (structured != ""), structured).when(domain != "", F.substring(domain, 1, 128))
    usable = claim["direction"].isNotNull()
    fields = {"finding": claim["finding"], "metric": metric, "direction": claim["direction"], "magnitude": claim["magnitude"].cast("string"), "unit": claim["unit"]}
    new = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.when(has(k) == "", v).alias("value")) for k, v in fields.items()]), lambda e: e["value"].isNotNull())
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.transform(new, lambda e: e["key"]), k))
    stamped = F.map_concat(kept, F.map_from_entries(new))
    return df.withColumn(meta, F.when(usable, stamped).otherwise(F.col(meta))).drop("_claim")


def url_key(url: Column, dropped: Sequence[str] = ("utm_", "fbclid", "li_")) -> Column:
    """A URL in lower case without fragment and tracking parameters (those whose names begin with one of `dropped`)."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_extract(bare, r"\?(.*)$", 1)).otherwise("")
    wanted = F.filter(F.split(query, "&"), lambda q: (q != "") & ~F.lower(q).rlike("^(?:" + "|".join(map(re.escape, dropped)) + ")"))
    return F.lower(F.concat(F.regexp_replace(bare, r"\?.*$", ""), F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise("")))


def context_key(columns: Mapping[str, Column], row_id: Column) -> Column:
    """One key for the rows of a work: by DOI, else URL, else title with authors or year, else document with title, else text, else the row itself.

    columns: any of doi, url, title, authors, year, document, text. Titles, authors and texts are squeezed and lower-cased.
    """
    get = lambda c: F.lower(tx.squeeze(F.coalesce(columns[c].cast("string"), F.lit("")))) if c in columns else F.lit("")
    doi = F.trim(F.regexp_replace(F.regexp_replace(get("doi"), r"^https?://(?:dx\.)?doi\.org/", ""), "^[doi:]+", ""))
    url = F.trim(F.coalesce(columns["url"], F.lit(""))) if "url" in columns else F.lit("")
    title, authors, year = get("title"), get("authors"), get("year")
    text = F.substring(get("text"), 1, 240)
    return F.coalesce(
        F.when(doi != "", F.concat(F.lit("doi:"), doi)),
        F.when(F.startswith(url, F.lit("http")), F.concat(F.lit("url:"), url_key(url))),
        F.when((title != "") & ((authors != "") | (year != "")), F.concat(F.lit("work:"), F.concat_ws("|", F.substring(title, 1, 160), F.substring(authors, 1, 120), year))),
        F.when((get("document") != "") & (title != ""), F.concat(F.lit("doc:"), get("document"), F.lit("|"), F.substring(title, 1, 80))),
        F.when(text != "", F.concat(F.lit("text:"), F.substring(F.sha1(text.cast("binary")), 1, 16))),
        F.concat(F.lit("id:"), row_id.cast("string")),
    )


#: Patterns of bibliographic lines, and words that no title has.
DOI = r"(?i)(?:doi[:\s]*|(?:dx\.)?doi\.org/|https?://(?:dx\.)?doi\.org/)(10\.\d{4,9}/[^\s\]>\"'),]+)"
AUTHORS = r"^[A-ZÀ-ÖØ-Ý][\w\s.\-'’]+?\d+\*?(?:,\s*[A-ZÀ-ÖØ-Ý][\w\s.\-'’]+?\d+\*?)+"
JOURNAL = r"(?i)^([A-Za-z][A-Za-z0-9 &\-]{4,80}?)\s+(?:NS|Vol\.?|Volume|n[o°]\.?)\s*\d+.*\((?:19|20)\d{2}\)"
ISSN = r"(?i)\bISSN[:\s]+[\d\-X]+"
PAGES = [r"(?i)No\.?\s*\d+[:\s]*(\d+)\s*[-–]\s*(\d+)", r"\((?:19|20)\d{2}\)\s*[:\s]*(\d+)\s*[-–]\s*(\d+)"]
NO_TITLE = r"(?i)\b(?:abstract|introduction|résumé|issn|doi|copyright)\b"
AFFILIATION = r"(?i)\s*\d*\s*\b(?:School|Department|Institute|Institut|Centre|Center|University|Université|Faculty|College)\b.*$"
BIBLIOGRAPHY = ["article_title", "authors", "publication_year", "journal", "doi", "pages"]


def bibliography(text: Column, head: int = 4500) -> dict[str, Column]:
    """Title, authors, year, journal, DOI and pages that a text's first `head` characters show; null where they show none. All stays in the JVM.

    A title is the line that scores best: of 25 to 350 characters, mostly letters, in capitals or with most words capitalised, no line of authors; capitals count 20
    more than their length. Authors are the first line of names with numbers; years stand in brackets, then in a journal's line, then anywhere.
    """
    top = F.substring(F.coalesce(text, F.lit("")), 1, head)
    lines = F.transform(F.split(top, r"\r\n|\n|\r"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    count = lambda s, p: F.regexp_count(s, F.lit(p))
    letters, upper = lambda s: count(s, r"\p{L}"), lambda s: count(s, r"\p{Lu}")

    def titled(s: Column) -> Column:
        words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
        capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        fits = F.length(s).between(25, 350) & ~s.rlike(AUTHORS) & ~s.rlike(NO_TITLE) & (letters(s) >= 15)
        return fits & ((upper(s) >= F.greatest(F.lit(8), F.floor(letters(s) * 0.55))) | ((F.size(words) >= 4) & (capital >= F.size(words) * 0.6)))

    early = F.transform(F.split(F.substring(top, 1, 3500), r"\r\n|\n|\r"), lambda s: F.trim(s))
    loud = lambda s: F.when((F.upper(s) == s) & (F.lower(s) != s), 20).otherwise(0)
    scored = F.transform(early, lambda s, i: F.struct(F.when(titled(s), F.length(s) + loud(s)).otherwise(0).alias("score"), (-i).alias("first"), s.alias("line")))
    best = F.array_max(scored)
    names = F.get(F.filter(F.slice(F.filter(lines, lambda s: s != ""), 1, 35), lambda s: s.rlike(AUTHORS)), F.lit(0))
    names = F.regexp_replace(F.regexp_replace(tx.squeeze(names), AFFILIATION, ""), r"\d+\*?", "")
    names = F.regexp_replace(F.regexp_replace(names, r"\s{2,}", " "), r",\s*,", ", ")
    names = F.regexp_replace(names, r"^[ ,;]+|[ ,;]+$", "")
    doi = F.regexp_replace(F.regexp_extract(top, DOI, 1), r"[.,;)]+$", "")
    first40 = F.slice(lines, 1, 40)
    headed = F.get(F.filter(F.transform(first40, lambda s: F.when(s.rlike(JOURNAL), F.trim(F.regexp_extract(s, JOURNAL, 1))).when(s.rlike(ISSN) & F.length(s).between(11, 179), F.regexp_replace(F.get(F.split(s, "ISSN"), F.lit(0)), r"^[ \-–|,]+|[ \-–|,]+$", ""))), lambda s: s.isNotNull()), F.lit(0))
    years = lambda p: F.get(F.filter(F.regexp_extract_all(top, F.lit(p), 1), lambda y: y.cast("int").between(1950, 2035)), F.lit(0))
    year = F.coalesce(F.nullif(F.regexp_extract(doi, r"/((?:19|20)\d{2})/", 1), F.lit("")), years(r"\(((?:19|20)\d{2})\)"), years(r"\b((?:19|20)\d{2})\b"))
    pages = F.coalesce(*[F.when(top.rlike(p), F.concat(F.regexp_extract(top, p, 1), F.lit("-"), F.regexp_extract(top, p, 2))) for p in PAGES])
    empty = lambda c: F.nullif(c, F.lit(""))
    return {"article_title": F.when(best["score"] > 0, best["line"]), "authors": empty(F.substring(names, 1, 500)), "publication_year": year, "journal": empty(headed), "doi": empty(doi), "pages": pages}


def with_sidecar(found: DataFrame, sidecar: DataFrame, id_col: str) -> DataFrame:
    """found with each field replaced by the sidecar's where that is not empty, and bibliography_source. One sidecar row for an id."""
    other = sidecar.select(F.col(id_col).alias("_id"), *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"_{c}") for c in BIBLIOGRAPHY if c in sidecar.columns])
    joined = found.join(other, F.col(id_col) == F.col("_id"), "left")
    merged = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in other.columns else F.col(c) for c in BIBLIOGRAPHY]
    return joined.select(id_col, *merged, F.when(F.col("_id").isNull(), "heuristic").otherwise("sidecar+heuristic").alias("bibliography_source"))
