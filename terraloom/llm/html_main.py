"""Main text of web pages by site style trees (operator 9).

The pages of a host are merged into one tree of elements: an element is a path of tags with class and id names, numbers in names left out.
Its presentation importance is the entropy of its styles (the sequences of child tags) over the host's pages, its
content importance 1 - the mean entropy of its contents over the pages they stand on: what every page
repeats is worth 0, what one page has is worth 1. Both are combined as (1 - g^s) presentation + g^s content, s the
number of styles. Elements of fixed meaning have fixed importance: navigation, page headers and footers, asides,
forms, scripts and elements named as adverts, notices, menus or reader comments are worth 0 (a name counts by its parts and
never for html, body or what wraps the page's only main elements; a form that holds all of a page is neutral). What an article or main
element holds starts from a prior of 1 that counts as `PRIOR` pages, so it takes evidence to drop it, but it can be dropped.
A single block is judged in the same way, as a content that k of the m pages with its element show: 1 - log_m k. A page
keeps, inside and outside of main elements, the blocks of elements that are not of low importance, without those blocks that
are of low importance themselves and stand on more than half of the pages. An element is judged by the blocks directly in
it; those of its children by theirs.

Counts are over distinct pages, so that copies are no evidence against what they repeat: the rows of a page (one for each
element with its style and content, and for each block) meet those of its copies first, then they are counted with map-side partials. The low elements and blocks come back as one row per host.

Pages are read in one pass: the time is linear in the page, whatever is left open or unclosed, and an element holds a 64-bit hash of its path, not the path.

Defined cases: null and empty html have the text ""; a null or unreadable url has no host, and such pages are not merged;
hosts with fewer than `MIN_PAGES` distinct pages showing an element have no evidence against it; pages of a host with the
same open blocks count as one page, repeated rows too; very long and very deep pages are read whole; a tag or comment that never ends reaches to the
page's end; blocks of equal importance stay or go together; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import zlib
from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import cut, slices, table

MIN_PAGES = 5
LOW = 0.2
DECAY = 0.9
PRIOR = 1.0
MOST_BROADCAST = 16 << 20

_OPENS = re.compile(r"[a-zA-Z][^\s/>]*")
_STOPS = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "template", "svg", "canvas", "object", "select"}
_TO_THE_END = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_INLINE |= {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "mfenced", "mstyle", "mspace", "semantics"}
_ASIDE = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "button", "head", "fieldset", "datalist"}
_MAIN = {"article", "main"}
_HEADINGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_OPEN_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Parts of class and id names: of what is no main text, of states and layouts that say nothing, and of a text's own head.
_NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "adslot", "adbox", "adunit", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "feedback", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay",
    "pagination", "pager", "search", "searchform", "searchbox", "widget", "widgets", "toolbar", "skip",
}
_NEUTRAL = {"no", "not", "has", "have", "with", "without", "is", "layout", "page", "pages", "app", "theme", "enabled", "disabled", "open", "closed"}
_OWN_HEAD = {"article", "entry", "post", "story", "content"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"(?<![a-z])(?=[a-f]*[0-9])[0-9a-f]{6,}(?![a-z])|[0-9]+", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}


def host(url: str | None) -> str | None:
    """The lower-cased host name of a URL, without user and port."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]+)", url or "")
    name = m[1].rsplit("@", 1)[-1].split(":")[0].lower() if m else ""
    return name or None


def block_hash(path: str | int, text: str) -> int:
    """64 bits for a block of an element."""
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def named_noise(label: str) -> bool:
    """Whether a class or id name says that an element is no main text: one of its parts does, and none makes it a state, a layout or a text's own head."""
    parts = [x.lower() for x in _PARTS.findall(label)]
    said = _NOISE.intersection(parts) | ({"sidebar"} if "side" in parts and "bar" in parts else set())
    if not said or _NEUTRAL.intersection(parts):
        return False
    return not (said == {"header"} and _OWN_HEAD.intersection(parts))


def _tag_end(page: str, at: int) -> int:
    """Where the tag that began before `at` ends (after its >), or -1; a > within a quoted value does not count."""
    while m := _STOPS.search(page, at):
        if m[0] == ">":
            return m.end()
        at = page.find(m[0][-1], m.end()) + 1
        if not at:
            return -1
    return -1


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in order, in one pass; a tag or comment without an end reaches to the end of the page."""
    at, end, missing = 0, len(page), set()
    while at < end:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= end:
            yield "text", _html.unescape(page[at:]), ""
            return
        if page.startswith("<!--", lt) or page.startswith("<![CDATA[", lt):
            mark, first = ("-->", lt + 4) if page[lt + 2] == "-" else ("]]>", lt + 9)
            stop = page.find(mark, first)
            yield "text", _html.unescape(page[at:lt]), ""
            if mark == "]]>":
                yield "text", page[first : stop if stop >= 0 else end], ""
            at = stop + 3 if stop >= 0 else end
            continue
        if page[lt + 1] in "!?":
            yield "text", _html.unescape(page[at:lt]), ""
            at = page.find(">", lt) + 1 or end
            continue
        closing = page[lt + 1] == "/"
        m = _OPENS.match(page, lt + 1 + closing)
        if not m:
            yield "text", _html.unescape(page[at : lt + 1]), ""
            at = lt + 1
            continue
        yield "text", _html.unescape(page[at:lt]), ""
        at = _tag_end(page, m.end())
        if at < 0:
            return
        name = m[0].lower()
        if closing:
            yield "close", name, ""
            continue
        rest = page[m.end() : at - 1]
        if name in _RAW:
            if name not in ("title", "svg", "script", "style", "template"):
                yield "text", " ", ""
            if rest.endswith("/"):
                continue
            close = None if name in missing else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if close:
                at = page.find(">", close.end()) + 1 or end
            elif name in _TO_THE_END:
                return
            else:
                missing.add(name)
            continue
        yield "open", name, rest


def read(page: str) -> tuple[list[tuple[int, str, int, str, bool, bool]], list[tuple[int, str]]]:
    """Elements (parent, tag, hash of the path of tags and names, role, whether hidden, whether its name is noise) and blocks (element, text) of a page in order.

    The first element stands for the page. Inline elements add nothing; numbers in names do not count.
    """
    nodes: list[tuple[int, str, int, str, bool, bool]] = [(-1, "", 0, "", False, False)]
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    held: dict[str, int] = {}
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((stack[-1][1], text))

    def pop() -> str:
        tag = stack.pop()[0]
        held[tag] -= 1
        return tag

    for kind, name, rest in _tags(page):
        if kind == "text":
            parts.append(name)
            continue
        if name in _INLINE:
            continue
        flush()
        if kind == "close":
            if held.get(name):
                while pop() != name:
                    pass
            continue
        if name in _VOID:
            continue
        while len(stack) > 1 and stack[-1][0] in _OPEN_ENDS.get(name, ()):
            pop()
        if stack[-1][0] == "p":
            pop()
        given = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest else {}
        names = sorted(f"{given.get('id', '')} {given.get('class', '')}".split())
        role = given.get("role", "").lower()
        outer = name in ("html", "body")
        hidden = role in _ROLES or (not outer and ("hidden" in given or given.get("aria-hidden", "").lower() == "true"))
        above = stack[-1][1]
        path = block_hash(f"{nodes[above][2]}/{name}", " ".join(_NUMBER.sub("#", x) for x in names))
        stack.append((name, len(nodes)))
        held[name] = held.get(name, 0) + 1
        nodes.append((above, name, path, role, hidden, not outer and any(map(named_noise, names))))
    flush()
    return nodes, found


def blocks(page: str) -> Iterator[tuple[int, str, str, bool]]:
    """The blocks of a page in order: (hash of the element's path, text, fixed importance '0', '1' or '', whether a main element holds it).

    An element is noise by its tag, role or name. By its name alone it is not where it holds the only main elements of the page; those count within a form as well. A form is not
    noise where it holds all paragraphs of a page without main elements: then it wraps the page. How much text it holds doesn't matter.
    """
    nodes, found = read(page)
    yield from ((nodes[i][2], text, *state) for (i, text), state in zip(found, _states(nodes, found), strict=True))


def _states(nodes: list, found: list) -> list[tuple[str, bool]]:
    n = len(nodes)
    # What each element holds: main elements that are not noise themselves, and paragraphs with text outside of other noise.
    mains, paragraphs, barred = [0] * n, [0] * n, [False] * n
    texts = [False] * n
    for i, _ in found:
        texts[i] = True
    for i, (above, tag, _, role, hidden, named) in enumerate(nodes[1:], 1):
        soft = (named or tag == "form") and not hidden
        hard = hidden or (tag in _ASIDE and tag != "form")
        barred[i] = barred[above] or hard or named
        mains[i] = int((tag in _MAIN or role in ("main", "article")) and not hard and not soft)
        paragraphs[i] = int(tag in _HEADINGS and texts[i] and not barred[i])
    for i in range(n - 1, 0, -1):
        mains[nodes[i][0]] += mains[i]
        paragraphs[nodes[i][0]] += paragraphs[i]
    state: list[tuple[str, bool]] = [("", False)]
    spared = [False] * n  # within a form around the only main elements: those count, the rest doesn't
    for i, (above, tag, _, role, hidden, named) in enumerate(nodes[1:], 1):
        fixed, main = state[above]
        wraps = mains[i] == mains[0] > 0 and tag not in _MAIN
        worthless = hidden or (named and not wraps)
        form = tag == "form" and not (mains[0] == 0 and paragraphs[i] == paragraphs[0] > 0)
        spared[i] = spared[above] or (tag == "form" and wraps)
        is_main = tag in _MAIN or role in ("main", "article")
        if is_main and not worthless and (fixed != "0" or spared[i] or nodes[above][1] in ("form", "nav", "header")):
            fixed, main = "1", True
        elif fixed != "0" and (worthless or form or (tag in _ASIDE and tag != "form" and not (tag == "header" and main))):
            fixed = "0"
        state.append((fixed, main))
    return [state[i] for i, _ in found]


def extract(page: str | None, low: Set[int], repeated: Set[int] = frozenset()) -> str:
    """The main text: all blocks that stand in no low element and are not repeated ones."""
    kept = [(path, text) for path, text, fixed, _ in blocks(page or "") if fixed != "0" and path not in low]
    return " ".join(text for path, text in kept if not repeated or block_hash(path, text) not in repeated)


def tree_rows(page: str | None) -> list[tuple[int, int, bool, bool, int, int]]:
    """(page, path, main, whole, a, b) of the open elements of one page; each distinct row once. Paths are hashes.

    Page is a digest of all its open blocks, so that copies have equal rows.

    Whole rows describe an element: a is its style, the digest of the tags its blocks and children show, and b its content, the
    digest of its own blocks. The others have a block of the element as a. Main tells whether a main element holds it.
    """
    nodes, found = read(page or "")
    texts: dict[int, list[str]] = {}
    styles: dict[int, list[str]] = {}
    inside: dict[int, bool] = {}
    shown: set[int] = {0}
    marks = []
    for (i, text), (fixed, main) in zip(found, _states(nodes, found), strict=True):
        if fixed == "0":
            continue
        path = nodes[i][2]
        texts.setdefault(path, []).append(text)
        inside[path] = inside.get(path, False) or main
        marks.append(f"{path}\n{text}")
        while i not in shown:  # each element shows its tag to its parent once
            shown.add(i)
            above = nodes[i][0]
            own = styles.setdefault(nodes[above][2], [])
            if not own or own[-1] != nodes[i][1]:
                own.append(nodes[i][1])
            i = above
    page_hash = block_hash("", "\n".join(marks))
    rows = [(page_hash, p, inside[p], True, zlib.crc32(" ".join(styles.get(p, [])).encode()), zlib.crc32(" ".join(t).encode())) for p, t in texts.items()]
    return rows + [(page_hash, p, inside[p], False, h, 0) for p, t in texts.items() for h in {block_hash(p, x) for x in t}]


def _cells(pages: DataFrame) -> DataFrame:
    """host, path, whole, a, b, main, n: the rows of all pages with the number of distinct pages that have them; blocks on fewer than three are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        for batch in slices(batches, 1):
            rows = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name := host(url):
                    rows += [(name, *r) for r in tree_rows(page)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "page", "path", "main", "whole", "a", "b"])

    rows = pages.select("url", "html").mapInArrow(run, "host string, page long, path long, main boolean, whole boolean, a long, b long")
    # One aggregation of all rows first; entropies and repeated blocks follow from its counts.
    counts = rows.distinct().groupBy("host", "path", "whole", "a", "b").agg(F.count("*").alias("n"), F.max("main").alias("main"))
    return cut(counts.where(F.col("whole") | (F.col("n") > 2)))


def _with_prior(importance: F.Column) -> F.Column:
    """The importance, raised where a main element holds it as if `PRIOR` more pages had shown full importance."""
    weight = F.when(F.col("main"), F.lit(PRIOR)).otherwise(0.0)
    return (F.col("n_pages") * importance + weight) / (F.col("n_pages") + weight)


def style_tree(cells: DataFrame) -> DataFrame:
    """host, path, n_pages, main, importance of every element that blocks stand in, over all pages."""
    cells = cells.where("whole").withColumnsRenamed({"a": "style", "b": "content"})
    total = cells.groupBy("host", "path").agg(F.sum("n").alias("n_pages"), F.max("main").alias("main"))

    def entropy(by: str) -> DataFrame:
        """Sum of k ln k over the groups of pages that share a style or content, and the number of groups."""
        k = cells.groupBy("host", "path", by).agg(F.sum("n").alias("k"))
        return k.groupBy("host", "path").agg(F.sum(F.col("k") * F.log("k")).alias(f"{by}_klnk"), F.count("*").alias(f"{by}_groups"))

    joined = total.join(entropy("style"), ["host", "path"]).join(entropy("content"), ["host", "path"])
    m = F.col("n_pages").cast("double")
    log_m = F.when(m > 1, F.log(m)).otherwise(1.0)
    # Styles: -sum p log_m p = (ln m - sum k ln k / m) / ln m. Contents: the mean over pages of 1 - log_m k.
    presentation = F.when(m > 1, (F.log(m) - F.col("style_klnk") / m) / log_m).otherwise(1.0)
    content = F.when(m > 1, 1 - F.col("content_klnk") / m / log_m).otherwise(1.0)
    weight = F.pow(F.lit(DECAY), F.col("style_groups").cast("double"))
    return joined.select("host", "path", "n_pages", "main", _with_prior((1 - weight) * presentation + weight * content).alias("importance"))


def main_texts(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    cells = _cells(pages)
    tree = cut(style_tree(cells).where(F.col("n_pages") >= min_pages))
    elements = tree.where(F.col("importance") < low).select("host", "path", F.lit(None).cast("long").alias("block"))
    shown = cells.where(~F.col("whole")).drop("main").join(tree.select("host", "path", "main", "n_pages"), ["host", "path"]).where(2 * F.col("n") > F.col("n_pages"))
    alone = _with_prior(1 - F.log("n") / F.log("n_pages"))
    noise = elements.unionByName(shown.where(alone < low).select("host", F.lit(None).cast("long").alias("path"), F.col("a").alias("block")))
    noise = cut(noise.groupBy("host").agg(F.collect_set("path").alias("low"), F.collect_set("block").alias("repeated")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            ids, urls, htmls, lows, repeats = (c.to_pylist() for c in batch.columns)
            texts = [extract(page, set(paths or ()), set(hashes or ())) for page, paths, hashes in zip(htmls, lows, repeats, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    name = F.lower(F.regexp_extract(F.col("url"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#\s]*@)?([^/?#\s:@]+)", 1))
    # Broadcast by bytes: a host's row holds as many paths as its templates have.
    held = noise.agg(F.sum(8 * (F.size("low") + F.size("repeated")))).first()[0] or 0
    joined = slim.join(F.broadcast(noise) if held <= MOST_BROADCAST else noise, name == F.col("host"), "left").select("page_id", "url", "html", "low", "repeated")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
