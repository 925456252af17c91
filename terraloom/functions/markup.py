"""Plain text of markup, in one pass over a page."""

from __future__ import annotations

import html
import re

#: Elements whose text is no text of the page.
UNSEEN = frozenset({"script", "style", "nav", "footer", "header", "aside", "noscript"})
#: Elements whose content is no markup: it ends at their own end tag alone.
RAW = ("script", "style")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r">|=\s*[\"']")


def end_of_tag(page: str, at: int) -> int:
    """The place after the > of a tag that began before `at`, quoted values aside; -1 if the page ends first."""
    while m := _QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(m[0][-1], m.end())
        if close < 0:
            break
        at = close + 1
    return -1


def visible(page: str) -> str:
    """The text outside of `UNSEEN` elements, pieces between tags joined by single blanks. A tag or comment that never ends hides the rest.

    Unclosed elements hide what follows them; an end tag without a start tag is ignored. The time is linear in the page.
    """
    kept: list[str] = []
    depth = at = 0
    while at < len(page):
        lt = page.find("<", at)
        lt = len(page) if lt < 0 else lt
        if depth == 0 and lt > at:
            kept.append(page[at:lt])
        tag = _NAME.match(page, lt + 1)
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 4) + 3
            if at < 3:
                break
        elif tag:
            at = end_of_tag(page, tag.end())
            if at < 0:
                break
            name = tag[0].lower()
            if name.lstrip("/") in UNSEEN:
                depth = max(0, depth - 1) if name[0] == "/" else depth + 1
            if name in RAW:
                close = re.compile(f"</{name}", re.I).search(page, at)
                if close is None:
                    break
                at = close.start()
        elif page.startswith(("<!", "<?", "</"), lt):
            at = page.find(">", lt) + 1
            if at == 0:
                break
        else:
            if depth == 0 and lt < len(page):
                kept.append("<")
            at = lt + 1
            continue
    return " ".join(html.unescape(_joined(kept)).split())


def _joined(parts: list[str]) -> str:
    """Pieces joined by blanks; a bare < belongs to what stands around it."""
    out: list[str] = []
    for p in parts:
        if out and p != "<" and out[-1] != "<":
            out.append(" ")
        out.append(p)
    return "".join(out)


def element(page: str, name: str) -> str | None:
    """The page from the first start of an element to the first end after it; null without either."""
    start = re.search(rf"<{name}(?=[\s/>])", page, re.I)
    end = start and re.compile(rf"</{name}\s*>", re.I).search(page, start.end())
    return page[start.start() : end.end()] if end else None


def main_text(page: str | None, least: int = 200) -> str:
    """The text of the first article element if it has over `least` characters, else of the first main element, else of all."""
    for name in ("article", "main"):
        part = element(page or "", name)
        if part is not None and len(text := visible(part)) > least:
            return text
    return visible(page or "")
