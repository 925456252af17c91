"""Personal data by candidates, boosted trees and calibrated thresholds (operator 4).

Format rules give the base spans of the kinds email, ip, card and phone, leftmost and non-overlapping for
each kind; a match that fails its check is dropped without another try. High-recall generators propose
more spans, which may overlap: written-out addresses, number groups without a plus sign, digit groups. Gradient-boosted
trees score them from format and context features, and those above the threshold of their kind, best first
and free of overlap with what is chosen, join the base spans.

Training rows are candidates that a rule is sure of, at most `MOST_LABELLED` of all documents in the order
of a hash, and constructed ones, so that every kind has examples. A third of the rows is held out of the
trees; a kind's threshold is the least score from which its held-out precision stays at `PRECISION` or more
(none: nothing is added for that kind).

Defined cases: null and empty texts have no spans; repeated rows are searched one by one; an empty table trains on
the constructed rows and gives an empty result; a very long text is one unit of work, its spans kept in sorted lists; candidates
of equal score are chosen by start; extra columns are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import bounded_sample, cut, slices, table

KINDS = ("email", "ip", "card", "phone")
MOST_LABELLED = 6000
PRECISION = 0.98

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends where its digits end, so it can only start where digits start: the look-behind changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# An address is taken from its separator; a bare "at" needs its blanks, which it leaves to its neighbours.
_AT = re.compile(r"@|[(\[]\x20?(?:at|@)\x20?[)\]]|at(?<=\x20at)(?=\x20)")
_MOST_LOCAL = 64
_WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[]\x20?dot\x20?[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63})+")
_WIDE = {
    "phone": re.compile(r"(?<![0-9+])[(0-9][\x20().0-9/-]{5,22}[0-9](?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.\x20]{1,2}[0-9]{1,3}){3}(?![0-9])"),
}
_WORDS = {
    "email": re.compile(r"(?i)mail|contact|write|@|reply|address"),
    "phone": re.compile(r"(?i)phone|call|tel\b|tel[.:]|mobile|fax|cell|ring|dial|contact"),
    "card": re.compile(r"(?i)card|visa|master|credit|debit|pan\b|account"),
    "ip": re.compile(r"(?i)\bip\b|host|server|addr|ping|from"),
}
_AGAINST = re.compile(r"(?i)version|order|price|total|page|isbn|invoice|date|\bv\.?$|\bno\.?\s?$|#\s?$|[$€£%]\s?$|year|art\.|section|figure")
NAMES = ["kind", "length", "digits", "digit_share", "groups", "longest_group", "spread", "luhn", "octets", "at_sign", "written_at", "brackets", "dashes", "dots", "blanks", "zero_first", "named", "against", "letter_before", "letter_after"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by start, then kind as listed."""
    found: list[tuple[str, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > last and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                found.append(("email", start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub(r"[\x20-]", "", m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of all kinds; they may overlap."""
    out = []
    for kind, pattern in _WIDE.items():
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    if "@" in text or re.search(r"[\x20(\[]at[\x20)\]]", text):
        # Each separator proposes the address that spans it, whatever stands before.
        for m in _AT.finditer(text):
            start, after = m.span()
            if m[0] != "@":
                start, after = start - (text[start - 1 : start] == " "), after + (text[after : after + 1] == " ")
            if e := _WRITTEN_DOMAIN.match(text, after):
                low, stop = max(0, start - _MOST_LOCAL), start
                while start > low and _LOCAL.match(text, start - 1):
                    start -= 1
                if start < stop:
                    out.append(("email", start, e.end()))
    return sorted(set(out))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before = text[start:end], text[max(0, start - 40) : start]
    digits = re.sub(r"[^0-9]", "", s)
    groups = re.findall(r"[0-9]+", s)
    lengths = [len(g) for g in groups] or [0]
    octets = sum(len(g) <= 3 and int(g) <= 255 for g in groups)
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), len(digits) / len(s), float(len(groups)), float(max(lengths)), float(max(lengths) - min(lengths)),
        float(len(digits) >= 12 and luhn(digits)), float(octets == 4 and len(groups) == 4), float("@" in s), float(bool(re.search(r"\bat\b", s))), float(s.count("(") + s.count(")")),
        float(s.count("-")), float(s.count(".")), float(s.count(" ")), float(digits[:1] == "0"), float(bool(_WORDS[kind].search(before))), float(bool(_AGAINST.search(before))),
        float(before[-1:].isalpha()), float(text[end : end + 1].isalpha()),
    ]


def distant_label(text: str, kind: str, start: int, end: int, base: list[tuple[str, int, int]]) -> int | None:
    """1 if the span is a base span of its kind, 0 if it lies on one of another kind or breaks its own format, else None."""
    if (kind, start, end) in base:
        return 1
    if any(a < end and start < b and k != kind for k, a, b in base):
        return 0
    s = text[start:end]
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "card":
        return None if luhn(digits) else 0
    if kind == "phone" and (len(digits) > 15 or len(digits) < 7 or "  " in s):
        return 0
    if kind == "ip" and " " in s:
        return 0
    return None


def constructed(n: int = 60, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of made-up sentences, `n` for each form: personal data of every kind, and numbers and phrases of the same shapes that are none.

    What a span is follows from what was written, not from its features: forms, words around and values are drawn independently.
    """
    rng = random.Random(seed)
    rows, labels = [], []
    digits = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    lead = lambda k: str(rng.randrange(1, 10)) + digits(k - 1)
    filler = ("the field was dry", "we met in spring", "y luego", "und dann", "et puis", "as agreed", "harvest report", "thanks", "", "see below", "-", "|")
    name = lambda: rng.choice(("ann", "bob", "user", "info", "j.smith", "maria")) + rng.choice(("", digits(2), f".{rng.choice('abc')}"))
    host = lambda: rng.choice(("mail", "host", "farm", "office")) + rng.choice(("", digits(1), "-shop"))
    tld = lambda: rng.choice(("org", "net", "com", "de"))

    def checked(number: str, want: bool) -> str:
        return number + next(str(d) for d in range(10) if luhn(number + str(d)) == want)

    def spaced(number: str) -> str:
        by = rng.choice(("", " ", "-"))
        return by.join(number[i : i + 4] for i in range(0, len(number), 4))

    phones = (lambda: f"({lead(3)}) {lead(3)}-{digits(4)}", lambda: f"{lead(3)}-{lead(3)}-{digits(4)}", lambda: f"0{lead(3)} {lead(3)} {digits(4)}", lambda: f"0{lead(2)}/{lead(3)} {digits(3)} {digits(2)}", lambda: f"{lead(3)}.{digits(3)}.{digits(4)}")
    written = (lambda: f"{name()} at {host()} dot {tld()}", lambda: f"{name()} [at] {host()}.{tld()}", lambda: f"{name()}(at){host()}.{tld()}", lambda: f"{name()} (at) {host()} [dot] {tld()}", lambda: f"{name()}@{host()}.{tld()}")
    forms = [
        ("phone", 1, phones, ("please call", "phone", "tel.", "mobile:", "ring me:", "contact us at", "fax")),
        ("phone", 0, phones, ("order", "invoice", "version", "total", "page", "section", "price")),
        ("phone", 0, (lambda: f"20{digits(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{lead(2)}.{digits(2)}.{digits(3)}", lambda: lead(rng.randint(7, 18)), lambda: f"{lead(1)} {digits(3)} {digits(3)} {digits(3)}", lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.20{digits(2)}", lambda: f"{lead(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"), ("on", "the", "of", "date", "isbn", "about", "year", "version", "the price is")),
        ("email", 1, written, ("write to", "mail", "contact", "reply to", "my address is", "ask")),
        ("email", 0, (lambda: f"look at this dot com{digits(1)}", lambda: f"aim at {digits(2)}.{digits(1)}", lambda: f"arrive at noon.the next", lambda: f"prices at {lead(2)}.{digits(2)}", lambda: f"meet at gate.{digits(1)}"), ("we", "they", "please", "then", "soon we")),
        ("ip", 1, (lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),), ("server", "host", "from", "ping", "address", "ip", "logged in as root,")),
        ("ip", 0, (lambda: " ".join(str(rng.randrange(256)) for _ in range(4)), lambda: f"{rng.randrange(9)}.{rng.randrange(99)}. {rng.randrange(99)}.{rng.randrange(300, 999)}"), ("scores", "sizes", "rows", "chapter", "the")),
        ("card", 1, (lambda: spaced(checked(rng.choice("3456") + digits(14), True)),), ("card", "visa", "charged to", "credit card no.", "pan", "account", "paid with")),
        ("card", 0, (lambda: spaced(checked(lead(rng.randint(11, 18)), False)),), ("card", "order", "isbn", "the", "tracking", "account", "total")),
    ]
    for kind, label, makers, words in forms:
        for make in makers:
            for i in range(n):
                value, before = make(), rng.choice(words)
                text = f"{rng.choice(filler)} {before} {value} {rng.choice(filler)}"
                at = text.index(value, text.index(f"{before} {value}"))
                rows.append(features(text, kind, at, at + len(value)))
                labels.append(label)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return np.array([rows[i] for i in order]), np.array([labels[i] for i in order], float)


@dataclass
class Boosted:
    """Gradient-boosted regression trees for the logistic loss, of fixed depth, over quantile bins."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0
    depth: int = 3
    thresholds: dict[str, float] = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.2, ridge: float = 1.0) -> "Boosted":
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        width = max(map(len, cuts)) + 1
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            feature, value = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for d in range(self.depth):
                for k in range(2**d):
                    own = node == k
                    if own.sum() < 8:
                        continue
                    g0, h0, best = grad[own].sum(), hess[own].sum(), 1e-6
                    for j, c in enumerate(cuts):
                        if len(c):
                            g = np.cumsum(np.bincount(bins[own, j], grad[own], width))[: len(c)]
                            h = np.cumsum(np.bincount(bins[own, j], hess[own], width))[: len(c)]
                            gain = g**2 / (h + ridge) + (g0 - g) ** 2 / (h0 - h + ridge) - g0**2 / (h0 + ridge)
                            if gain.max() > best:
                                best = gain.max()
                                feature[2**d - 1 + k], value[2**d - 1 + k] = j, c[int(gain.argmax())]
                node = 2 * node + (x[np.arange(len(y)), feature[2**d - 1 + node]] > value[2**d - 1 + node])
            size = 2**self.depth
            leaf = rate * np.bincount(node, grad, size) / (np.bincount(node, hess, size) + ridge)
            raw += leaf[node]
            self.trees.append((feature, value, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, every = np.full(len(x), self.bias), np.arange(len(x))
        for feature, value, leaf in self.trees:
            node = np.zeros(len(x), int)
            for d in range(self.depth):
                node = 2 * node + (x[every, feature[2**d - 1 + node]] > value[2**d - 1 + node])
            raw += leaf[node]
        return 1 / (1 + np.exp(-raw))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> "Boosted":
        """A threshold for each kind from rows that the trees have not seen."""
        p = self.score(x)
        for i, kind in enumerate(KINDS):
            own = x[:, 0] == i
            order = np.argsort(-p[own], kind="stable")
            good = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1) if own.any() else np.zeros(0)
            fine = np.flatnonzero(good >= precision)
            self.thresholds[kind] = max(0.5, float(p[own][order][fine[-1]])) if len(fine) else float("inf")
        return self


def train(docs: DataFrame, most: int = MOST_LABELLED) -> Boosted:
    """Fit and calibrate on a bounded sample of distantly labelled candidates and on constructed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches, 0):
            rows: list[list[float]] = []
            labels: list[int] = []
            for text in texts.column(0).to_pylist():
                if spans := candidates(text):
                    base = base_spans(text)
                    for s in spans:
                        if (y := distant_label(text, *s, base)) is not None:
                            rows.append(features(text, *s))
                            labels.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], ["x", "y"])

    found = docs.where(F.col("text").rlike("[0-9@]| at ")).select("text").mapInArrow(run, "x array<double>, y int")
    kept = bounded_sample(cut(found.distinct()), F.xxhash64("x", "y"), most).collect()
    x, y = constructed()
    if kept:
        kept = sorted((tuple(r.x), r.y) for r in kept)
        x, y = np.concatenate([x, np.array([r[0] for r in kept])]), np.concatenate([y, np.array([r[1] for r in kept], float)])
    held = np.arange(len(y)) % 3 == 0
    return Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])


def all_spans(text: str, model: Boosted, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Base spans and the chosen candidates, by start, then kind."""
    chosen = list(base if base is not None else base_spans(text))
    # Base spans of different kinds may overlap; their union is a sorted list of disjoint stretches, which chosen candidates join one by one.
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in chosen):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b, 0))
        return not i or taken[i - 1][1] <= a

    if spans := [s for s in candidates(text) if free(s[1], s[2])]:
        p = model.score(np.array([features(text, *s) for s in spans]))
        for i in np.argsort(-p, kind="stable"):
            kind, a, b = spans[i]
            if p[i] >= model.thresholds[kind] and free(a, b):
                chosen.append(spans[i])
                insort(taken, (a, b))
    return sorted(chosen, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, and redacted (the text without personal data), for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"]
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in slices(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                spans = all_spans(text, model, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(join(base).encode()).hexdigest(), join(spans), redact(text, spans)))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string, redacted string")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs)).drop("redacted")
