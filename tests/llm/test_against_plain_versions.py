"""Operators without SQL against plain recomputations of their own methods."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from terraloom.llm import html_main, mixing, near_dedup, packing, quality_rules, secret_scan, substring_dedup


def site(seed, n=40):
    """Pages of one host: a box that all show, a note that half show, a list of a few variants, and an article of their own; some pages twice."""
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    pages = []
    for i in range(n):
        parts = ['<div class="x7"><p>the same words on every page</p></div>']
        if i % 2:
            parts.append("<section><p>half of them have this</p></section>")
        parts.append(f'<ul class="q"><li>variant {i % 3}</li></ul>')
        parts.append(f"<article><p>{words(30)}</p><p>subscribe to this paper today</p></article>")
        if i % 4 == 0:
            parts.append(f"<div class='z'><p>{words(5)}</p></div>")
        pages.append((i, "https://one.example/a", "<html><body>" + "".join(parts) + "</body></html>"))
    return pages + [(n + i, u, h) for i, u, h in pages[:7]]


def test_style_tree_against_plain_entropies(spark):
    pages = site(1)
    rows = {r for _, _, h in pages for r in html_main.tree_rows(h)}
    styles, contents, main = defaultdict(list), defaultdict(list), defaultdict(bool)
    for _, path, inside, whole, a, b in rows:
        if whole:
            styles[path].append(a)
            contents[path].append(b)
            main[path] |= inside
    want = {}
    for path, seen in styles.items():
        m = len(seen)
        base = math.log(m) if m > 1 else 1.0
        presentation = -sum(k / m * math.log(k / m) / base for k in Counter(seen).values()) if m > 1 else 1.0
        content = sum(1 - math.log(Counter(contents[path])[c]) / base for c in contents[path]) / m if m > 1 else 1.0
        weight = html_main.DECAY ** len(set(seen))
        value = (1 - weight) * presentation + weight * content
        want[path] = (m * value + html_main.PRIOR) / (m + html_main.PRIOR) if main[path] else value
    cells = html_main._cells(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.path: (r.n_pages, r.importance) for r in html_main.style_tree(cells).collect()}
    assert {p: n for p, (n, _) in got.items()} == {p: len(v) for p, v in styles.items()}
    assert all(got[p][1] == pytest.approx(v, abs=1e-9) for p, v in want.items())
    out = {r.page_id: r.text for r in html_main.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert not any("same words" in t or "subscribe" in t for t in out.values()) and all("w" in t for t in out.values())


def plain_chunks(data):
    """Ends of the chunks of one text, byte by byte."""
    value = []
    for i in range(len(data)):
        h = sum(int(substring_dedup._GEAR[data[i - k]]) << k for k in range(min(i + 1, substring_dedup._WINDOW)))
        # Before its start a text has zero bytes, which the hash counts as well.
        h += sum(int(substring_dedup._GEAR[0]) << k for k in range(min(i + 1, substring_dedup._WINDOW), substring_dedup._WINDOW))
        inside = i + 1 < len(data) and data[i + 1] & 0xC0 == 0x80
        value.append(0 if inside else max(1, h % (1 << 32)))
    reach, ends = substring_dedup.REACH, set()
    at = lambda i: value[i] if 0 <= i < len(value) else 0
    for i, v in enumerate(value):
        if all(v > at(j) for j in range(i - reach, i)) and all(v >= at(j) for j in range(i + 1, i + reach + 1)):
            ends.add(i + 1)
    return sorted(ends | {len(data)})


def test_chunks_and_passages_against_a_plain_version(make_docs):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 8))) for _ in range(n))
    shared = [text(60), text(90)]
    rows = [(i, f"{text(20)} {rng.choice(shared)} {text(15)}") for i in range(1, 14)] + [(20, text(40)), (21, None), (22, ""), (23, shared[0] + " " + shared[0])]
    held = {}
    for d, t in rows:
        data = (t or "").encode()
        if data:
            ends = plain_chunks(data)
            got, _ = substring_dedup.chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            assert got.tolist() == ends
            held[d] = [(a, data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    first = {}
    for d in sorted(held):
        for k, (_, c) in enumerate(held[d]):
            first.setdefault(c, (d, k))
    want = set()
    for d, chunks in held.items():
        run = []
        for k, (a, c) in [*enumerate(chunks), (-1, (0, b""))]:
            if k >= 0 and first[c] != (d, k):
                run.append((a, a + len(c), first[c][0]))
            else:
                if run and run[-1][1] - run[0][0] >= substring_dedup.MIN_BYTES:
                    want.add((d, run[0][0], run[-1][1], len(run), min(f for _, _, f in run)))
                run = []
    assert {tuple(r) for r in substring_dedup.repeated_passages(make_docs(rows)).collect()} == want and len(want) > 5


def test_chosen_cutoffs_against_exact_binomials(spark):
    rng = random.Random(2)
    rows = [(i, "en", 100, rng.choice([10, 10, 10, 11]), 100 * rng.choice([3, 4, 5, 6, 7, 60]), rng.choice([0, 0, 0, 0, 0, 9, 45]), 0, rng.choice([0, 0, 0, 12]), False) for i in range(2500)]
    metrics = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, n_lines long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(2500)], "doc_id long, quality int")
    got = quality_rules.calibrate(metrics, labels).first().asDict()
    scores = {"symbol_share": lambda r: r[5] / r[4], "dup_line_share": lambda r: r[6] / r[3], "repeat_share": lambda r: r[7] / r[2], "word_length": lambda r: r[4] / r[2], "shortness": lambda r: r[2] / r[4]}
    good = [r for r in rows if r[0] % 5]
    n, risk = len(good), 0.02 / len(quality_rules.RULES)
    tests = sum(map(len, quality_rules.RULES.values()))

    def tail(k):
        return 1.0 if k >= n * risk else sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))

    for rule, cutoffs in quality_rules.RULES.items():
        valid = [c for c in cutoffs if tail(sum(scores[rule](r) > c for r in good)) <= 0.05 / tests]
        assert got[f"cut_{rule}"] == (min(valid) if valid else None)


def test_pipeline_against_its_operators(spark, sf):
    """Each stage on its own input: what it keeps, drops and changes follows from its operator's decisions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = steps["quality rules"](spark, docs, sf).cache()
    verdict = {r.doc_id: r.kept for r in quality_rules.score(docs, labels).collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept) == sorted(d for d, k in verdict.items() if k)
    distinct = steps["near-duplicates"](spark, kept, sf).cache()
    groups = near_dedup.near_duplicates(kept, shingle=5, percent=80).collect()
    assert ids(distinct) == sorted({r.component_id for r in groups})
    clean = steps["secret scan"](spark, distinct, sf).cache()
    model, words = secret_scan.train(distinct, "source")
    masked = {r.doc_id: sum(f.secret for f in r.found) for r in secret_scan.scan(distinct, model, words, "source").select("row.doc_id", "found").collect()}
    before = {r.doc_id: r.text for r in distinct.collect()}
    assert ids(clean) == ids(distinct)
    assert all(r.text.count("[SECRET]") - before[r.doc_id].count("[SECRET]") == masked[r.doc_id] for r in clean.collect())
    mixed = steps["source mixing"](spark, clean, sf).cache()
    plan = {r.doc_id: r.taken for r in mixing.mix(clean, mixing.label_weights(labels)).collect()}
    sizes = defaultdict(int)
    for r in mixed.collect():
        sizes[r.doc_id] += len([w for w in r.text.split() if w]) if r.text.isascii() else 0
    ascii_ids = {r.doc_id for r in clean.collect() if r.text.isascii()}
    assert all(sizes.get(d, 0) == plan[d] for d in ascii_ids) and set(ids(mixed)) == {d for d, t in plan.items() if t}
    packed = steps["packing"](spark, mixed, sf)
    assert packed.select("sequence_id").distinct().count() > 1
    assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in packing.pack_documents(mixed).where("start = 0").collect())
