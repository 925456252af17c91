"""Operator 13 against plain counts."""

import re
from collections import Counter

import numpy as np

from terraloom.llm import collocations


def plain(rows, least=30, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        if text is None:
            continue
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(100 * f[q] >= 80 * a for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_made_up_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        lang = [None, "en", "fr", "", "und"][i % 5]
        picked = [["New", "york", "city", "of", "the", "a", "é", "日本", "x'y", "new"][int(x)] for x in rng.zipf(1.4, 60) % 10]
        seps = [[" ", "\t", "  ", ". ", ",", "\n", " \v", "? "][int(x)] for x in rng.integers(0, 20, 60) * (rng.random(60) < 0.3) % 8]
        rows.append((lang, "".join(a + b for a, b in zip(picked, seps))))
    rows += [("en", None), ("en", ""), (None, " . , "), ("de", "ein wort"), ("en", "very long text piece " * 2000), ("en", "very long text piece " * 2000)]
    docs = spark.createDataFrame([(t, lang, 1) for lang, t in rows], "text string, lang string, f int").repartition(3)
    for shard in (collocations.SHARD, 2000):
        got = collocations.Phrases(docs, shard=shard).ranked()
        assert sorted(tuple(r) for r in got.collect()) == plain(rows)
    assert sorted(tuple(r) for r in collocations.Phrases(docs).ranked(top=3).collect()) == plain(rows, top=3)


def test_whole_corpus_and_empty(spark, sf, odd, make_docs):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in collocations.op13_collocations(spark, sf).collect()) == plain(rows)
    assert collocations.Phrases(make_docs([])).ranked().count() == 0
    assert collocations.Phrases(odd).ranked().count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 2**62, 2**62 + 12345, 2**63 - 1
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 2_000_000 * a // (l + r)


def test_index_steps():
    """Intervals of both directions against counted phrases."""
    rng = np.random.default_rng(4)
    t = np.concatenate([[0], rng.integers(0, 4, 400), [0]])
    forward, backward = collocations.Index(collocations.transform(t)), collocations.Index(collocations.transform(t[::-1]))
    size = np.bincount(t)
    lo = np.cumsum(size) - size
    state = [((w,), lo[w], lo[w], size[w]) for w in (1, 2, 3)]
    for depth in (2, 3, 4):
        near, far, n = (np.array([s[i] for s in state]) for i in ((1, 2, 3) if depth % 2 == 0 else (2, 1, 3)))
        which, new, count, other = (forward if depth % 2 == 0 else backward).extend(near, n, far)
        found = []
        for w, a, c, b in zip(which, new, count, other):
            if depth % 2 == 0:
                symbol = int(np.searchsorted(np.cumsum(size), a, "right"))
                found.append(((symbol, *state[w][0]), a, b, c))
            else:
                symbol = int(np.searchsorted(np.cumsum(size), a, "right"))
                found.append(((*state[w][0], symbol), b, a, c))
        state = found
        want = {}
        for i in range(len(t) - depth + 1):
            p = tuple(int(x) for x in t[i : i + depth])
            if 0 not in p:
                want[p] = want.get(p, 0) + 1
        assert {s[0]: int(s[3]) for s in state} == want
