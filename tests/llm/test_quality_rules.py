import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from terraloom.llm import quality_rules as qr


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_metrics_match_brute_force(make_docs, odd):
    rng = random.Random(9)
    texts = [None, "", "a b c d e f g h", "a b c d e f g h " * 3, "x\nx\n x\n\n\nx\r\nx", "a # $ <b> |", "x " * 30, "日本 é 😀 " * 9, "one\x0btwo\x0cthree\x85four five"]
    for _ in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randint(5, 60))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
    docs = make_docs(list(enumerate(texts)))
    for r in qr.with_metrics(docs).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert qr.with_metrics(odd).count() == 8


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.3), (3, 40, 0.2), (20, 1000, 0.03), (5, 5, 0.5), (299, 3000, 0.1)])
def test_binomial_tail_is_exact(spark, k, n, p):
    got = spark.range(1).select(qr.binomial_tail(F.lit(k), F.lit(n), F.lit(p))).first()[0]
    want = 1.0 if k >= n * p else float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_control_the_risk(spark, make_docs):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(["grain", "field", "river", "season"]) + str(rng.randrange(999)) for _ in range(40))) for i in range(3000)]
    bad = [(i, " ".join("#$%" + str(rng.randrange(999)) for _ in range(40))) for i in range(3000, 3300)]
    docs = make_docs(good + bad)
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in range(0, 3300)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in qr.score(docs, labels).collect()}
    assert sum(not out[i] for i in range(3000)) <= 0.02 * 3000
    assert not any(out[i] for i in range(3000, 3300))
    kept = qr.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in out.items() if k}
    none = qr.score(docs, labels.limit(0)).where("NOT kept").count()
    assert none == 0


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (5, None, None), (None, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in qr.score(odd, labels).collect() if r.kept} == {5}
    assert [r.doc_id for r in qr.filter_documents(odd, labels).collect()] == [5]
    assert qr.score(odd.limit(0), labels).count() == 0
    clash = odd.withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "row": F.lit(2)})
    assert qr.filter_documents(clash, labels).columns == clash.columns
