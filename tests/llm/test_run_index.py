"""Operator 11 against a plain dictionary of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import run_index


def plain(rows, length=200):
    """(doc_id, bytes, removed, spans, digest) of every (doc_id, text)."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in texts for i in range(len(x) - length + 1))
    out = []
    for d, x in texts:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    removed = (F.col("n_bytes") - F.length("kept")).alias("n_removed")
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", removed, F.size("spans").alias("n"), F.sha2("kept", 256).alias("k")).collect()), key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeéß日"), rng.integers(1, 8))) for _ in range(n))


def made():
    rng = np.random.default_rng(5)
    shared, line = words(rng, 120), words(rng, 30)
    rows = [(i, words(rng, 80)) for i in range(30)]
    rows += [(100 + i, f"{words(rng, 30)} {shared} {words(rng, 25)}") for i in range(12)]
    rows += [(200 + i, f"{words(rng, 10)} {line[:150]}{words(rng, 60)}") for i in range(40)]  # too short alone, common to many
    rows += [(300 + i, f"{words(rng, 10)} {line}{words(rng, 60)}") for i in range(25)]
    base = words(rng, 300)
    for i in range(25):  # near copies
        at = int(rng.integers(0, len(base)))
        rows.append((400 + i, base[:at] + "X" + base[at + 1 :]))
    rows += [(500, base), (501, base), (501, base), (None, base), (502, shared + shared), (503, "a" * 1000), (504, "ab" * 700), (505, "b" + "a" * 300), (506, None), (507, ""), (508, "short")]
    return rows


@pytest.mark.parametrize(("most", "shard"), [(4000, 1 << 20), (3, 1 << 12)])
def test_made_up_texts(spark, make_docs, most, shard):
    rows = made()
    docs = make_docs(rows).select("doc_id", F.xxhash64("text").alias("key"), "text").repartition(3)
    spans = run_index.repeated_spans(docs, 200, most, shard)
    marked = {}
    for r in spans.collect():
        marked.setdefault((r["doc_id"], r["key"]), []).append((r["a"], r["b"]))
    want = plain(rows)
    got = []
    for r in docs.collect():
        x = (r["text"] or "").encode()
        gone = np.zeros(len(x), bool)
        for a, b in marked.get((r["doc_id"], r["key"]), []):
            assert 0 <= a < b <= len(x)
            gone[a:b] = True
        n = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        got.append((r["doc_id"], len(x), int(gone.sum()), n, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(got, key=repr) == want
    if most == 4000:
        assert found(run_index.without_repeats(make_docs(rows).withColumn("key", F.lit("x")).withColumn("h", F.lit(1)))) == want


def test_whole_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in run_index.op11_run_index(spark, sf).collect()), key=repr) == plain(rows)


def test_segments_and_empty(spark, make_docs, odd, monkeypatch):
    assert run_index.without_repeats(make_docs([])).count() == 0
    assert run_index.without_repeats(odd).count() == 8
    rng = np.random.default_rng(6)
    text = words(rng, 3000)
    rows = [(1, text), (2, words(rng, 50) + text[700:9000]), (3, words(rng, 20))]
    monkeypatch.setattr(run_index, "_SEGMENT", 1000)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in rows])])
    text_of, start, windows, off, times, h, g = run_index.snippets(data, at, 200)
    covered = [np.zeros(max(0, len(t.encode()) - 199), int) for _, t in rows]
    for t, s, w, n in zip(text_of, start, windows, times):
        covered[t][s : s + w * n] += 1
    assert all((c == 1).all() for c in covered)  # every window is in one snippet


def test_index():
    rng = np.random.default_rng(7)
    for text in (b"banana\xff", bytes(rng.integers(0, 3, 500, dtype=np.uint8)) + b"\xff", b"ab" * 200 + b"\xff", b"\0" * 40 + b"\xff\0\0\xff"):
        t = np.frombuffer(text, np.uint8)
        order = run_index.suffix_order(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: text[i:])
        index = run_index.RunIndex(t)
        assert int(index.sizes.sum()) == len(t)
        stats = run_index.matching_statistics(index, t, np.zeros(1, np.int64), len(t) + 1)
        for i in range(len(t)):
            best = 0
            while any(text[j : j + best + 1] == text[i : i + best + 1] and i + best < len(t) and j + best < len(t) for j in range(len(t)) if j != i):
                best += 1
            assert stats[i] == best
