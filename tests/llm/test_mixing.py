from collections import defaultdict

import pytest

from terraloom.llm import mixing


def fill(sizes, weights=(1.0, 2.0, 3.0)):
    """Targets by repeated reshare, source by source."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


@pytest.mark.parametrize("counts", [{"a": 5, "b": 5, "c": 5}, {"a": 100, "b": 1, "c": 1, "d": 2}, {"a": 40, None: 3, "z": 1}, {"a": 0, "b": 7}])
def test_targets_and_taken(make_docs, counts):
    rows, i = [], 0
    for s, n in counts.items():
        for k in range(max(n, 1)):
            i += 1
            rows.append((i, " ".join(["w"] * (3 + k % 5)) if n else "", s))
    out = mixing.mix(make_docs(rows)).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
    want = fill(dict(sizes))
    taken = defaultdict(int)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = {(r.doc_id, r.taken) for r in mixing.mix(make_docs(rows)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_keys_and_weights(spark, make_docs):
    rows = [(i, "one two three", "a" if i < 400 else "b") for i in range(500)]
    quality = spark.createDataFrame([(i, 8.0 if i % 2 else 0.25) for i in range(500)], "doc_id long, weight double")
    out = [r for r in mixing.mix(make_docs(rows), quality, [1.0, 1.0]).collect() if r.source == "a"]
    odd, even = (sum(r.taken for r in out if r.doc_id % 2 == m) for m in (1, 0))
    assert odd > 1.3 * even


def test_odd_rows(odd):
    out = mixing.mix(odd).collect()
    assert len(out) == 8
    assert {r.size for r in out if r.doc_id in (1, 2, 6)} == {0}
    assert mixing.mix(odd.limit(0)).count() == 0


def test_documents_follow_the_plan(make_docs):
    docs = make_docs([(i, " ".join(f"w{k}" for k in range(4 + i % 3)), "a" if i < 30 else "b") for i in range(33)])
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    words = defaultdict(int)
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    for r in rows.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {k: r.taken for k, r in plan.items() if r.taken}
