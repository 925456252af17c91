import random
import re

import pytest

from terraloom.llm import near_dedup


def brute(rows, k, percent):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    comp = list(range(len(sets)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i))) for i, (d, s) in enumerate(sets)), key=repr)


def copies(seed, n=120, words=150, most=8):
    """A group of near copies with chains of edits, some beyond the threshold, and texts that share a passage."""
    rng = random.Random(seed)
    made = [[f"v{rng.randrange(500)}" for _ in range(words)]]
    for _ in range(n):
        text = list(rng.choice(made[: 1 + len(made) // 3]))
        for _ in range(rng.randint(1, most)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(5000)}"
        made.append(text)
    made += [[f"u{rng.randrange(900)}" for _ in range(100)] + made[0][:60] for _ in range(20)]
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(made)]


@pytest.mark.parametrize(("k", "percent", "large"), [(3, 85, 4), (3, 85, 16), (5, 80, 4)])
def test_matches_brute_force(make_docs, k, percent, large):
    rows = copies(k + large)
    out = near_dedup.near_duplicates(make_docs(rows), shingle=k, percent=percent, large=large).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_odd_rows(odd, make_docs):
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == 8
    empty = [r for r in out if r.n_shingles == 0]
    assert sorted(r.doc_id for r in empty) == [1, 2, 6] and all(r.kept for r in empty)
    assert [r.component_id for r in out if r.doc_id == 4] == [4, 4]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
    short = make_docs([(1, "A b"), (2, "a  B"), (3, "a"), (4, "b a"), (None, "a b")])
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(short).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, 1)}


def test_one_of_each_group_stays(make_docs):
    rows = copies(5, n=30, most=2)
    docs = make_docs(rows)
    kept = near_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(rows, 5, 80)}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r.node: r.comp for r in near_dedup.components(links).collect()}
    assert all(out[i] == 0 for i in range(1, 41)) and out[101] == 100


def test_whole_documents_table_against_brute_force(spark):
    """All of sf0.01: every set size and component, so no link is lost (recall 1) and none is made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, percent in ((3, 85), (5, 80)):
        out = near_dedup.near_duplicates(docs, shingle=k, percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, k, percent)


def test_rounds_end_with_few_hubs(make_docs):
    rows = copies(11, n=60, most=12)
    out = near_dedup.near_duplicates(make_docs(rows), hubs=1, large=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, 3, 85)


def test_clashing_columns_repeated_ids_and_intermediates(spark, make_docs):
    docs = make_docs([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)])
    for name in ("id", "_id", "row", "node", "kept", "component_id", "bands"):
        docs = docs.selectExpr("*", f"1 AS {name}")
    out = near_dedup.distinct_documents(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 1, 3]
    import pathlib

    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    assert not list(shared.glob("scratch-*"))
