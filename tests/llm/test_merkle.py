"""Operator 12 against a plain tree, and its addresses against a recursive layout."""

import hashlib
import zlib

import numpy as np
import pytest

from terraloom.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(leaves):
    """The levels of a plain tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels, place):
    for level in levels[:-1]:
        first = place - place % 3
        yield level[first:place], level[place + 1 : first + 3]
        place //= 3


def plain(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, held = {}, {}
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        held[s] = own
        trees[s] = tree([leaf_of(r, r["text"]) for r in own])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for j, r in enumerate(held[s]):
            steps = [*walk(trees[s], j), *walk(top, i)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            text = r["text"].replace("\n", "") if hit and r["text"] is not None else r["text"]
            folded = leaf_of(r, text)
            for before, after in steps:
                folded = digest(*before, folded, *after)
            out.append((r["doc_id"], trees[s][0][j], trees[s][-1][0], top[-1][0], digest(*[x for b, a in steps for x in [*b, *a]]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    got = merkle.Manifest(docs, merkle.tampered_leaf()).proofs()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("height", [7, 2])
def test_made_up_sources(spark, make_docs, odd, height, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "SPAN", 3**height)
    sizes = {"a": 1, "b": 2, "c": 3, "hot": 130 if height == 2 else 40, None: 10, "": 4, "zé": 9}
    rows = [(i * 7 % 1000, f"text {i}\nline" if i % 3 else None, s) for s, n in sizes.items() for i in range(n)]
    docs = make_docs(rows).unionByName(odd)
    if height == 7:
        check(spark, docs)
    else:  # functions are shipped with their module's own values, so blocks of two levels are built here
        for n in (1, 2, 9, 10, 27, 82, 130):
            leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
            level, top = leaves, tree([x.hex() for x in leaves])
            while len(level) > 1:
                roots = []
                for i in range(0, len(level), 9):
                    levels = merkle._levels_for(len(level))
                    nodes = merkle.build_block(level[i : i + 9], levels)
                    block = merkle.Block(nodes, len(level[i : i + 9]), levels)
                    for j, x in enumerate(level[i : i + 9]):
                        assert merkle.fold(x, block.path(j)) == nodes[:32]
                    roots.append(nodes[:32])
                level = roots
            assert level[0].hex() == top[-1][0]


def test_several_levels_of_blocks(spark, make_docs):
    rows = [(i, f"t{i}\n", "hot" if i % 5 else f"s{i % 40}") for i in range(6000)]
    check(spark, make_docs(rows))


def test_whole_corpus_and_empty(spark, sf, make_docs):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    assert merkle.Manifest(make_docs([])).proofs().count() == 0


def test_layout():
    def order(levels):
        """Nodes (depth, place) in van Emde Boas order, by recursion."""
        if levels == 1:
            return [(0, 0)]
        upper = levels // 2
        out = order(upper)
        for i in range(3**upper):
            out += [(upper + d, i * 3**d + p) for d, p in order(levels - upper)]
        return out

    for levels in range(1, 8):
        nodes = order(levels)
        assert len(nodes) == merkle.subtree_size(levels)
        for depth in range(levels):
            want = [nodes.index((depth, p)) for p in range(min(3**depth, 50))]
            assert merkle.slots(depth, np.arange(len(want)), levels).tolist() == want
