import random

import numpy as np

from terraloom.llm import substring_dedup as sd


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_chunks_shift_with_insertions():
    rng = random.Random(3)
    body = text(rng, 400).encode()
    ends = lambda t: set(sd.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist())
    plain, moved = ends(body), ends(b"some words in front " + body)
    assert len({e + 20 for e in plain} & moved) >= len(plain) - 3


def test_repeated_passages_are_found_and_cut(make_docs):
    rng = random.Random(4)
    passage = text(rng, 60)
    rows = [(i, f"{text(rng, 80 + i)} {passage} {text(rng, 30)}") for i in range(1, 9)] + [(i, text(rng, 200)) for i in range(20, 40)]
    docs = make_docs(rows)
    out = sd.repeated_passages(docs).collect()
    assert {r.doc_id for r in out} == set(range(2, 9))
    assert {r.first_doc_id for r in out} == {1}
    by = dict(rows)
    for r in out:
        assert by[r.doc_id].encode()[r.start_byte : r.end_byte].decode() in passage
    cut = {r.doc_id: r.text for r in sd.without_repeats(docs).collect()}
    assert cut[1] == by[1] and cut[25] == by[25]
    for r in out:
        data = by[r.doc_id].encode()
        assert cut[r.doc_id] == (data[: r.start_byte] + data[r.end_byte :]).decode()


def test_copies_and_odd_rows(odd, make_docs):
    rng = random.Random(5)
    t = text(rng, 100)
    out = sd.repeated_passages(make_docs([(3, t), (9, t), (5, t)])).collect()
    assert {(r.doc_id, r.start_byte, r.end_byte) for r in out} == {(5, 0, len(t)), (9, 0, len(t))}
    assert {r.doc_id for r in sd.repeated_passages(odd).collect()} <= {5}
    assert sd.repeated_passages(odd.limit(0)).count() == 0
    assert sd.repeated_passages(make_docs([(1, "ab" * 5000), (2, "é" * 3000)])).count() == 0
