import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from terraloom.llm import packing, token_store, tokens
from terraloom.llm.common import utf8

TEXTS = ["", "it's don't  we'll 'tis ''s x's's I'm'd", "  a\n\n b \t c  ", "ab  　 x", "日本語 テスト 123abc 😀 it's", "\U0010ffff x", "'s", " 's", "!'s", "x\n's", "١٢٣ abc", "<|endoftext|> hi", "\r\n\r\n a", "é́a ​ b", "a" * 70]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


def test_bulk_ids_are_the_library_s(library):
    import pyarrow as pa

    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab 'sd1\n!é") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    code, out = tokens.Encoder(tokens.default_path(), most_cached=500), []
    for _, ids, at in code.encode(*utf8(pa.array([*texts, None]))):
        out += [ids[at[r] : at[r + 1]].tolist() for r in range(len(at) - 1)]
    assert out == [library.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_documents_are_packed_whole(make_docs, odd, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "grain harvest " * (i * 37 % 500)) for i in range(60)] + [(200, "long text " * 9000)]
    pieces, sequences = defaultdict(list), defaultdict(list)
    by = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    for r in packing.pack_documents(make_docs(rows)).collect():
        assert r.ids_crc32 == crc(by[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(by[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in by.items():
        assert sorted(pieces[i])[0][0] == 0 and sum(n for _, n in pieces[i]) == len(ids)
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), sorted(pieces[i])[1:]))
    for x in sequences.values():
        total = sum(n for _, n in x)
        assert total <= 2048 and total & (total - 1) == 0 and len(x) <= packing.SEGMENTS
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:]))
    assert {r.doc_id for r in packing.pack_documents(odd).collect()} == {1, 2, None, 4, 5, 6, 7}
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_examples_stay_within_three_limits(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 700), rng.randint(0, 300)) for i in range(500)] + [(900, 5000, 1), (901, None, None), (902, 10, 10)]
    rows = [(i, n, m if n is None else min(m, n)) for i, n, m in rows]
    out = packing.pack_examples(spark.createDataFrame(rows, "i long, t long, l long"), "i", "t", "l", segments=6, loss=600).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    assert [r.id for r in out if r.sequence_id is None] == [900]
    sums = defaultdict(lambda: [0, 0, 0])
    for r in out:
        if r.sequence_id is not None:
            s = sums[r.sequence_id]
            s[0], s[1], s[2] = s[0] + r.tokens, s[1] + 1, s[2] + r.loss_tokens
    assert all(a <= 2048 and b <= 6 and c <= 600 for a, b, c in sums.values())


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_codes_are_optimal_prefix_codes_and_round_trip(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 5, np.int64)
    counts[:n] = (1.9 ** rng.uniform(0, 40, n)).astype(np.int64) + 1
    lengths = token_store.code_lengths(counts, 16)
    used = lengths[counts > 0].astype(float)
    assert used.max() <= 16 and (lengths[counts == 0] == 0).all()
    assert n < 2 or (2.0**-used).sum() == 1
    ids = rng.choice(n, 3001).astype(np.uint32)
    bits, marks = token_store.encode(ids, token_store.canonical(lengths), lengths)
    assert (token_store.decode(bits, marks, len(ids), token_store.decode_table(lengths)) == ids).all()


def test_lengths_match_a_plain_huffman_code():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1])
    heap = [(int(c), i, (i,)) for i, c in enumerate(counts)]
    cost, k = 0, 99
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k := k + 1, ()))
    assert (token_store.code_lengths(counts) * counts).sum() == cost


def test_store_round_trip(spark, make_docs, odd, library):
    rows = [(50 - i, t) for i, t in enumerate(TEXTS)] + [(60, None), (61, "grain " * 3000)]
    start, want = 0, set()
    for d, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.add((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in token_store.read_store(spark, token_store.write_store(make_docs(rows))).collect()} == want
    assert token_store.read_store(spark, token_store.write_store(odd)).count() == 8
    assert token_store.read_store(spark, token_store.write_store(odd.limit(0))).count() == 0
