"""Exact removal of repeated byte strings by run-length compressed indexes (operator 11).

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else in the corpus, in the same document or another.

Every window of `LENGTH` bytes has an anchor, the leftmost of its substrings of `anchor_size` bytes with the least hash, so equal windows have
equal anchors at equal places. The windows of one anchor are consecutive and make one snippet, and no window is in two snippets. Anchors
that stand once in the corpus end there. Equal snippets of an anchor are one class from then on: all windows of a class of two or more are
repeats, without any comparison, so copies never meet in pairs. What is left are the distinct snippets of an anchor, around edits and at the
ends of shared passages. Their bytes are fetched, one text for each class, and dealt to shards by anchor.

A shard is indexed by the Burrows-Wheeler transform of its snippets, run-compressed: the symbol, length and first and last sampled text
position of each run (`RunIndex`). Of a text that is its own pattern the matching statistics follow from those samples: only at the ends of
runs can the match with a neighbour in suffix order be anything but one less than at the position before, so they are compared there and
streamed in text order from sample to sample. Windows with a match of full length are repeats.

An anchor with more distinct snippets than a shard may hold (a line that very many documents share) is split exactly: its windows reach
further by half of what they hold besides the anchor either to the left or to the right, so each half gets an anchor longer by that, and
snippets meet only where that longer anchor is equal as well. Repeated up to the whole window, this leaves nothing unsplit.

Runs of equal snippets that follow each other (periodic text) are one row with their number. Hashes have 64 bits; a snippet's class has two of them,
so among N distinct snippets of one anchor about N^2 / 2^65 pairs collide.

Defined cases: null and empty texts, and texts shorter than `LENGTH`, lose nothing; repeated rows repeat each other, so long ones go whole
(no first occurrence stays); rows are told apart by id and a hash of the text, so ids need not be unique; a null id is a value like any
other; a very long text is read in overlapping segments; a removed span may end inside a character, so what is kept is binary; an empty table gives an
empty result; extra columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import Scratch, pieces, small, table, utf8

LENGTH = 200
#: Bytes of snippets in a shard, and distinct snippets of one anchor beyond which it is split.
SHARD = 2 << 20
MOST = 3000
_SLICE = 1 << 20
_SEGMENT = 1 << 21
_PLACE_BITS = 24
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_powers: list[tuple[np.ndarray, np.ndarray]] = []
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """64-bit hashes of any substrings of some bytes; `kind` picks one of two independent families."""

    def __init__(self, data: np.ndarray, kind: int):
        n = len(data) + 1
        if not _powers or len(_powers[0][0]) < n:
            _powers.clear()
            for base in _BASES:
                both = []
                for b in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(max(n, 2 * _SLICE), b, U)
                    steps[0] = 1
                    both.append(np.cumprod(steps, dtype=U))
                _powers.append((both[0], both[1]))
        up, self.down = _powers[kind]
        self.sums = np.zeros(n, U)
        np.cumsum(_VALUES[kind][data] * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchor_size(length: int) -> int:
    return max(1, length * 8 // 25)


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of `width` values from each place on."""
    m, done = values, 1
    while 2 * done <= width:
        m = np.minimum(m[: len(m) - done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def snippets(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text, first window, windows, anchor's place from there, repetitions, anchor hash and class hash of all snippets of texts laid end to end."""
    k = anchor_size(length)
    width = length - k + 1
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    sizes = np.diff(at)
    if not len(data) or sizes.max(initial=0) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, U), np.zeros(0, U))
    # Segments of long texts overlap, so that each window lies in one.
    for a in range(0, max(1, len(data) - length + 1), _SEGMENT):
        b = min(len(data), a + _SEGMENT + length - 1)
        if b - a < length:
            continue
        one, two = Hashes(data[a:b], 0), Hashes(data[a:b], 1)
        place = np.arange(b - a - k + 1)
        value = (one.of(place, place + k) >> U(_PLACE_BITS) << U(_PLACE_BITS)) | place.astype(U)
        anchor = (_least_places(value, width) & U((1 << _PLACE_BITS) - 1)).astype(np.int64) + a
        start = np.arange(a, b - length + 1)
        text = np.searchsorted(at, start, "right") - 1
        inside = start + length <= at[text + 1]
        start, anchor, text = start[inside], anchor[inside], text[inside]
        if not len(start):
            continue
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        windows = np.diff(np.append(first, len(start)))
        s, p, t = start[first], anchor[first], text[first]
        h = one.of(p - a, p - a + k)
        g = _mix(two.of(s - a, s - a + windows - 1 + length) + (windows * 4096 + p - s).astype(U))
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (t[1:] != t[:-1])]))
        repeats = np.diff(np.append(new, len(h)))
        for column, x in zip(out, (t[new], s[new] - at[t[new]], windows[new], (p - s)[new], repeats, h[new], g[new]), strict=True):
            column.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for i, j in pieces(at, _SLICE):
                text, start, windows, off, times, h, g = snippets(data[at[i] : at[j]], at[i : j + 1] - at[i], length)
                if len(text):
                    rows = pa.array(text + i)
                    arrays = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(times), pa.array(h.astype(np.int64)), pa.array(g.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "start", "windows", "off", "times", "h", "g"])

    return run


def _fetch(length: int):
    """The bytes of snippets, rows (doc_id, key, text, found) of texts and what is wanted of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            data, at = utf8(batch.column(2))
            for r, (doc, key, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                if (doc, key) in seen:
                    continue
                seen.add((doc, key))
                own = data[at[r] : at[r + 1]].tobytes()
                rows = [(doc, key, x["start"], x["h"], x["g"], x["n"], x["off"], own[x["start"] : x["start"] + x["windows"] - 1 + length]) for x in found]
                yield _members(rows)

    return run


_MEMBER = "doc_id long, key long, start long, h long, g long, n long, off long, bytes binary"
_SPAN = "doc_id long, key long, a long, b long"


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "key", "start", "h", "g", "n", "off", "bytes"])


def suffix_order(t: np.ndarray) -> np.ndarray:
    """The suffix array of bytes, by doubling; only suffixes that are not yet alone in their order are sorted again."""
    n = len(t)
    wide = np.concatenate([t, np.zeros(8, np.uint8)]).astype(U)
    key = np.zeros(n, U)
    for j in range(8):
        key = key << U(8) | wide[j : j + n]
    # Places beyond the end count as zero bytes here, so the last few suffixes are told apart by their lengths below.
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    width = 8
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    left = order[~alone]
    while len(left):
        second = rank[np.minimum(left + width, n)]
        pair = rank[left] * (n + 2) + second + 1
        by = np.argsort(pair, kind="stable")
        left, pair = left[by], pair[by]
        old = rank[left]
        place = np.arange(len(left))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        begun = np.maximum.accumulate(np.where(group, place, 0))
        at = old + np.maximum.accumulate(np.where(fresh, place, 0)) - begun
        rank[left] = at
        single = fresh & np.append(fresh[1:], True)
        left = left[~single]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class RunIndex:
    """A run-compressed Burrows-Wheeler transform: symbols and lengths of runs, and the sampled text positions of their ends with their neighbours.

    Of every run: heads, sizes; first, before: the text position of its first row and of the row above; last, after: of its last row and of
    the row below (-1 where there is none).
    """

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        order = suffix_order(text)
        bwt = text[order - 1]
        new = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        ends = np.append(new[1:], self.n) - 1
        self.heads, self.sizes = bwt[new], np.diff(np.append(new, self.n))
        self.first, self.before = order[new], np.where(new > 0, order[new - 1], -1)
        self.last, self.after = order[ends], np.where(ends + 1 < self.n, order[np.minimum(ends + 1, self.n - 1)], -1)
        self.place = np.empty(self.n, np.int64)
        self.place[order] = np.arange(self.n)
        self.order = order

    def samples(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text positions that are neighbours in suffix order: at the ends of all runs, and at the given starts of patterns."""
        at = self.place[starts]
        above, below = at > 0, at + 1 < self.n
        own = np.concatenate([self.first, self.last, starts[above], starts[below]])
        other = np.concatenate([self.before, self.after, self.order[at[above] - 1], self.order[at[below] + 1]])
        return own[other >= 0], other[other >= 0]


def common_lengths(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at a and b share, up to `most`."""
    pad = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(pad, 8)
    found = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    for off in range(0, most, 8):
        same = key[a[left] + off] == key[b[left] + off]
        whole = same.all(axis=1)
        found[left] += np.where(whole, 8, np.argmin(same, axis=1))
        left = left[whole]
        if not len(left):
            break
    return np.minimum(np.minimum(found, most), len(text) - np.maximum(a, b))


def matching_statistics(index: RunIndex, text: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For every position, up to `most` from the last start of a pattern: the length of the longest match that starts elsewhere."""
    own, other = index.samples(starts)
    reach = np.zeros(index.n, np.int64)
    np.maximum.at(reach, own, own + common_lengths(text, own, other, most))
    return np.maximum(np.maximum.accumulate(reach) - np.arange(index.n), 0)


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some snippets, which of its windows stand in another place of any of them."""
    sizes = np.array([len(x) for x in parts])
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no byte of UTF-8 is 255
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    lengths = matching_statistics(RunIndex(text), text, starts, int(sizes.max()) + 1)
    return [lengths[s : s + n - length + 1] >= length for s, n in zip(starts, sizes, strict=True)]


def _spans(marks: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _resolve(length: int):
    """The repeated spans of the members of a shard that stand once."""

    def run(rows: pa.Table) -> pa.Table:
        members = {(x["h"], x["g"]): x for x in rows.drop_columns(["shard"]).to_pylist()}
        marks = repeated_windows([x["bytes"] for x in members.values()], length)
        out = [(x["doc_id"], x["key"], a, b) for x, m in zip(members.values(), marks, strict=True) if x["n"] == 1 for a, b in _spans(m, x["start"], length)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "key", "a", "b"), zip(*out, strict=True) if out else [[]] * 4, strict=True)})

    return run


def _halve(length: int, size: int):
    """Members of an anchor of `size` bytes dealt to two longer ones; hashes follow."""
    slack = length - size
    half = (slack + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                windows = len(x["bytes"]) - length + 1
                turn = min(max(x["off"] - half + 1, 0), windows)  # windows before it hold `half` bytes more to the left
                for a, b, left in ((0, turn, half), (turn, windows, 0)):
                    if a < b:
                        part, off = x["bytes"][a : b - 1 + length], x["off"] - left - a
                        anchor = part[off : off + size + (half if left else slack - half + 1)]
                        rows.append((x["doc_id"], x["key"], x["start"] + a, _hash(anchor + bytes([left > 0])), _hash(part + off.to_bytes(4, "big", signed=True), 1), x["n"], off, part))
            yield _members(rows)

    return run


def _hash(data: bytes, kind: int = 0) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data, seed=kind) - (1 << 63)


def _settled(members: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of members with bytes: spans of those whose class stands twice or more, and one member of each class of the anchors with several (n, c: rows of
    the class and classes of the anchor)."""
    classes = members.groupBy("h", "g").agg(F.sum("n").alias("total"))
    groups = classes.groupBy("h").agg(F.count("*").alias("c"))
    known = members.join(classes, ["h", "g"]).join(groups, "h")
    sure = known.where("total > 1 AND n = 1").select("doc_id", "key", F.col("start").alias("a"), (F.col("start") + F.length("bytes")).alias("b"))
    rest = known.where("c > 1").groupBy("h", "g").agg(F.first(F.struct("doc_id", "key", "start", "off", "bytes")).alias("x"), F.first("total").alias("n"), F.first("c").alias("c"))
    return sure, rest.select("x.doc_id", "x.key", "x.start", "h", "g", "n", "x.off", "x.bytes", "c")


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """doc_id, key (a hash of the text), a, b: spans of bytes that are covered by repeats; they may overlap. docs: doc_id, key, text."""
    room, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession, "repeats")
    every = room.stage(docs.mapInArrow(_find(length), "doc_id long, key long, start long, windows int, off int, times long, h long, g long"), "snippets")
    twice = every.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h")
    live = room.stage(every.join(twice, "h", "left_semi"), "live")
    classes = room.stage(live.groupBy("h", "g").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "key", "start", "windows", "off")).alias("x")), "classes")
    groups = classes.groupBy("h").agg(F.count("*").alias("c"))
    # All windows of a class of several.
    spans = live.join(classes.where("n > 1").select("h", "g"), ["h", "g"], "left_semi")
    spans = [spans.select("doc_id", "key", F.col("start").alias("a"), (F.col("start") + F.col("times") * F.col("windows") - 1 + length).alias("b"))]
    # The others of anchors with several classes: one text of each.
    several = room.stage(classes.join(groups.where("c > 1"), "h").select("x.*", "h", "g", "n", "c"), "several")
    wanted = several.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "g", "n", "start", "windows", "off")).alias("found"))
    texts = docs.join(small(several.select("doc_id", "key").distinct()).withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    joined = texts.join(wanted.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "text", "found")
    members = room.stage(joined.mapInArrow(_fetch(length), _MEMBER), "members")
    size = anchor_size(length)
    groups = several.groupBy("h").agg(F.first("c").alias("c"))
    hot = groups.where(F.col("c") > most).select("h")
    parts = [members]
    if hot.limit(1).count():
        parts = [members.join(hot, "h", "left_anti")]
        wide = members.join(hot, "h", "left_semi").dropDuplicates(["h", "g"])
        while True:
            halved = room.stage(wide.select("doc_id", "key", "start", "h", "g", "n", "off", "bytes").mapInArrow(_halve(length, size), _MEMBER), "halved")
            size += (length - size + 1) // 2  # the shorter of both halves' anchors, less one where they differ: see below
            sure, rest = _settled(halved, length)
            spans.append(sure)
            rest = room.stage(rest, "rest")
            parts.append(rest.where(F.col("c") <= most).drop("c"))
            wide = rest.where(F.col("c") > most)
            if wide.limit(1).count() == 0:
                break
    whole = parts[0].select(*[f.split()[0] for f in _MEMBER.split(", ")])
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*whole.columns))
    total = whole.agg(F.sum(F.length("bytes"))).first()[0] or 0
    dealt = whole.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(1 + total // shard)))
    spans.append(dealt.groupBy("shard").applyInArrow(_resolve(length), _SPAN))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    out = kept.stage(out, "spans")
    room.close()
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        data, at = utf8(batch.column(1))
        for i, j in pieces(at, 4 * _SLICE):
            ids, sizes, merged, kept = batch.column(0).slice(i, j - i), np.diff(at[i : j + 1]), [], []
            for r, found in enumerate(batch.column(2).slice(i, j - i).to_pylist(), i):
                own, spans, parts, end = data[at[r] : at[r + 1]], [], [], 0
                for a, b in sorted((x["a"], x["b"]) for x in found or ()):
                    if spans and a <= spans[-1]["b"]:
                        spans[-1]["b"] = max(spans[-1]["b"], b)
                    else:
                        spans.append({"a": a, "b": b})
                for x in spans:
                    parts.append(own[end : x["a"]].tobytes())
                    end = x["b"]
                merged.append(spans)
                kept.append(b"".join([*parts, own[end:].tobytes()]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(merged, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (the removed runs a to b), kept (the bytes that remain) for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    spans = repeated_spans(texts, length).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
