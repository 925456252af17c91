"""Phrase collocations by an FM-index per shard over word ids (operator 13).

Texts are cut to shards of one language and about `SHARD` bytes. A shard is one row: its distinct words, and the sequence of their ids
with a 0 at every border of a piece or text. Words below the least count, summed over all shards, become borders as well, since no phrase
of that count holds one. Then each shard gets a bidirectional FM-index: the Burrows-Wheeler transforms of its sequence and of the reversed
one, rows sorted by as many words as a phrase may have. A phrase is an interval of rows in each. All phrases of n words are extended at
once to n + 1 words, to the left through the transform (a last-to-first step gives the new interval, the smaller symbols before it the
offset in the other index), to the right through the reversed one; directions alternate. An extension is kept only if the phrases of its
first n and its last n words are both frequent in the whole corpus, which follows from the rows alone.

Counts of a depth are summed over shards: a shard's phrases travel as compressed blocks, one for each bucket of a hash of the phrase, a bucket is
summed in one task of bounded size, and the phrases of the least count get an id, which goes back to the shards that have them for the
next depth. So a phrase is a pair of ids, of the phrases without its last and without its first word; nothing is enumerated that
cannot be frequent, and no vocabulary or phrase table is collected.

Defined cases: null and empty texts have no words; a null lang is `und` and one with a lang of that name; phrases cross neither pieces nor
texts; repeated rows count as often as they stand; ties of cuts go to the shortest first part, of ranks to the lesser phrase by bytes; a
text longer than a shard is a shard; an empty table gives an empty result; extra columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.common import Scratch, small, table, utf8

#: Bytes of text in a shard.
SHARD = 12 << 20
#: Phrases of all shards that are summed in one task, about.
BUCKET = 1 << 20
#: Longest phrase, and the words by which rows of an index are sorted.
DEPTH = 4
LEAST = 30
TOP = 2000
#: Shares of a ranking that are cut to its length before the last sort.
SHARES = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BORDER = np.zeros(256, bool)
_BORDER[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BORDER.copy()
_GAP[[0x20, 0x09]] = True


def _packed(values: np.ndarray) -> bytes:
    """The numbers' type, their bytes' number and the compressed bytes, for tables and shuffles that compress less."""
    raw = np.ascontiguousarray(values).tobytes()
    return values.dtype.str[1:].encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _array(values: np.ndarray) -> pa.Array:
    return pa.array([_packed(values)], pa.binary())


def _numbers(value: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(value[10:], int.from_bytes(value[2:10], "little"), "zstd", asbytes=True), value[:2].decode())


def sequence(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of texts laid end to end, and their ids from 1 with a 0 at borders and both ends."""
    gap = _GAP[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = True
    after[edges - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    if not len(start):
        return pa.array([], pa.string()), np.zeros(1, np.int32)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[~gap]])).dictionary_encode()
    piece = np.cumsum(_BORDER[data], dtype=np.int64)[start] + np.searchsorted(at, start, "right")
    new = np.concatenate([[True], np.diff(piece) != 0])
    out = np.zeros(len(start) + int(new.sum()) + 1, np.int32)
    out[np.arange(len(start)) + np.cumsum(new)] = words.indices.to_numpy() + 1
    return words.dictionary, out


def _make_shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[str, list[pa.Array]] = {}
        held: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            held.pop(lang)
            words, ids = sequence(*utf8(pa.chunked_array(waiting.pop(lang))))
            counts = np.bincount(ids, minlength=len(words) + 1)[1:]
            made += 1
            ends = pa.array([0, len(words)], pa.int32())
            columns = [pa.array([(part << 32) + made]), pa.array([lang], pa.string()), pa.ListArray.from_arrays(ends, words.cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())), _array(ids)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "words", "counts", "ids"])

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == i))
                if not len(texts):
                    continue
                # In slices, so that a batch of long texts makes shards of the usual size.
                sizes = np.cumsum(np.diff(utf8(texts)[1]))
                first = 0
                while first < len(texts):
                    spent = sizes[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(sizes, spent + most - held.get(lang, 0), "right")))
                    waiting.setdefault(lang, []).append(texts.slice(first, last - first))
                    held[lang] = held.get(lang, 0) + int(sizes[min(last, len(texts)) - 1] - spent)
                    first = last
                    if held[lang] >= most or first < len(texts):
                        yield flush(lang)
            while sum(held.values()) > 2 * most:  # many languages in one task
                yield flush(max(held, key=held.get))
        for lang in list(waiting):
            yield flush(lang)

    return run


def _order(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic sequence sorted by `depth` symbols from there on, ties by place."""
    key, width = t.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        pair = key * (int(key.max()) + 1) + np.roll(key, -step)
        width += step
        order = np.argsort(pair, kind="stable")
        if width < depth:
            ordered = pair[order]
            key = np.empty_like(pair)
            key[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return order


def transform(t: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The Burrows-Wheeler transform of a cyclic sequence, rows sorted by `depth` symbols."""
    return t[_order(t, depth) - 1]


class Index:
    """One direction of an FM-index: symbols that precede the rows, and the row of each one's own occurrence (last to first)."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.first = np.empty(len(bwt), np.int64)
        self.first[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))

    def rows(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows of intervals, and which interval each is in."""
        which = np.repeat(np.arange(len(lo)), size)
        return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which], which

    def extend(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every extension of intervals by the symbol that precedes their rows, borders excepted: interval, new lo, new size, new lo in the other index."""
        row, which = self.rows(lo, size)
        symbol = self.bwt[row].astype(np.int64)
        key = which * (int(self.bwt.max()) + 1) + symbol
        order = np.argsort(key, kind="stable")
        key, row, which, symbol = key[order], row[order], which[order], symbol[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(key)))
        # Rows with smaller symbols come before in the other index: the group's place within its interval.
        begun = (np.cumsum(size) - size)[which[start]]
        real = symbol[start] > 0
        start, count, begun = start[real], count[real], begun[real]
        return which[start], self.first[row[start]], count, other[which[start]] + start - begun


def _by_rows(n: int, lo: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every row of an index the id of the phrase that it begins with, or -1."""
    out = np.full(n, -1, np.int64)
    at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    out[at] = np.repeat(ids, size)
    return out


def _index_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The FM-index of every shard (shard, ids, found: places and ids of frequent words), and its words as intervals."""
    for batch in batches:
        for shard, ids, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t = _numbers(ids)
            named = np.array([(x["place"], x["id"]) for x in found], np.int64).reshape(-1, 2)
            named = named[np.argsort(named[:, 0])]
            kind = np.uint16 if len(named) < 1 << 16 else np.int32
            new = np.zeros(max(int(t.max(initial=0)), int(named[:, 0].max(initial=0))) + 1, np.int64)
            new[named[:, 0]] = np.arange(len(named)) + 1
            t = new[t]
            t = t[np.concatenate([[True], (t[1:] != 0) | (t[:-1] != 0)])]  # one 0 between pieces is enough
            if len(t) < 3:
                continue
            size = np.bincount(t, minlength=len(named) + 1)
            lo = np.cumsum(size) - size
            words = np.stack([lo[1:], lo[1:], size[1:], named[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array([shard]), _array(transform(t).astype(kind)), _array(transform(t[::-1]).astype(kind)), _array(words)], ["shard", "forward", "backward", "words"])


def with_ids(rows: DataFrame, room: Scratch, name: str) -> DataFrame:
    """rows, written, with a dense id: the place in the written part plus the rows of the parts before. One count for each part reaches the driver."""
    held = room.stage(rows.withColumn("id", F.monotonically_increasing_id()), name)
    part = F.shiftright("id", 33)
    counts = sorted((r["part"], r["count"]) for r in held.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    before = F.broadcast(held.sparkSession.createDataFrame(starts or [(0, 0)], "part long, before long"))
    return held.join(before, part == F.col("part")).withColumn("id", F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before")


def _extended(bwt: np.ndarray, left: bool, lo: np.ndarray, back: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Phrases one word longer than those given, a column each: head, tail, count, and their intervals lo, back."""
    index = Index(bwt)
    near, far = (lo, back) if left else (back, lo)
    of_row = _by_rows(len(bwt), near, size, ids)
    which, new, count, other = index.extend(near, size, far)
    met = of_row[new]  # the phrase without the word at the other end
    keep = met >= 0
    which, new, count, other, met = which[keep], new[keep], count[keep], other[keep], met[keep]
    head, tail = (met, ids[which]) if left else (ids[which], met)
    return np.stack([head, tail, count, *((new, other) if left else (other, new))])


def _mixed(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    x = head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tail.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BLOCK = "shard long, bucket long, data binary"


def _dealt(shard: int, phrases: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The phrases of a shard as one compressed block for each bucket of pairs, sorted by pair."""
    bucket = (_mixed(phrases[0], phrases[1]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((phrases[1], phrases[0], bucket))
    bucket, phrases = bucket[order], phrases[:, order]
    if phrases.max(initial=0) < 1 << 31:
        phrases = phrases.astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    for i in range(0, len(starts), 256):
        data = [_packed(phrases[:, a:b]) for a, b in zip(starts[i : i + 256], ends[i : i + 256], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(data), pa.int64()), pa.array(bucket[starts[i : i + 256]]), pa.array(data, pa.binary())], ["shard", "bucket", "data"])


def _extend_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, bwt, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _dealt(shard, _extended(_numbers(bwt), True, *_numbers(words).reshape(4, -1)), buckets)

    return run


def _extend_phrases(left: bool, buckets: int):
    """found: blocks of lo, back, count and id of the frequent phrases of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, bwt, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.concatenate([_numbers(x).reshape(4, -1) for x in found], axis=1)
                yield from _dealt(shard, _extended(_numbers(bwt), left, *values[:, np.argsort(values[0])]), buckets)

    return run


def _sum_bucket(least: int):
    """The frequent phrases of a bucket, a row without shard (id, head, tail, count), and where each shard has them (lo, back, count, id). Ids are the bucket's number and the place in it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shards, blocks = rows.column("shard").to_pylist(), [_numbers(x).reshape(5, -1) for x in rows.column("data").to_pylist()]
        sizes = [x.shape[1] for x in blocks]
        every = np.concatenate(blocks, axis=1).astype(np.int64)
        order = np.lexsort((every[1], every[0]))
        head, tail = every[0, order], every[1, order]
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(every[2, order], first)
        often = total >= least
        ids = np.where(often, (key[0].as_py() << 31) + np.cumsum(often) - 1, -1)
        of_row = np.empty(len(order), np.int64)
        of_row[order] = ids[np.cumsum(new) - 1]
        made: list[tuple[int | None, bytes]] = []
        if often.any():
            made.append((None, _packed(np.stack([ids[often], head[first[often]], tail[first[often]], total[often]]))))
        hit = np.flatnonzero(of_row >= 0)
        cuts = np.searchsorted(hit, np.concatenate([[0], np.cumsum(sizes)]))
        for shard, a, b in zip(shards, cuts[:-1], cuts[1:], strict=True):
            own = hit[a:b]
            if len(own):
                made.append((shard, _packed(np.stack([every[3, own], every[4, own], every[2, own], of_row[own]]))))
        return pa.table({"shard": pa.array([m[0] for m in made], pa.int64()), "data": pa.array([m[1] for m in made], pa.binary())})

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in _numbers(data).reshape(4, -1)], ["id", "head", "tail", "f"])


class Phrases:
    """Counts of all frequent phrases of a corpus, by number of words.

    totals: lang, n, all word occurrences. words: id, lang, word, f. by_length[k], k from 2: id, head, tail, f, head and tail being the
    ids of the phrases of k - 1 words without the last and without the first word. Shards and indexes are deleted as soon as nothing reads them.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST, depth: int = DEPTH, shard: int = SHARD, bucket: int = BUCKET):
        spark = docs.sparkSession
        room, raw, built = Scratch(spark, "phrases"), Scratch(spark), Scratch(spark)
        texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
        shards = raw.stage(texts.mapInArrow(_make_shards(shard), "shard long, lang string, words array<string>, counts array<long>, ids binary"), "shards")
        held = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("shard", "lang", (F.col("place") + 1).alias("place"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
        self.words = room.stage(with_ids(held.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), room, "words"), "words-id")
        sums = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
        self.totals = room.stage(sums.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        found = held.join(small(self.words.drop("f")), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("found"))
        index = built.stage(shards.select("shard", "ids").join(found, "shard").mapInArrow(_index_shard, "shard long, forward binary, backward binary, words binary"), "index")
        raw.close()
        self.by_length: dict[int, DataFrame] = {}
        above, found = self.words, None
        for k in range(2, depth + 1):
            # All shards together hold no more phrases than their heads occur.
            buckets = 1 + (above.agg(F.sum("f")).first()[0] or 0) // bucket
            if k == 2:
                blocks = index.select("shard", "forward", "words").mapInArrow(_extend_words(buckets), _BLOCK)
            else:
                blocks = index.select("shard", "forward" if k % 2 == 0 else "backward").join(found, "shard").mapInArrow(_extend_phrases(k % 2 == 0, buckets), _BLOCK)
            summed = room.stage(blocks.groupBy("bucket").applyInArrow(_sum_bucket(least), "shard long, data binary"), f"phrases{k}")
            above = self.by_length[k] = summed.where("shard IS NULL").select("data").mapInArrow(_unpack, "id long, head long, tail long, f long")
            found = summed.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("data").alias("found"))
        built.close()

    def extensions(self, k: int) -> DataFrame:
        """id of every phrase of k words that a frequent one of k + 1 words holds, and the greatest count of those."""
        longer = self.by_length[k + 1]
        both = longer.select(F.col("head").alias("id"), "f").unionByName(longer.select(F.col("tail").alias("id"), "f"))
        return both.groupBy("id").agg(F.max("f").alias("longer"))

    def scored(self, percent: int = 80) -> DataFrame:
        """lang, phrase, a, l, r, score of every frequent phrase that no longer one subsumes, by its worst cut."""
        word = self.words.select("id", "lang", F.col("word").alias("phrase"), "f")
        # For phrases of each length: the counts of its parts, from the first word's on and from the last word's on.
        held = {1: word.withColumns({"firsts": F.array("f"), "lasts": F.array("f"), "last": F.col("phrase")})}
        out = None
        for k, grams in self.by_length.items():
            side = held[k - 1]
            heads = side.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("front"), F.col("firsts"))
            tails = side.select(F.col("id").alias("tail"), "last", F.col("lasts"))
            made = grams.join(heads, "head").join(tails, "tail")
            # firsts: counts of the first 1 .. k words; lasts: counts of the last 1 .. k words.
            held[k] = made.select("id", "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "f", F.array_append("firsts", F.col("f")).alias("firsts"), F.array_append("lasts", F.col("f")).alias("lasts"), "last")
            part = held[k]
            if k + 1 in self.by_length:
                part = part.join(self.extensions(k), "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(38,0)") < percent * F.col("f").cast("decimal(38,0)")))
            cuts = F.array(*[F.struct(_score(F.col("f"), F.col("firsts")[c - 1], F.col("lasts")[k - c - 1]).alias("score"), F.lit(c).alias("cut"), F.col("firsts")[c - 1].alias("l"), F.col("lasts")[k - c - 1].alias("r")) for c in range(1, k)])
            part = part.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("worst")).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
            out = part if out is None else out.unionByName(part)
        return out

    def ranked(self, top: int = TOP, percent: int = 80) -> DataFrame:
        """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
        best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        shared = self.scored(percent).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
        some = shared.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
        rank = F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")
        first = some.withColumn("rank", rank).where(F.col("rank") <= top)
        return first.join(F.broadcast(self.totals) if self.totals.count() <= 10_000 else self.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(a: F.Column, l: F.Column, r: F.Column) -> F.Column:
    """floor(2000000 a / (l + r)) in exact arithmetic of 38 digits."""
    whole = "decimal(19,0)"
    product, total = (F.lit(2_000_000).cast("decimal(7,0)") * a.cast(whole)).cast("decimal(38,0)"), (l.cast(whole) + r.cast(whole)).cast("decimal(38,0)")
    return F.call_function("div", product, total).cast("long")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Phrases(table(spark, sf_dir, "documents")).ranked()


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words CROSS JOIN (VALUES (1), (2), (3), (4)) s(k))
  GROUP BY ALL HAVING count(*) >= 30),
split AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1),
longer AS (
  SELECT lang, part, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS part FROM split WHERE k > 2)
  GROUP BY lang, part),
kept AS (SELECT s.* FROM split s LEFT JOIN longer x ON x.lang = s.lang AND x.part = s.phrase WHERE x.most IS NULL OR 100 * x.most::HUGEINT < 80 * s.a::HUGEINT),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT // (x.f + y.f)) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
