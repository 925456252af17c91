"""Substring deduplication by content-defined chunks (operator 3).

A gear hash rolls over the UTF-8 bytes of whole texts, sum of G[byte] << age over the last 16 bytes. A chunk ends where
the hash is the greatest within `REACH` bytes on both sides (never inside a character), so chunks vary in length, are
at least `REACH` + 1 bytes apart from text ends, and come back in step a few bytes after an insertion. Chunks with equal 128-bit
digests are equal; the occurrence in the least doc_id stays, all others are repeats. Neighbouring repeats of a document
join to passages, and passages of at least `MIN_BYTES` bytes are reported, or removed.

Digests are counted with map-side partials, and chunks meet the repeated digests in a plain join, which Spark splits
where a digest is frequent; nothing is gathered but the repeats of one document.

Defined cases: null and empty texts have no chunks; rows with the same doc_id are one document, the first of a digest
that it repeats within itself stays; a null doc_id never is the least unless all are null; an empty table gives an
empty result; a very long text is cut like any other; of equal chunks the one in the
least document stays; extra columns of any name pass through `without_repeats` and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.common import pieces, table, utf8

REACH = 24
MIN_BYTES = 100
_WINDOW = 16
_PAD = 2 * REACH + _WINDOW
_SLICE = 1 << 20
_RANDOM = np.random.default_rng(31)
_GEAR = _RANDOM.integers(1, 1 << 32, 256, dtype=np.uint32)
_BYTES = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling its window."""
    h = _GEAR[data]
    width = 1
    while width < _WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def _greatest_after(h: np.ndarray, reach: int) -> np.ndarray:
    """The maximum of the `reach` values from each place on."""
    m, width = h, 1
    while 2 * width <= reach:
        m = np.maximum(m[:-width], m[width:])
        width *= 2
    rest = reach - width
    return np.maximum(m[: len(m) - rest], m[rest:]) if rest else m


def chunk_ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) of all chunks of texts laid end to end, and the text each is in."""
    lengths = np.diff(at)
    texts = np.flatnonzero(lengths)
    shift = np.repeat(_PAD * (np.arange(len(texts)) + 1), lengths[texts])
    spot = np.arange(len(data)) + shift
    wide = np.zeros(len(data) + _PAD * (len(texts) + 1), np.uint8)
    wide[spot] = data
    h = gear(wide)
    value = np.zeros_like(h)
    value[spot] = np.maximum(h[spot], 1)
    inside = np.zeros(len(wide), bool)
    inside[:-1] = (wide[1:] & 0xC0) == 0x80
    value[inside] = 0
    ahead = _greatest_after(value, REACH)
    i = np.arange(REACH, len(value) - REACH)  # padding on both sides is wider than that
    peak = (value[i] > ahead[i - REACH]) & (value[i] >= ahead[i + 1])
    marked = np.zeros(len(wide), bool)
    marked[i[peak]] = True
    ends = np.union1d(np.flatnonzero(marked[spot]) + 1, at[1:][lengths > 0])
    return ends, np.searchsorted(at, ends, "left") - 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "idx", "start", "length", "h1", "h2", "again"]
    for batch in batches:
        data, at = utf8(batch.column(1))
        ids = batch.column(0)
        for i, j in pieces(at, _SLICE):
            own, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
            if not len(own):
                continue
            ends, text = chunk_ends(own, offsets)
            starts = np.maximum(np.concatenate([[0], ends[:-1]]), offsets[text])
            digests = []
            for base, values in zip(_BASES, _BYTES, strict=True):
                n = len(own)
                up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
                up[0] = down[0] = 1
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(values[own] * np.cumprod(up, dtype=np.uint64)[:n], out=sums[1:])
                x = (sums[ends] - sums[starts]) * np.cumprod(down, dtype=np.uint64)[starts] + (ends - starts).astype(np.uint64)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                digests.append((x ^ (x >> np.uint64(29))).view(np.int64))
            first = np.zeros(len(ends), bool)
            order = np.lexsort((digests[1], digests[0], text))
            same = (np.diff(text[order]) == 0) & (np.diff(digests[0][order]) == 0) & (np.diff(digests[1][order]) == 0)
            first[order] = np.concatenate([[True], ~same])
            idx = np.arange(len(ends)) - np.searchsorted(text, text)
            arrays = [ids.take(pa.array(i + text)), pa.array(idx.astype(np.int32)), pa.array(starts - offsets[text]), pa.array((ends - starts).astype(np.int32)), pa.array(digests[0]), pa.array(digests[1]), pa.array(~first)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every chunk: doc_id, idx, start and length in UTF-8 bytes, its digest (h1, h2), and whether its document had it before."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_chunks, "doc_id long, idx int, start long, length int, h1 long, h2 long, again boolean")


def repeated_passages(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, start_byte, end_byte, n_chunks, first_doc_id (the least document that holds any of its chunks) of every repeated passage."""
    every = chunks(docs)
    repeated = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1").drop("n")
    repeats = every.join(repeated, ["h1", "h2"]).where(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    order = W.partitionBy("doc_id").orderBy("idx")
    runs = repeats.select("doc_id", "idx", "start", "length", "first_doc_id", (F.col("idx") - F.dense_rank().over(order)).alias("run"))
    joined = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start_byte"), F.max(F.col("start") + F.col("length")).alias("end_byte"), F.count_distinct("idx").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
    return joined.where(F.col("end_byte") - F.col("start_byte") >= min_bytes).select("doc_id", "start_byte", "end_byte", "n_chunks", "first_doc_id")


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of docs with repeated passages cut from text; n_chars, if there is one, follows. Ids must be unique."""

    @F.pandas_udf("string")
    def cut_out(text, spans):
        def one(t, found):
            if t is None or found is None or not len(found):
                return t
            data, parts, at = t.encode(), [], 0
            for a, b in sorted((s["a"], s["b"]) for s in found):
                parts.append(data[at:a])
                at = max(at, b)
            return b"".join([*parts, data[at:]]).decode()

        return text.combine(spans, one)

    spans = repeated_passages(docs, min_bytes).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct(F.col("start_byte").alias("a"), F.col("end_byte").alias("b"))).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(spans, F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut_out("row.text", "spans"))
    rows = rows.select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
