"""Token ids in blocks of canonical length-limited Huffman codes (operator 8).

Ids are counted over all documents; package-merge gives the optimal code lengths of at most `LIMIT` bits,
and lengths alone define the canonical code. Documents in ascending doc_id order are written in blocks of
whole documents that decode on their own. A block keeps the bit offset of every `STEP`-th symbol; a decoder
looks up `LIMIT` bits in one table for each symbol and follows all checkpoints of a block side by side.

The files are Parquet with one row per block: the code bits are a binary column (stored uncompressed), the
checkpoints and the documents' ids and counts arrays. The table of code lengths is a file of its own next to
the blocks.

Defined cases: null and empty texts have the end id alone; a null doc_id sorts first; repeated rows are stored
once each, in any order among themselves; an empty table gives empty files; extra columns are not read. A
document is never divided, so a block holds at least one document whatever its length.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.common import cut, shared_dir, small, stage, table, utf8
from terraloom.llm.tokens import default_path, encoder

END = 2
LIMIT = 16
STEP = 128
BLOCK = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); symbols that never occur get 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaves = np.arange(len(order))
    # Each level: weights in order, and whether an entry is a leaf; pairs of a level join the next one.
    levels, now, is_leaf = [], weight, np.ones(len(order), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        every = np.concatenate([weight, pairs])
        kinds = np.concatenate([np.ones(len(weight), bool), np.zeros(len(pairs), bool)])
        rank = np.argsort(every, kind="stable")
        now, is_leaf = every[rank], kinds[rank]
    levels.append(is_leaf)
    take, lengths = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[leaves[:n]] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: shorter codes first, then by symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[s]):
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """symbol << 5 | length for every value of the next `limit` bits."""
    codes, out = canonical(lengths), np.zeros(1 << limit, np.uint32)
    for s in np.flatnonzero(lengths):
        n = int(lengths[s])
        at = int(codes[s]) << (limit - n)
        out[at : at + (1 << (limit - n))] = (int(s) << 5) | n
    return out


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The code bits of ids, padded with zero bytes for the reader's look-ahead, and the bit offset of every step-th symbol."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    begin = end - n
    word, inside = begin >> 5, begin & 31
    both = codes[ids].astype(np.uint64) << (64 - inside - n).astype(np.uint64)
    words = np.zeros(int(end[-1] >> 5) + 3, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    at = word[first]
    words[at] += np.add.reduceat(both >> np.uint64(32), first)
    words[at + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), begin[::step]


def decode(bits: bytes, offsets: np.ndarray, n: int, lookup: np.ndarray, step: int = STEP, limit: int = LIMIT) -> np.ndarray:
    """The n ids of a block: one symbol of every checkpoint's stretch at a time."""
    data = np.frombuffer(bits, np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = offsets.astype(np.int64).copy()
    out = np.zeros((step, len(at)), np.uint32)
    lanes, tail = len(at), n - (len(at) - 1) * step
    for k in range(min(step, n)):
        if k == tail:  # the last stretch is over
            lanes -= 1
        own = at[:lanes]
        found = lookup[(window[own >> 3] >> (32 - limit - (own & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)]
        out[k, :lanes] = found >> 5
        own += found & 31
    return out.T.reshape(-1)[:n]


_BLOCK = "part int, block int, start_in_part long, n_ids long, doc_ids array<bigint>, counts array<bigint>, checkpoints array<bigint>, bits binary"


def _kind(size: int) -> str:
    """The stored form of ids below size."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _tokenize(path: str, kind: str, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, specials)
        for batch in batches:
            for i, ids, at in code.encode(*utf8(batch.column(1))):
                ends = at[1:] + np.arange(1, len(at))
                own = np.empty(int(ends[-1]), np.uint32)
                keep = np.ones(len(own), bool)
                keep[ends - 1] = False
                own[keep], own[~keep] = ids, END
                offsets = pa.py_buffer((np.concatenate([[0], ends]) * np.dtype(kind).itemsize).astype(np.int32).tobytes())
                values = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(own.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(ends)), values], ["doc_id", "ids"])

    return run


def _count(size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = utf8(batch.column(0))
            total += np.bincount(data.view(kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return run


def _write(lengths: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, block, start, size, part = canonical(lengths), 0, 0, 0, None
        held: list[np.ndarray] = []
        names: list = []

        def close() -> pa.RecordBatch:
            nonlocal block, start
            ids = np.concatenate(held)
            bits, marks = encode(ids, codes, lengths)
            row = [[part], [block], [start], [len(ids)], [names], [[len(x) for x in held]], [marks], [bits]]
            block, start = block + 1, start + len(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "block", "start_in_part", "n_ids", "doc_ids", "counts", "checkpoints", "bits"])

        for batch in batches:
            data, at = utf8(batch.column(2))
            part = batch.column(0)[0].as_py() if part is None and len(batch) else part
            for r, doc_id in enumerate(batch.column(1).to_pylist()):
                held.append(data[at[r] : at[r + 1]].view(kind))
                names.append(doc_id)
                size += len(held[-1])
                if size >= BLOCK:
                    yield close()
                    held, names, size = [], [], 0
            held = [x.copy() for x in held]
        if held:
            yield close()

    return run


def write_store(docs: DataFrame, path: str | None = None, size: int = 50_257, specials: bool = False) -> str:
    """Encode all documents and return the folder: `blocks` (Parquet, a row per block) and `lengths` (id, length). specials: whether a special token's name in a text stands for it."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = _kind(size)
    ids = stage(slim.mapInArrow(_tokenize(path or default_path(), kind, specials), "doc_id long, ids binary"), "token-ids")
    counts = np.zeros(size, np.int64)  # one number for each id of the vocabulary
    for row in ids.select("ids").mapInArrow(_count(size, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "id long, length int").coalesce(1).write.parquet(f"{out}/lengths")
    ranged = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    ranged.mapInArrow(_write(lengths, kind), _BLOCK).write.option("compression", "none").parquet(f"{out}/blocks")
    return out


def _read(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(lengths)
        for batch in batches:
            for start, doc_ids, counts, marks, bits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = decode(bits, np.array(marks), sum(counts), lookup).astype("<u4")
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    A block knows its start within its part; the starts of parts are a running sum over parts, of which there
    are as many as the writer had tasks.
    """
    lengths = np.zeros(1 << 20, np.uint8)
    for row in spark.read.parquet(f"{path}/lengths").collect():  # at most one row for each id of the vocabulary
        lengths[row.id] = row.length
    lengths = lengths[: int(np.flatnonzero(lengths).max(initial=0)) + 1]
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    parts = cut(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(small(parts.select("part", before.alias("before"))), "part").select((F.col("before") + F.col("start_in_part")).alias("start"), "doc_ids", "counts", "checkpoints", "bits")
    return placed.mapInArrow(_read(lengths), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(spark, write_store(table(spark, sf_dir, "documents"), specials=True))
