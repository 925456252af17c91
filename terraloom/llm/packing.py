"""Vector bin packing of examples into training sequences (operator 6).

A sequence has three limits at once: tokens, segments and loss-bearing tokens. Each task fills its own
sequences from a bounded pool. The next item of the open sequence is the one that fits whose demand has
the largest dot product with the room left, both in shares of the limits, so a sequence short of
segments takes long items and one short of tokens takes short ones.

`cut=True` (plain documents): items of more than a sequence are cut into full sequences first, and when
nothing fits whole, the item with the largest product is cut at the room left. The rest of a task's
stream, and sequences that run out of segments, are cut to powers of two, so nothing is padded.
`cut=False` (instruction data): examples stay whole; those that break a limit alone get sequence_id null.

Defined cases: null and empty texts have no token but the end id, hence one piece of length 1; a null
doc_id is carried; repeated rows are packed once each; very long texts are cut into full sequences as they come; ties between
products go to the item that entered the pool's array first; an empty table gives no sequences; extra columns are
not read. Sequence ids hold the task's partition and a number within it: they are unique, and stay the
same when a lost task runs again, as the split of the scan does not change.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import word_count, table, utf8
from terraloom.llm.tokens import default_path, encoder

LENGTH = 2048
SEGMENTS = 64
POOL = 256
END = 1


@dataclass
class Item:
    """Tokens [start, start + size) of an example. loss: how many of them bear loss."""

    key: Any
    start: int
    size: int
    loss: int

    def head(self, n: int) -> "tuple[Item, Item]":
        """The first n tokens and the rest; loss goes to both in proportion."""
        loss = self.loss * n // self.size
        return Item(self.key, self.start, n, loss), Item(self.key, self.start + n, self.size - n, self.loss - loss)


class Packer:
    """Packs a stream of items; yields placements (item, sequence number, offset)."""

    def __init__(self, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH, cut: bool = True, pool: int = POOL) -> None:
        self.limits = np.array([length, segments, loss], float)
        self.length, self.cut, self.most = length, cut, pool
        self.pool: list[Item] = []
        self.need = np.zeros((2 * pool + segments + 2, 3))
        self.next = 0

    def add(self, item: Item) -> Iterator[tuple[Item, int | None, int]]:
        if not self.cut and (item.size > self.length or item.loss > self.limits[2]):
            yield item, None, 0
            return
        while self.cut and item.size >= self.length and min(item.size, self.length) <= self.limits[2]:
            whole, item = item.head(self.length)
            yield from self._close([whole])
        if item.size:
            self._push(item)
            while len(self.pool) >= self.most:
                yield from self._close(self._fill())

    def end(self) -> Iterator[tuple[Item, int | None, int]]:
        while self.pool:
            yield from self._close(self._fill())

    def _push(self, item: Item) -> None:
        self.need[len(self.pool)] = (item.size, 1, item.loss)
        self.pool.append(item)

    def _pop(self, i: int) -> Item:
        item, last = self.pool[i], len(self.pool) - 1
        self.need[i], self.pool[i] = self.need[last], self.pool[last]
        self.pool.pop()
        return item

    def _fill(self) -> list[Item]:
        room, taken = self.limits.copy(), []
        while self.pool and room[0] >= 1 and room[1] >= 1:
            need = self.need[: len(self.pool)]
            product = (need / self.limits) @ (room / self.limits)
            fits = (need <= room).all(axis=1)
            if fits.any():
                item = self._pop(int(np.argmax(np.where(fits, product, -1.0))))
            elif self.cut and room[2] >= 1:
                long = self._pop(int(np.argmax(product)))
                item, rest = long.head(int(min(room[0], room[2], long.size - 1)))
                self._push(rest)
            else:
                break
            taken.append(item)
            room -= (item.size, 1, item.loss)
        total = sum(x.size for x in taken)
        if self.cut and total < self.length and total & (total - 1):  # cut back to a power of two
            over = total - (1 << (total.bit_length() - 1))
            while over:
                item = taken.pop()
                if item.size > over:
                    keep, item = item.head(item.size - over)
                    taken.append(keep)
                over -= item.size
                self._push(item)
        return taken

    def _close(self, items: list[Item]) -> Iterator[tuple[Item, int | None, int]]:
        at, number = 0, self.next
        self.next += 1
        for x in items:
            yield x, number, at
            at += x.size


def _sequence(partition: int, number: int | None) -> int | None:
    return None if number is None else (partition << 36) + number


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack_texts(path: str, length: int, segments: int, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer, part = encoder(path, specials), Packer(length, segments, length), TaskContext.get().partitionId()
        out: list[tuple] = []

        def place(placed) -> None:
            for x, number, offset in placed:
                doc_id, ids, base, total = x.key
                out.append((doc_id, x.start, x.size, zlib.crc32(ids[x.start - base : x.start - base + x.size]), total, _sequence(part, number), offset))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PIECE)
            out.clear()
            return batch

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, ids, at in code.encode(*utf8(batch.column(1))):
                for r in range(len(at) - 1):
                    own = np.append(ids[at[r] : at[r + 1]], np.uint32(END)).astype("<u4")
                    n = len(own)
                    full = n // length * length
                    if full:
                        place(packer.add(Item((names[i + r], own[:full], 0, n), 0, full, full)))
                    if full < n:  # the pool holds less than a sequence of each document
                        place(packer.add(Item((names[i + r], own[full:].copy(), full, n), full, n - full, n - full)))
                if len(out) > 20_000:
                    yield flush()
        place(packer.end())
        if out:
            yield flush()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, segments: int = SEGMENTS, specials: bool = False) -> DataFrame:
    """A row per piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every token of a document bears loss. specials: whether a special token's name in a text stands for it."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = ", ".join(f"{f.name} long" for f in _PIECE)
    return slim.mapInArrow(_pack_texts(path or default_path(), length, segments, specials), kinds)


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH) -> DataFrame:
    """Whole instruction examples under the three limits: id, tokens, loss_tokens, sequence_id, offset. Null counts are 0; examples of 0 tokens take a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part = Packer(length, segments, loss, cut=False), TaskContext.get().partitionId()
        names: list[str] = ["id", "tokens", "loss_tokens", "sequence_id", "offset"]

        def rows(placed) -> pa.RecordBatch | None:
            made = [(x.key[0], x.key[1], x.key[2], _sequence(part, number), offset) for x, number, offset in placed]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names) if made else None

        for batch in batches:
            placed: list = []
            for key, n, m in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if n:
                    placed += packer.add(Item((key, n, m), 0, n, min(m, n)))
                else:
                    packer.next += 1
                    placed.append((Item((key, n, m), 0, 0, 0), packer.next - 1, 0))
            if (made := rows(placed)) is not None:
                yield made
        if (made := rows(packer.end())) is not None:
            yield made

    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).cast("long")
    slim = examples.select(F.col(id_col).cast("long"), count(tokens_col), count(loss_col))
    return slim.mapInArrow(run, "id long, tokens long, loss_tokens long, sequence_id long, offset long")


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), specials=True)


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one example: its words, of which the assistant's bear loss, under limits on tokens, segments and loss-bearing tokens."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", word_count(F.col("text")).alias("words"))
    examples = turns.groupBy("conv_id").agg(F.sum("words").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("words")).otherwise(0)).alias("loss"))
    return pack_examples(examples, "conv_id", "tokens", "loss", segments=16, loss=1024)
