"""Merkle manifest of a dataset in van Emde Boas layout (operator 12).

Every row is a leaf, the SHA-256 of its fields with their lengths. The leaves of a source, by ascending doc_id, are joined in runs
of `ARITY` to the next level until one node, the source's subroot, is left; the subroots, by source, are joined likewise to the root.

A tree is cut into aligned subtrees of `HEIGHT` levels of edges. Such a block is one row with one binary column: the digests of all its
nodes in van Emde Boas order, the upper half of the levels first, then each lower subtree, both laid out in the same way, down to single
nodes. A node's slot follows from its depth and place by arithmetic alone (`slots`); construction writes through it and the retrieval of
siblings reads through it, so a walk from a leaf to the block's root stays within few cache lines whatever their size. The roots of blocks
are the leaves of the next blocks, so a tree of n leaves has about log(n) / log(ARITY ** HEIGHT) levels of blocks, each built by one
grouping of at most ARITY ** HEIGHT digests. Proofs go down the same way: each block hands its children their path to the root.

Places within a source come from a range partitioning by source and doc_id: a row's rank within its partition plus the counts of the
partitions before, so no source is sorted in one task. Texts are read once and only digests are shuffled.

Defined cases: a null field counts as `-`, an empty text as `0:`, so they differ; a null source is a source of its own and comes first;
null ids come first in their source and are never tampered with; rows of one id are ordered by their leaves, equal rows have equal leaves
and any order; a lone leaf is its own subroot, a lone subroot the root, and a proof without siblings is the digest of nothing; very long
texts are hashed by the JVM as one value; an empty table gives an empty result; extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.common import Scratch, small, table

ARITY = 3
HEIGHT = 7
#: Leaves of a full block.
SPAN = ARITY**HEIGHT
_BYTES = 32


def _digest(*parts: bytes) -> bytes:
    """SHA-256 of digests as lowercase hex text, end to end."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def subtree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def slots(depth: int, place: np.ndarray, levels: int) -> np.ndarray:
    """Slots of the nodes at a depth (the root's is 0) of a complete tree with that many levels of nodes, in van Emde Boas order."""
    place = np.array(place, np.int64)
    at = np.zeros_like(place)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        width = ARITY ** (depth - upper)
        at += subtree_size(upper) + place // width * subtree_size(levels - upper)
        place %= width
        depth, levels = depth - upper, levels - upper
    return at


def _levels_for(n: int) -> int:
    """Levels of nodes of the tree over n leaves, or of a full block if it needs more than one."""
    levels = 1
    while ARITY ** (levels - 1) < n and levels <= HEIGHT:
        levels += 1
    return levels


def _counts(leaves: int, levels: int) -> list[int]:
    """Nodes present at each depth of a block."""
    return [-(-leaves // ARITY ** (levels - 1 - d)) for d in range(levels)]


def build_block(leaves: list[bytes], levels: int) -> bytes:
    """The nodes of a block in van Emde Boas order; places of absent nodes hold zeros."""
    out = np.zeros((subtree_size(levels), _BYTES), np.uint8)
    row = list(leaves)
    for depth in range(levels - 1, -1, -1):
        if depth < levels - 1:
            row = [_digest(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
        out[slots(depth, np.arange(len(row)), levels)] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, _BYTES)
    return out.tobytes()


class Block:
    """Reads siblings from a stored block."""

    def __init__(self, nodes: bytes, leaves: int, levels: int):
        self.nodes, self.levels, self.counts = nodes, levels, _counts(leaves, levels)
        self.at = [slots(d, np.arange(c), levels) * _BYTES for d, c in enumerate(self.counts)]

    def node(self, depth: int, place: int) -> bytes:
        a = self.at[depth][place]
        return self.nodes[a : a + _BYTES]

    def path(self, place: int) -> bytes:
        """The siblings from a leaf to the block's root: for each level the own place in the run, their number, their digests."""
        parts = []
        for depth in range(self.levels - 1, 0, -1):
            first = place - place % ARITY
            run = [i for i in range(first, min(first + ARITY, self.counts[depth])) if i != place]
            parts.append(bytes([place - first, len(run)]) + b"".join(self.node(depth, i) for i in run))
            place //= ARITY
        return b"".join(parts)


def _steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        own, n = path[at], path[at + 1]
        yield own, [path[at + 2 + i * _BYTES : at + 2 + (i + 1) * _BYTES] for i in range(n)]
        at += 2 + n * _BYTES


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for own, run in _steps(path):
        leaf = _digest(*run[:own], leaf, *run[own:])
    return leaf


def proof_digest(path: bytes) -> bytes:
    """The digest of all siblings of a path, in its order."""
    return _digest(*[x for _, run in _steps(path) for x in run])


def leaf_digest(text: F.Column = None) -> F.Column:
    """The leaf of a row of documents, with another text if one is given."""
    own = F.col("text") if text is None else text
    fields = [F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("string"), own]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]).cast("binary"), 256))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, tree, with the number of the task and their rank in it within their tree."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        trees = np.array(batch.column(0).to_pylist(), object)
        first = np.ones(len(trees), bool)
        first[1:] = trees[1:] != trees[:-1]
        starts = np.flatnonzero(first)
        rank = np.arange(len(trees)) - np.repeat(starts, np.diff(np.append(starts, len(trees))))
        if len(trees) and trees[0] == last:
            rank[: starts[1] if len(starts) > 1 else None] += n
        if len(trees):
            last, n = trees[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(trees), part)), pa.array(rank)], [*batch.schema.names, "part", "rank"])


def placed(rows: DataFrame, order: list[str], room: Scratch) -> DataFrame:
    """rows (tree first) with pos, their place within their tree by `order`, and n, the size of the tree. Written, so that places are fixed."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranked = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInArrow(_numbered, f"{kinds}, part long, rank long")
    ranked = room.stage(ranked, "ranked")
    held = ranked.groupBy("tree", "part").agg(F.count("*").alias("held"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("tree", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(W.partitionBy("tree")).alias("n"))
    return ranked.join(small(starts), ["tree", "part"]).withColumn("pos", F.col("start") + F.col("rank")).drop("part", "rank", "start")


def _make_block(key: tuple, rows: pa.Table) -> pa.Table:
    pos, digests = rows.column("pos").to_numpy(), rows.column("digest").to_pylist()
    n, m = rows.column("n")[0].as_py(), len(digests)
    levels = _levels_for(n)
    nodes = build_block([digests[i] for i in np.argsort(pos)], levels)
    return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "block": [key[1].as_py()], "n": [n], "leaves": [m], "levels": [levels], "nodes": pa.array([nodes], pa.binary()), "digest": pa.array([nodes[:_BYTES]], pa.binary())})


_BLOCK = "tree string, block long, n long, leaves long, levels long, nodes binary, digest binary"


def blocks_of(items: DataFrame, room: Scratch) -> list[DataFrame]:
    """Blocks of all trees, lowest level first. items: tree, pos, n, digest. Trees of at most `SPAN` nodes on a level end there."""
    levels = []
    while True:
        keyed = items.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "n", "digest")
        made = room.stage(keyed.groupBy("tree", "block").applyInArrow(_make_block, _BLOCK), f"level{len(levels)}")
        levels.append(made)
        higher = made.where(F.col("n") > SPAN)
        if higher.limit(1).count() == 0:
            return levels
        items = higher.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), "digest")


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of its root."""
    ended = [x.where(F.col("n") <= SPAN).select("tree", "digest") for x in levels]
    found = ended[0]
    for x in ended[1:]:
        found = found.unionByName(x)
    return found


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tree, block, leaves, levels, nodes, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = Block(nodes, leaves, levels)
            paths = [held.path(i) + path for i in range(leaves)]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * leaves, pa.string()), pa.array(np.arange(leaves) + block * SPAN), pa.array(paths, pa.binary())], ["tree", "block", "path"])


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks with the path of each from its root up. tops: tree, path of the tree's root."""
    handed = None
    for k in range(len(levels) - 1, -1, -1):
        named = levels[k].where(F.col("n") <= SPAN).join(tops, "tree")
        columns = ["tree", "block", "leaves", "levels", "nodes", "path"]
        if handed is not None:
            named = named.select(*columns).unionByName(levels[k].where(F.col("n") > SPAN).join(handed, ["tree", "block"]).select(*columns))
        named = named.select(*columns)
        if k:
            handed = named.mapInArrow(_hand_down, "tree string, block long, path binary")
    return named


class Manifest:
    """The stored trees of documents: leaves (tree, pos, n, doc_id, digest, altered), blocks by level, and the root (None without rows)."""

    def __init__(self, docs: DataFrame, altered: F.Column | None = None):
        """altered: a digest to hold against the manifest in place of the leaf's own, null where there is none."""
        self.room = room = Scratch(docs.sparkSession, "manifest")
        tree = F.coalesce(F.concat(F.lit("."), F.col("source").cast("string")), F.lit(""))  # null first, then by bytes
        other = F.lit(None).cast("binary") if altered is None else altered
        rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), other.alias("altered"))
        self.leaves = room.stage(placed(rows, ["doc_id", "digest"], room), "leaves")
        self.levels = blocks_of(self.leaves, room)
        self.subroots = roots_of(self.levels)
        sources = placed(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest"), ["source_tree"], room)
        self.sources = room.stage(sources, "sources")
        self.upper = blocks_of(self.sources, room)
        top = roots_of(self.upper).first()
        self.root = None if top is None else bytes(top["digest"])

    def tops(self) -> DataFrame:
        """tree, subroot, path from the subroot to the root."""
        spark = self.sources.sparkSession
        end = spark.createDataFrame([("", bytearray())], "tree string, path binary")
        blocks = descend(self.upper, end)
        paths = blocks.mapInArrow(_hand_down, "tree string, block long, path binary").withColumnRenamed("block", "pos")
        return self.sources.join(paths, ["tree", "pos"]).select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "path")

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row."""
        tops = self.room.stage(self.tops(), "tops")
        blocks = descend(self.levels, tops.select("tree", "path")).join(tops.select("tree", "subroot"), "tree")
        keyed = self.leaves.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "doc_id", "digest", "altered")
        root = self.root

        def prove(rows: pa.Table, held: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], [], [], [], []]
            for b in held.to_pylist():  # one
                block, digest = Block(b["nodes"], b["leaves"], b["levels"]), b["subroot"].hex()
                for pos, doc, leaf, altered in zip(*(rows.column(c).to_pylist() for c in ("pos", "doc_id", "digest", "altered")), strict=True):
                    path = block.path(pos % SPAN) + b["path"]
                    folded = fold(leaf if altered is None else altered, path)
                    for column, value in zip(out, (doc, leaf.hex(), digest, root.hex(), proof_digest(path).hex(), folded.hex(), folded == root), strict=True):
                        column.append(value)
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            return pa.table({n: pa.array(v, t) for n, v, t in zip(("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), out, kinds, strict=True)})

        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(prove, schema)


def tampered_leaf() -> F.Column:
    """The leaf of a row without its text's line feeds, where the checksum of its id is even; null elsewhere."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, leaf_digest(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Manifest(table(spark, sf_dir, "documents"), tampered_leaf()).proofs()


#: Leaves, then all levels of all trees by recursion, then each leaf's siblings and its fold. Checksums need only their lowest bit,
#: computed with the reflected polynomial, which SQL makes from the bits of each byte.
OP12_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '.' || source END AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS less,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: xor(crc >> 8, list_reduce(list_prepend(xor(crc, c) & 255, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN (4294967295 - crc) % 2 = 0 THEN sha256(head || coalesce(strlen(less) || ':' || less, '-')) END AS other FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
lower_tree AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM lower_tree WHERE n > 1 GROUP BY tree, pos // 3),
subroots AS (SELECT tree AS source_tree, digest FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source_tree) - 1 AS pos, count(*) OVER () AS n, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY pos // 3),
places AS (SELECT source_tree, digest AS subroot, row_number() OVER (ORDER BY source_tree) - 1 AS place FROM subroots),
heights AS (SELECT tree, max(level) AS height FROM lower_tree GROUP BY tree),
-- The state of each fold: the level reached (those of the upper tree follow), the place in it, the digest and the siblings so far.
fold AS (
  SELECT p.doc_id, p.tree, p.leaf, l.subroot, l.place, h.height, 0 AS level, p.pos, coalesce(p.other, p.leaf) AS digest, '' AS siblings, p.pos AS row_pos
  FROM placed p JOIN places l ON l.source_tree = p.tree JOIN heights h ON h.tree = p.tree
  UNION ALL
  SELECT doc_id, tree, leaf, subroot, place, height, level + 1, pos // 3, sha256(coalesce(before, '') || digest || coalesce(after, '')), siblings || coalesce(before, '') || coalesce(after, ''), row_pos
  FROM (
    SELECT f.doc_id, f.tree, f.leaf, f.subroot, f.place, f.height, f.level, CASE WHEN f.level < f.height THEN f.pos ELSE f.upos END AS pos, f.digest, f.siblings, f.row_pos,
      string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < CASE WHEN f.level < f.height THEN f.pos ELSE f.upos END) AS before,
      string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > CASE WHEN f.level < f.height THEN f.pos ELSE f.upos END) AS after
    FROM (SELECT *, CASE WHEN level = height THEN place ELSE pos END AS upos FROM fold) f
    JOIN (SELECT tree, level, pos, n, digest, true AS low FROM lower_tree UNION ALL SELECT NULL, level, pos, n, digest, false FROM upper_tree) s
      ON s.n > 1 AND ((f.level < f.height AND s.low AND s.tree = f.tree AND s.level = f.level AND s.pos // 3 = f.pos // 3)
        OR (f.level >= f.height AND NOT s.low AND s.level = f.level - f.height AND s.pos // 3 = f.upos // 3))
    GROUP BY ALL) g),
ends AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tree, row_pos ORDER BY level DESC) AS latest FROM fold)
SELECT e.doc_id, e.leaf, e.subroot, r.digest AS root, sha256(e.siblings) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM ends e CROSS JOIN (SELECT digest FROM upper_tree WHERE n = 1) r WHERE e.latest = 1
"""
