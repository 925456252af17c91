"""Near-duplicate detection with circulant MinHash (operator 2).

A document's set holds the 64-bit hashes of its distinct word shingles. Two permutations make all
signature coordinates: sigma scatters the hashes over 2^32 places, and coordinate k is the least value of
pi over the set shifted by k places, pi((sigma + k) mod 2^32). Rows of coordinates form bands; documents
that share a band hash are candidates, and full sets confirm a link. Bands are chosen so that a pair at
the threshold is missed with a probability below `miss`.

Equal sets are one class from the start, so copies never form pairs, and within a bucket no pairs are listed either.
First, all members of a bucket are tested against its most popular one. Buckets that then still hold several
components are followed up exactly: small ones as they are; the members of large ones are dealt anew by their rarest
shingles, since sets that are to share enough must share one of those. In rounds, some members of the smallest
components of a bucket become hubs, every member of another component meets them in a join, and they are set aside.
A bucket closes when what is left is one component, so every pair of a bucket is tested, connected or ruled out by its
sizes or shingles. The number of hubs grows fourfold with each round, so rounds grow with the logarithm of a bucket's
size. Hubs and members are rows, never arrays. Links are contracted to components by alternating large and small stars.

Defined cases: null, empty and wordless texts have an empty set, are linked with nothing, and are their own
component; rows with a null doc_id take part in links, and are kept only in components without any id;
repeated rows are equal sets, hence one component (each row of the kept id is kept); ties between popular members
or hubs go to the greater or lesser digest, which changes no component; a very long text is one set, hashed in slices of
whole texts, and takes part with its rarest `HEAD` shingles in the bounds and with all in the test; an empty table
gives an empty result; extra columns are not read, and may have any names in `distinct_documents`, whose rows stay where
any row of their id is kept. Hashes have 64 bits: among N distinct sets, or words,
about N^2 / 2^65 pairs collide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.common import Scratch, cut, pieces, small, stage, table, utf8

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = U(0x9E3779B97F4A7C15)
_UNBASE = U(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] | U(1)
_SLICE = 1 << 20
#: Links that one task contracts.
FEW = 20_000
#: The rarest shingles of a set that a pair is compared on before the full sets are.
HEAD = 64
_powers = [np.ones(1, U), np.ones(1, U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2^64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _UNBASE)):
            steps = np.full(max(n, 2 * _SLICE), b, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of texts laid end to end, and each text's first word index."""
    space = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = True
    after[edges - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _pow(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    words = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    return words, np.searchsorted(start, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes(data, at)
    n = len(words)
    odd = U(0xD6E8FEB86659FD93)
    run = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        run = _mix(run * odd + words[j : len(run) + j])
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], U)
            for w in words[a:b]:
                h = _mix(h * odd + w)
            sets.append(h)
        else:
            sets.append(np.zeros(0, U))
    return sets


def set_digest(s: np.ndarray) -> int:
    """Order-free 64-bit digest of a set, from its size and two mixed sums."""
    with np.errstate(over="ignore"):
        one, two = np.sum(_mix(s + U(0x632BE59BD9B4E019))), np.sum(_mix(s ^ U(0x9E6C63D0876A9A47)))
        return int(_mix(np.array([one], U) * U(0xD6E8FEB86659FD93) + _mix(np.array([two], U)) + U(len(s)))[0].astype(np.int64))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash coordinates, a row for each (non-empty) set."""
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    sigma = (_mix(np.concatenate(sets)) >> U(32)).astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    x, y = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(size):  # pi: MurmurHash3's 32-bit finaliser without its last shift, a permutation of 2^32
        np.add(sigma, np.uint32(k), out=x)
        np.right_shift(x, 16, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x85EBCA6B), out=x)
        np.right_shift(x, 13, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0xC2B2AE35), out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def bands_for(percent: int, rows: int = 6, miss: float = 1e-6) -> int:
    """The number of bands with which a pair at the threshold is missed with a probability of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _sign(k: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in pieces(at, _SLICE):
                sets = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
                full = [s for s in sets if len(s)]
                keys: list = [[]] * len(sets)
                if full:
                    sig = signatures(full, rows * bands).astype(U).reshape(len(full), bands, rows)
                    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(full), bands)).copy()
                    for r in range(rows):
                        key = _mix(key * U(0xD6E8FEB86659FD93) + sig[:, :, r])
                    made = iter(key.astype(np.int64).tolist())
                    keys = [next(made) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "node", "bands"],
                )

    return run


def _hold(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in pieces(at, _SLICE):
                sets = [s for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k) if len(s)]
                values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, values)], ["node", "items"])

    return run


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least nodes of the components of a few links, by union and find."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while above.setdefault(root, root) != root:
            root = above[root]
        while above[x] != root:
            above[x], x = root, above[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """node, comp (its component's least node) for every node of links (a, b); large-star and small-star steps until stars are left.

    Both steps are joins with a minimum per node, so no neighbourhood is gathered in one place. At most `FEW` distinct links are contracted in one task instead, which
    saves the rounds.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.limit(FEW + 1).count() <= FEW:
        return cut(edges.coalesce(1).mapInArrow(_contract, "node long, comp long"))
    look = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = look(edges)
    while True:
        # Large star: hang every larger neighbour of u on the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: hang u and its smaller neighbours on the least of them.
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        hung = large.join(low, F.col("u") == F.col("n"))
        edges = cut(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # A round that changes no edge leaves stars, each hanging on the least node of its component.
        now = look(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = now


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 |A and B| >= percent |A or B|."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _tests(rows: DataFrame, hubs: DataFrame, percent: int, room: Scratch) -> DataFrame:
    """Distinct pairs (a, b) of rows with hubs of their bucket in other components, if the sizes, and the rarest shingles where known, allow a link.

    Both have bucket, node, comp, n, head and edge. The bounds stand in the join's condition, so no row is made for a pair that they rule out.
    """
    r, h = rows.alias("r"), hubs.alias("h")
    n, m = F.col("r.n"), F.col("h.n")
    # Up to the lesser of the two last ranks, both heads are complete: what they don't share there, the sets don't.
    beyond = F.when(F.col("r.edge") <= F.col("h.edge"), n - F.size("r.head")).otherwise(m - F.size("h.head"))
    shared = F.size(F.array_intersect("r.head", "h.head")) + beyond
    link = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.col("r.comp") != F.col("h.comp")) & F.coalesce((100 + percent) * shared >= percent * (n + m), F.lit(True))
    pairs = r.join(h, (F.col("r.bucket") == F.col("h.bucket")) & link)
    return room.stage(pairs.select(F.least("r.node", "h.node").alias("a"), F.greatest("r.node", "h.node").alias("b")).distinct(), "pairs")


def _connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after joining the components of every link (a, b)."""
    name = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    between = links.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    return cut(labels.join(merged, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")))


def _prefixes(rows: DataFrame, sets: DataFrame, percent: int, room: Scratch) -> DataFrame:
    """Buckets (bucket, node, n, head, edge) by shared rare shingles, for rows (node, comp, n, least) of classes in large buckets.

    least: the smallest set in a bucket with the node. A partner shares at least `need` shingles, so it has one of any
    n - need + 1 of the node's; the rarest are taken, in one order for all nodes. Shingles of one component alone
    use up that number, but make no bucket. head holds the `HEAD` rarest shingles of the node, edge the last one's rank.
    """
    n, other = F.col("n"), F.least(F.col("n"), F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100)))
    need = F.ceil(percent * (n + other) / (100 + percent) - 1e-9)
    nodes = rows.groupBy("node").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.max(n - need + 1).alias("most"))
    items = room.stage(nodes.join(sets, "node").select("node", "comp", "n", "most", F.explode("items").alias("bucket")), "items")
    df = items.groupBy("bucket").agg(F.count("*").alias("df"), (F.min("comp") != F.max("comp")).alias("open"))
    order = W.partitionBy("node").orderBy("df", "bucket")
    ranked = items.join(df, "bucket").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.greatest("most", F.lit(HEAD)))
    whole, first = W.partitionBy("node"), F.col("rank") <= HEAD
    ranked = ranked.withColumns({"head": F.collect_list(F.when(first, F.col("bucket"))).over(whole), "edge": F.max(F.when(first, F.struct("df", "bucket"))).over(whole)})
    return ranked.where(F.col("open") & (F.col("rank") <= F.col("most"))).select("bucket", "node", "n", "head", "edge")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85, rows: int = 6, miss: float = 1e-6, hubs: int = 64, large: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    bands = bands_for(percent, rows, miss)
    room = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(texts.mapInArrow(_sign(shingle, rows, bands), "doc_id long, n_shingles long, node long, bands array<long>"), "signed")

    # One row for each distinct set, then the buckets that hold at least two of them.
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = room.stage(classes.select("node", "doc_id", "n", F.explode("bands").alias("bucket")), "members")
    shared = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    left = room.stage(members.join(shared, "bucket"), "buckets")

    # Full sets of the classes in those buckets, from one text each. A class in many large buckets is popular.
    wanted = cut(left.groupBy("node").agg(F.first("doc_id").alias("doc_id"), F.sum("c").alias("pop")))
    held = texts.join(small(wanted.select("doc_id").distinct(), 1_000_000), "doc_id", "left_semi")
    if wanted.where("doc_id IS NULL").limit(1).count():
        held = held.unionByName(texts.where("doc_id IS NULL"))
    sets = held.select("text").mapInArrow(_hold(shingle), "node long, items array<long>").join(small(wanted.select("node"), 1_000_000), "node", "left_semi")
    sets = room.stage(sets.groupBy("node").agg(F.first("items").alias("items")), "sets")

    # First every bucket's members against its most popular one, which is close to most of a group of near copies.
    bare = {"head": F.lit(None).cast("array<bigint>"), "edge": F.lit(None).cast("struct<df:bigint,bucket:bigint>")}
    known = left.join(wanted.select("node", "pop"), "node").select("bucket", "node", "n", "pop", F.col("node").alias("comp")).withColumns(bare)
    tops = known.groupBy("bucket").agg(F.max(F.struct("pop", "node", "comp", "n", "head", "edge")).alias("hub")).select("bucket", "hub.*")
    labels = wanted.select("node", F.col("node").alias("comp"))
    links = cut(_verify(_tests(known, tops, percent, room), sets, percent))
    if links.limit(1).count():
        labels = _connect(labels, links)

    # Then what is left of the buckets: small ones as they are, large ones divided by rare shingles.
    now = left.join(labels, "node")
    ends = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).where("lo <> hi")
    open_rows = room.stage(now.join(ends.select("bucket", "least"), "bucket"), "open")
    rest = _prefixes(open_rows.where(F.col("c") > large), sets, percent, room)
    rest = rest.unionByName(open_rows.where(F.col("c") <= large).select("bucket", "node", "n").withColumns(bare))
    while True:
        # Hubs are rows, at most `hubs` of a bucket; one of each salt, of the smallest component. Their buckets hold several components.
        sizes = labels.groupBy("comp").agg(F.count("*").alias("weight"))
        rest = room.stage(rest.join(labels.join(sizes, "comp"), "node"), "open")
        salt = F.pmod(F.xxhash64("node"), F.lit(hubs))
        tops = rest.groupBy("bucket", salt.alias("salt")).agg(F.min(F.struct("weight", "node", "comp", "n", "head", "edge")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        tops = room.stage(tops.select("bucket", "hub.*", "lo", "hi"), "hubs")
        several = tops.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("bucket")
        tops = tops.join(several, "bucket", "left_semi").select("bucket", "node", "comp", "n", "head", "edge")
        if tops.limit(1).count() == 0:
            break
        links = cut(_verify(_tests(rest, tops, percent, room), sets, percent))
        if links.limit(1).count():
            labels = _connect(labels, links)
        # What stays: the buckets that were open, without their hubs.
        rest = rest.join(several, "bucket", "left_semi").join(tops.select("bucket", "node"), ["bucket", "node"], "left_anti")
        rest = rest.select("bucket", "node", "n", "head", "edge")
        hubs *= 4

    # Least doc_id of each component; sets that share no bucket are components of their own.
    ids = classes.select("node", "doc_id").join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "doc_id")
    ids = cut(ids)
    room.close()
    heads = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(heads, "comp").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is kept: one document of each group of near-duplicates, and copies of it with the same id."""
    kept = near_duplicates(docs, shingle=shingle, percent=percent).where("kept").select(F.col("doc_id").alias("id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")), "left_semi").select("row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
