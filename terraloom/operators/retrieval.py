"""Batch retrieval: dense and BM25 top-k, rank fusion, filters, relaxation, ranking, packing, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terraloom.operators.metrics import ranked
from terraloom.operators.state import cut


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "embedding", block: int = 4096, rows: int = 20_000) -> DataFrame:
    """query_id, doc_id, score: the k most similar vectors (cosine; ties by doc_id) of every query.

    Up to `block` queries are broadcast, and each task multiplies them with its part of the corpus. More are dealt to blocks and the corpus to slices of about `rows`
    vectors by hash, and each block meets each slice in one group, so neither side reaches the driver. Either way a group keeps its own k best per query, and a
    limited window merges those. Zero and null vectors score 0 and null respectively are left out.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    held = corpus.where(F.col(vector).isNotNull()).select(doc_id, vector)
    schema = f"{query_id} long, {doc_id} long, score double"
    n = asked.limit(block + 1).count()
    if n <= block:
        some = asked.orderBy(query_id).collect()
        q = _unit(np.array([r[1] for r in some], np.float64)) if some else np.zeros((0, 1))
        sent = corpus.sparkSession.sparkContext.broadcast(([r[0] for r in some], q))
        found = held.mapInPandas(_best(sent, k, query_id, doc_id, vector), schema)
    else:
        blocks, slices = -(-asked.count() // block), max(1, -(-held.count() // rows))
        left = asked.withColumns({"_block": F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("long"), "_slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})
        right = held.withColumns({"_slice": F.pmod(F.xxhash64(doc_id), F.lit(slices)).cast("int"), "_block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})

        def meet(some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if not len(some) or not len(part):
                return pd.DataFrame({query_id: [], doc_id: [], "score": []})
            return _top(some[query_id].to_numpy(), _unit(np.stack(some[vector].to_numpy()).astype(np.float64)), part, k, query_id, doc_id, vector)

        found = left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice")).applyInPandas(meet, schema)
    return ranked(found, [query_id], [F.desc("score"), F.col(doc_id)], k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _top(names: Sequence[int], q: np.ndarray, part: pd.DataFrame, k: int, query_id: str, doc_id: str, vector: str, some: int = 256, tile: int = 2048) -> pd.DataFrame:
    """The k best of some vectors for each query. Queries and vectors meet in tiles, and a query keeps its k best so far, so that scores stay bounded."""
    ids, v = part[doc_id].to_numpy(), _unit(np.stack(part[vector].to_numpy()).astype(np.float64)).T
    out = []
    for i in range(0, len(q), some):
        asked = q[i : i + some]
        best, held = np.empty((len(asked), 0)), np.empty((len(asked), 0), ids.dtype)
        for j in range(0, len(ids), tile):
            scores = np.hstack([best, np.round(asked @ v[:, j : j + tile], 9)])
            found = np.hstack([held, np.broadcast_to(ids[j : j + tile], (len(asked), len(ids[j : j + tile])))])
            order = np.lexsort((found, -scores), axis=1)[:, :k]
            best, held = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
        out.append(pd.DataFrame({query_id: np.repeat(names[i : i + some], held.shape[1]), doc_id: held.ravel(), "score": best.ravel()}))
    return pd.concat(out) if out else pd.DataFrame({query_id: [], doc_id: [], "score": []})


def _best(held, k: int, query_id: str, doc_id: str, vector: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = held.value
        for frame in frames:
            if len(frame) and len(names):
                yield _top(names, q, frame, k, query_id, doc_id, vector)

    return run


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, block: int = 4096, most: int = 500_000) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents.

    Up to `block` queries with `most` terms are broadcast. Texts are read once: a task counts the broadcast terms in its texts, counts are dealt by document, and a task
    scores its documents against all queries and keeps the k best of each; a limited window merges those. For more queries, postings meet terms in equi-joins.
    """
    asked = queries.select(query_id, F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("_times"))
    docs = corpus.select(doc_id, terms(F.col(text)).alias("_w"))
    some = asked.limit(most + 1).collect()
    if len(some) > most or len({r[0] for r in some}) > block:
        return _bm25_joined(asked, docs.withColumn("_len", F.size("_w")), k, query_id, doc_id, k1, b)
    words, ids = sorted({r[1] for r in some}), list(dict.fromkeys(r[0] for r in some))
    place, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(ids)}
    sc, kinds = corpus.sparkSession.sparkContext, {n: x.schema[n].dataType.simpleString() for n, x in ((doc_id, corpus), (query_id, queries))}
    counted = docs.mapInArrow(_counts(sc.broadcast(words), doc_id), f"`{doc_id}` {kinds[doc_id]}, _len int, _t array<int>, _tf array<int>")
    # Written once: the document frequencies, the mean length and the scores read the counts. A checkpoint keeps its partitions and their order.
    tf = cut(counted.repartition(doc_id).sortWithinPartitions(doc_id))
    n, total = tf.agg(F.count("*"), F.coalesce(F.sum("_len"), F.lit(0))).first()
    df = np.ones(len(words))
    for t, found in tf.mapInArrow(_frequencies, "_t int, n long").groupBy("_t").agg(F.sum("n")).collect():
        df[t] = found
    idf, meets = np.log(1 + (n - df + 0.5) / (df + 0.5)), [([], []) for _ in words]
    for q, w, times in some:
        meets[place[w]][0].append(column[q])
        meets[place[w]][1].append(times)
    ids = pa.Table.from_arrays([pa.array(ids, to_arrow_type(queries.schema[query_id].dataType))], ["id"])
    sent = sc.broadcast((ids, idf, [(np.array(c), np.array(m, np.float64)) for c, m in meets], total / n if n else 0.0))
    scored = tf.mapInArrow(_scores(sent, k, k1, b, [query_id, doc_id, "score"]), f"`{query_id}` {kinds[query_id]}, `{doc_id}` {kinds[doc_id]}, score double")
    return ranked(scored, [query_id], [F.desc("score"), F.col(doc_id)], k)


def _counts(sent, doc_id: str, rows: int = 1000):
    """The places of the broadcast words that stand in a list of words, and how often each does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = pa.array(sent.value, pa.string()), max(len(sent.value), 1)
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                size = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int32)
                found = pc.index_in(part.column(1).flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
                keys, tf = np.unique(np.repeat(np.arange(len(size)), size)[found >= 0] * base + found[found >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(len(size) + 1) * base).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % base, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), *lists], [doc_id, "_len", "_t", "_tf"])

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Names, and the first row of each document, of rows sorted by document; then document, length, word and count of what they hold, where equal ones of the
    first three are one. A document's rows wait for its last one."""

    def whole(part: pa.Table):
        names = part.column(0).combine_chunks()
        first = _starts(names)
        lists = part.column(2).combine_chunks()
        held = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(names)])), held)
        size, place, tf = np.repeat(part.column(1).to_numpy(), held), lists.flatten().to_numpy(), part.column(3).combine_chunks().flatten().to_numpy()
        if len(first) < len(names) and len(doc):
            order = np.lexsort((place, size, doc))
            doc, size, place, tf = doc[order], size[order], place[order], tf[order]
            new = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(size) != 0) | (np.diff(place) != 0)])
            doc, size, place, tf = doc[new], size[new], place[new], np.add.reduceat(tf, new)
        return names, first, doc, size, place, tf

    rest = None
    for batch in batches:
        here = pa.Table.from_batches([batch])
        here = here if rest is None else pa.concat_tables([rest, here])
        last = int(_starts(here.column(0).combine_chunks())[-1]) if here.num_rows else 0
        if last:
            yield whole(here.slice(0, last))
        rest = here.slice(last)
    if rest is not None and rest.num_rows:
        yield whole(rest)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for *_, place, _ in _documents(batches):
        keys, n = np.unique(place, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(n.astype(np.int64))], ["_t", "n"])


def _scores(sent, k: int, k1: float, b: float, names: list[str], cells: int = 1_000_000):
    """The k best documents of each broadcast query among rows of counts that are sorted by document."""

    def best(docs, first, doc, size, place, tf) -> Iterator[pa.RecordBatch]:
        ids, idf, meets, mean = sent.value
        if not len(doc):
            return
        weight = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
        step = max(1, cells // ids.num_rows)
        for at in range(0, len(first), step):
            lo, hi = np.searchsorted(doc, [at, at + step])
            n = min(step, len(first) - at)
            # Rows of one id with texts of several lengths add up.
            keys, where = np.unique(place[lo:hi].astype(np.int64) * n + doc[lo:hi] - at, return_inverse=True)
            sums, scores = np.bincount(where, weight[lo:hi]), np.zeros((n, ids.num_rows))
            edges = np.flatnonzero(np.r_[True, np.diff(keys // n) > 0, True])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                columns, times = meets[keys[x] // n]
                scores[np.ix_(keys[x:y] % n, columns)] += sums[x:y, None] * times
            # Every shared term adds more than 0, so a document without one stays at 0, whatever rounding makes of small scores.
            rounded = np.where(scores > 0, np.floor(scores * 1e6 + 0.5) / 1e6, -1.0)
            order = np.argsort(-rounded, axis=0, kind="stable")[:k]
            held = np.take_along_axis(rounded, order, 0)
            pick, query = np.nonzero(held >= 0)
            yield pa.RecordBatch.from_arrays([ids.column(0).combine_chunks().take(pa.array(query)), docs.take(pa.array(first[at + order[pick, query]])), pa.array(held[pick, query])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _documents(batches):
            yield from best(*part)

    return run


def _starts(names: pa.Array) -> np.ndarray:
    """Where runs of equal values (nulls are equal) begin."""
    if len(names) < 2:
        return np.arange(len(names))
    a, b = names[1:], names[:-1]
    differs = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_valid(a), pc.is_valid(b)))
    return np.flatnonzero(np.r_[True, differs.to_numpy(zero_copy_only=False)])


def _bm25_joined(asked: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, k1: float, b: float) -> DataFrame:
    """`bm25` for any number of queries. Postings meet the query terms in an equi-join; only their terms are counted."""
    stats = docs.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"))
    # Written once: both the document frequencies and the scores read the counts.
    tf = cut(docs.select(doc_id, "_len", F.explode("_w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy(doc_id, "_len", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    scored = asked.join(weighted.select(doc_id, "term", score.alias("s")), "term").groupBy(query_id, doc_id).agg(F.round(F.sum(F.col("s") * F.col("_times")), 6).alias("score"))
    return ranked(scored, [query_id], [F.desc("score"), F.col(doc_id)], k)


def fuse(lists: Sequence[DataFrame], k: int, query_id: str = "query_id", doc_id: str = "doc_id", constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, doc_id, rank): query_id, doc_id, score, rank."""
    every = lists[0].select(query_id, doc_id, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(query_id, doc_id, "rank"))
    scored = every.groupBy(query_id, doc_id).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return ranked(scored, [query_id], [F.desc("score"), F.col(doc_id)], k)


def soft_score(country: Column, listed: Column, asked: Column, year: Column, first: Column, last: Column, domain: Column) -> Column:
    """Metadata score in [-0.5, 0.5]: +0.25 for the primary country, +0.1 if listed, -0.5 against another; +-0.15 for time; +0.1 for the domain."""
    geo = F.when(asked.isNull(), 0.0).when(F.lower(country) == F.lower(asked), 0.25).when(listed, 0.1).when(country.isNotNull(), -0.5).otherwise(0.0)
    time = F.when(first.isNull() | year.isNull(), 0.0).when(year.between(first, last), 0.15).otherwise(-0.15)
    return F.greatest(F.lit(-0.5), F.least(F.lit(0.5), geo + time + F.when(domain, 0.1).otherwise(0.0)))


def cascade(candidates: DataFrame, query_id: str, geo: Column, time: Column, near: Column) -> DataFrame:
    """The candidates of each query's first non-empty level, stamped: full, time_near, no_time, no_geo, none. One pass: a row carries the strictest level it passes."""
    level = F.when(geo & time, 0).when(geo & near, 1).when(geo, 2).when(time, 3).otherwise(4)
    rows = candidates.withColumn("_level", level)
    best = rows.groupBy(query_id).agg(F.min("_level").alias("_best"))
    names = F.array(*[F.lit(x) for x in ("full", "time_near", "no_time", "no_geo", "none")])
    # A level's answer holds every row that its filter lets through, so stricter rows belong to looser levels too.
    passes = F.when(F.col("_best") == 3, F.col("_level").isin(0, 3)).otherwise(F.col("_level") <= F.col("_best"))
    return rows.join(best, query_id).where(passes).withColumn("constraint", F.get(names, F.col("_best"))).drop("_level", "_best")


def normalised_rerank(candidates: DataFrame, query_id: str, score: str, boost: Column, doc_id: str = "doc_id") -> DataFrame:
    """Scores of a query scaled to [0, 1] (0.5 if all are equal), plus a boost; ranked."""
    w = W.partitionBy(query_id)
    low, high = F.min(score).over(w), F.max(score).over(w)
    scaled = F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.5)
    return ranked(candidates.withColumn("final", F.round(scaled + boost, 6)), [query_id], [F.desc("final"), F.col(doc_id)])


def source_boost(kind: Column, boosts: Mapping[str, float], unrelaxed: Column) -> Column:
    """The boost of a kind, and 0.05 for results that no filter was relaxed for."""
    out = F.lit(0.0)
    for name, value in boosts.items():
        out = F.when(kind == name, float(value)).otherwise(out)
    return out + F.when(unrelaxed, 0.05).otherwise(0.0)


def diversity_pack(items: DataFrame, query_id: str, kind: str, rank: str, kinds: Sequence[str], structured: str = "structured", cap: int = 4, rounds: int = 2, limit: int = 14) -> DataFrame:
    """Up to `limit` items of a query: `cap` structured ones first, then `rounds` rounds over the narrative kinds, then by rank."""
    within = F.row_number().over(W.partitionBy(query_id, kind).orderBy(rank))
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col(kind)), F.lit(0)).cast("int")
    zero = F.lit(0)
    place = (
        F.when((F.col(kind) == structured) & (F.col("_in") <= cap), F.struct(zero.alias("a"), F.col("_in").alias("b"), zero.alias("c")))
        .when((order > 0) & (F.col("_in") <= rounds), F.struct(F.lit(1).alias("a"), F.col("_in").alias("b"), order.alias("c")))
        .otherwise(F.struct(F.lit(2).alias("a"), F.col(rank).cast("int").alias("b"), zero.alias("c")))
    )
    placed = items.withColumn("_in", within).withColumn("_place", place)
    return ranked(placed, [query_id], [F.col("_place")], limit, "position").drop("_in", "_place")


def evaluate(results: DataFrame, query_id: str, hit: str, k: int) -> DataFrame:
    """queries, recall_at_k (share of queries with a hit in the first k) and mrr over ranked results."""
    per = results.groupBy(query_id).agg(F.max(F.when(F.col(hit) & (F.col("rank") <= k), 1).otherwise(0)).alias("found"), F.min(F.when(F.col(hit), F.col("rank"))).alias("first"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("found"), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def route_corpora(queries: DataFrame, query_id: str, intent: str, rules: DataFrame, default: str) -> DataFrame:
    """query_id, corpus, boost: the corpora that a rule table (intent, corpus, boost, skip) gives a query's intent; never none, as the default stands in."""
    q = queries.select(query_id, F.col(intent).alias("_intent"))
    named = rules.select(F.col("intent").alias("_i"), "corpus", "boost", "skip")
    kept = q.join(named, F.col("_intent") == F.col("_i"), "left").where(F.coalesce(~F.col("skip"), F.lit(False))).select(query_id, "corpus", "boost")
    left = q.join(kept.select(query_id).distinct(), query_id, "left_anti")
    return kept.unionByName(left.select(query_id, F.lit(default).alias("corpus"), F.lit(0.0).alias("boost")))


#: Boosts of kinds of context, and what a numeric or comparing question, and rows with a meaning, add.
KIND_BOOST = {"bigquery": 0.12, "academic": 0.06, "policy": 0.06, "public_report": 0.06, "formation": 0.05, "ota_insight": 0.05, "news": 0.04, "web_wikipedia": 0.0, "web_search": 0.0}
STRUCTURED = "bigquery"
ASKED_BOOST = {"numeric": {"kind": 0.10, "meaning": 0.05, "ranked": 0.15}, "comparing": {"kind": 0.06, "meaning": 0.04, "ranked": 0.10}, "other": {"kind": 0.0, "meaning": 0.05, "ranked": 0.15}}
UNRELAXED_BOOST = 0.05


def context_boost(kind: Column, corpus: Column, enrichment: Column, meaning: Column, relaxed: Column, numeric: Column, comparing: Column, kinds: Mapping[str, float] = KIND_BOOST) -> Column:
    """What is added to a row's score: its kind's boost or the corpus's if that is greater, more for structured rows and rows with a meaning (by what is asked for), and for
    rows that no filter was relaxed for. Null corpus boosts count as none; unknown kinds start from 0."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    static = F.coalesce(*[F.when(k == name, F.lit(x)) for name, x in kinds.items()], F.lit(0.0))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    asked = lambda what: F.when(numeric, ASKED_BOOST["numeric"][what]).when(comparing, ASKED_BOOST["comparing"][what]).otherwise(ASKED_BOOST["other"][what])
    given = lambda condition, x: F.when(condition, x).otherwise(0.0)
    out = F.greatest(static, F.coalesce(corpus.cast("double"), static))
    out = out + given(k == STRUCTURED, asked("kind")) + given(F.coalesce(meaning, F.lit(False)) | (text(enrichment) != ""), asked("meaning")) + given(text(enrichment) == "ranked_table", asked("ranked"))
    return out + given(text(relaxed).isin("", "none"), F.lit(UNRELAXED_BOOST))
