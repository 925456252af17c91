"""Corpus preparation: guards, structure, chunks, claims, deduplication."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.functions import text as tx

#: Trend words, and percentages with sign and year-on-year mark.
RISE = r"\b(increas(?:e|ed|es|ing)|ris(?:e|es|ing|en)|grew|growth|up(?:ward)?|higher|improv(?:e|ed|es|ing)|surge(?:d|s)?|climb(?:ed|s|ing)?|gain(?:ed|s|ing)?|expand(?:ed|s|ing)?)\b"
FALL = r"\b(decreas(?:e|ed|es|ing)|declin(?:e|ed|es|ing)|drop(?:ped|s|ping)?|fall(?:s|ing|en)?|fell|down(?:ward)?|lower|reduc(?:e|ed|es|ing)|shrink(?:s|ing)?|slump(?:ed|s)?|contract(?:ed|s|ing)?|worsen(?:ed|s|ing)?)\b"
STABLE = r"\b(stable|unchanged|flat|steady|stagnant|plateau(?:ed)?|no\s+change|remain(?:ed|s|ing)?\s+(?:the\s+same|stable|flat))\b"
PERCENT = r"([+\-−–]?)\s*(\d+(?:\.\d+)?)\s*(?:%|percent(?:age)?(?:\s+points?)?|pp)(?:\s*(yoy|year[- ]on[- ]year|year[- ]over[- ]year))?"

#: How any of the four begins: a text without it states no trend.
STATES = r"(?i)\b(?:c(?:limb|ontract)|d(?:ecreas|eclin|rop|own)|expand|f(?:all|ell|lat)|g(?:rew|rowth|ain)|higher|i(?:ncreas|mprov)|lower|no\s+change|plateau|r(?:is[ei]|educ|emain)|s(?:urge|hrink|lump|table|teady|tagnant)|u(?:p\b|pward|nchanged)|worsen)|\d\s*(?:%|pp|percent)"


def binary_text(text: Column, head: int = 800) -> Column:
    """Whether a text is bytes of a file: a known magic prefix, or many control or replacement characters in its head."""
    start = F.substring(F.coalesce(text, F.lit("")), 1, head)
    magic = start.rlike(r"^(?:%PDF-|PK\x03\x04|\x89PNG|GIF8|\xFF\xD8\xFF|ÿØÿ)")
    return magic | (F.regexp_count(start, F.lit(r"[\x00-\x08\x0E-\x1F]")) >= 10) | (F.regexp_count(start, F.lit("�")) >= 40)


def pick_published(sources: Sequence[tuple[str, Column, float]], now: str, ahead: int = 2) -> Column:
    """struct(published_at, source, confidence) of the first source with a date that is at most `ahead` days after now."""
    out = None
    for name, value, sure in sources:
        date = tx.iso_date(value)
        good = date.isNotNull() & (F.to_date(date) <= F.date_add(F.lit(now).cast("date"), ahead))
        row = F.struct(date.alias("published_at"), F.lit(name).alias("source"), F.lit(sure).alias("confidence"))
        out = F.when(good, row) if out is None else out.when(good, row)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("published_at"), F.lit("missing").alias("source"), F.lit(0.0).alias("confidence")))


def good_body(text: Column, gates: Sequence[str], least: int = 200) -> Column:
    """Whether a body is long enough and no consent gate."""
    t = F.coalesce(text, F.lit(""))
    out = F.length(t) >= least
    for g in gates:
        out &= ~F.contains(F.lower(t), F.lit(g.lower()))
    return out


def changed(old: DataFrame, new: DataFrame, id_col: str, value: str) -> DataFrame:
    """id, old and new value where a recomputed value differs, nulls compared as values."""
    a, b = old.select(id_col, F.col(value).alias(f"old_{value}")), new.select(id_col, F.col(value).alias(f"new_{value}"))
    return a.join(b, id_col).where(~F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}")))


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, block, text: the paragraphs of each text, numbered from 0."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n\s*\n|\n"), tx.squeeze), lambda p: p != "")
    return df.select(id_col, F.posexplode(parts).alias("block", "text"))


def heading_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, block, path, text of Markdown-like texts: the headings above a paragraph joined by ' > '. One pass over the lines of a text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame[id_col], frame[text_col], strict=True):
                stack: list[tuple[int, str]] = []
                block = 0
                for line in (text or "").splitlines():
                    if m := re.match(r"(#{1,6})\s+(.*\S)", line):
                        stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2])]
                    elif line.strip():
                        out.append((key, block, " > ".join(t for _, t in stack), " ".join(line.split())))
                        block += 1
            yield pd.DataFrame(out, columns=[id_col, "block", "path", "text"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, block int, path string, text string")


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


def split_chunks(text: str, target: int, overlap: int) -> list[str]:
    """Sentences packed to at most `target` tokens; a new chunk starts with the last words of the one before, up to `overlap` tokens; longer sentences are split between words."""

    def tail(chunk: str) -> list[str]:
        words, length = [], 0
        for w in reversed(chunk.split()):
            length += len(w) + 1
            if length // 4 > overlap:
                break
            words.append(w)
        return words[::-1]

    def pack(units: list[str]) -> list[str]:
        made: list[str] = []
        now: list[str] = []
        length = -1
        for u in units:
            if now and (length + 1 + len(u)) // 4 > target:
                made.append(" ".join(now))
                now = tail(made[-1])
                length = sum(map(len, now)) + len(now) - 1
                if (length + 1 + len(u)) // 4 > target:
                    now, length = [], -1
            now.append(u)
            length += 1 + len(u)
        return [*made, " ".join(now)] if now else made

    out: list[str] = []
    group: list[str] = []
    for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]:
        if _tokens(s) <= target:
            group.append(s)
        else:
            out += pack(group) + pack(s.split())
            group = []
    return out + pack(group)


def text_slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `size` bytes of a text column, so that what is made of them doesn't grow with the batch; a longer text is a slice."""
    start = held = 0
    for row, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if row > start and held + n > size:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def chunk(df: DataFrame, id_col: str, text_col: str, target: int = 400, overlap_percent: int = 15, cap: int | None = None) -> DataFrame:
    """id, chunk_index, total_chunks, text: whole texts cut to chunks, at most `cap` for a document where that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                rows, index, total, out = [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    parts = split_chunks(text or "", target, target * overlap_percent // 100)[:cap]
                    rows += [row] * len(parts)
                    index += range(len(parts))
                    total += [len(parts)] * len(parts)
                    out += parts
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(out, pa.string())], [id_col, "chunk_index", "total_chunks", "text"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, total_chunks int, text string")


def states_trend(text: Column) -> Column:
    """Whether a text may state a trend, in one pass; the patterns that read it are for those texts alone."""
    return F.coalesce(text, F.lit("")).rlike(STATES)


def claims(text: Column) -> dict[str, Column]:
    """direction, magnitude and unit of the trend a text states; all null if it states none. The earlier of two directions counts."""
    t = F.trim(F.coalesce(text, F.lit("")))
    at = lambda p: F.regexp_instr(t, F.lit("(?i)" + p))
    rise, fall, stable = at(RISE), at(FALL), at(STABLE)
    words = F.when((rise > 0) & ((fall == 0) | (rise <= fall)), "increasing").when(fall > 0, "decreasing").when(stable > 0, "stable").otherwise("unknown")
    sign, number, yearly = (F.regexp_extract(t, "(?i)" + PERCENT, i) for i in (1, 2, 3))
    value = number.try_cast("double")
    magnitude = F.when(number != "", F.when(sign.isin("-", "−", "–"), -value).when((sign == "") & (words == "decreasing"), -value).otherwise(value))
    direction = F.when((words == "unknown") & (magnitude < 0), "decreasing").when((words == "unknown") & (magnitude > 0), "increasing").otherwise(words)
    usable = (direction != "unknown") | magnitude.isNotNull()
    unit = F.when(number != "", F.when(yearly != "", "pct_yoy").otherwise("pct"))
    found = {"direction": F.when(usable, direction), "magnitude": magnitude, "unit": unit}
    return {name: F.when(states_trend(text), value) for name, value in found.items()}


def greedy_dedup(df: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """id, duplicate_of: in id order, a row that shares a key with an earlier canonical row is its duplicate; only canonical rows register keys.

    Rounds decide rows: the least undecided row of all its keys is canonical, and rows that share a key with it are duplicates, of the
    owner of their first taken key in the order of `keys`. Null keys match nothing. The rows left shrink in every round.
    """
    from terraloom.operators.state import cut

    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(k).cast("string").alias("key")) for i, k in enumerate(keys)])
    rows = cut(df.select(F.col(id_col).alias("id"), F.filter(slots, lambda s: s["key"].isNotNull()).alias("keys")))
    spread = lambda df, name: df.select(F.col("id").alias(name), F.explode("keys").alias("k")).select(name, F.col("k.slot").alias("slot"), F.col("k.key").alias("key"))
    left, canonical = rows, None
    while True:
        long = spread(left, "id")
        least = long.groupBy("slot", "key").agg(F.min("id").alias("least"))
        later = long.join(least, ["slot", "key"]).where("id <> least").select("id").distinct()
        fresh = cut(left.join(later, "id", "left_anti"))
        canonical = fresh if canonical is None else canonical.unionByName(fresh)
        shared = long.join(spread(fresh, "owner"), ["slot", "key"]).select("id")
        left = cut(left.join(shared.unionByName(fresh.select("id")).distinct(), "id", "left_anti"))
        if left.isEmpty():
            break
    hits = spread(rows, "id").join(spread(canonical, "owner"), ["slot", "key"]).where("owner < id").groupBy("id").agg(F.min(F.struct("slot", "owner")).alias("hit"))
    return rows.join(hits, "id", "left").select(F.col("id").alias(id_col), F.col("hit.owner").alias("duplicate_of"))


def cluster_id(title: Column, country: Column, domain: Column, day: Column) -> Column:
    """One id for the articles of a title, country, domain and day."""
    parts = [F.substring(tx.normalize_title(title), 1, 120), F.lower(F.coalesce(country, F.lit(""))), F.lower(F.coalesce(domain, F.lit(""))), F.coalesce(day, F.lit("unknown"))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def recent_history(df: DataFrame, conv: str, turn: str, pairs: int, cap: int) -> DataFrame:
    """The last 2 x pairs messages of a conversation within `cap` characters (role + text + 4 each): the oldest go two by two, the last ones singly."""
    size = F.length("role") + F.length("text") + 4
    back = W.partitionBy(conv).orderBy(F.desc(turn))
    rows = df.select("*", F.row_number().over(back).alias("_back"), F.sum(size).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_run")).where(F.col("_back") <= 2 * pairs)
    whole = W.partitionBy(conv)
    rows = rows.select("*", F.count("*").over(whole).alias("_n"), F.max(F.when(F.col("_run") <= cap, F.col("_back"))).over(whole).alias("_fit"))
    # Removing two at a time keeps the parity of the window; only a single last message is dropped alone.
    keep = F.when(F.coalesce("_fit", F.lit(0)) >= F.col("_n"), F.col("_n")).when((F.col("_n") - F.col("_fit")) % 2 == 0, F.col("_fit")).otherwise(F.greatest(F.col("_fit") - 1, F.lit(0)))
    keep = F.when((keep == 0) & (F.col("_fit") >= 1) & (F.col("_n") % 2 == 1), 1).otherwise(keep)
    return rows.where(F.col("_back") <= F.coalesce(keep, F.lit(0))).drop("_back", "_run", "_n", "_fit")


def semantic_breaks(df: DataFrame, doc: str, order: str, vector: str, percent: float = 95.0) -> DataFrame:
    """doc, order, similarity to the row before, and the number of the group a row is in: a new one starts where the similarity is at most the percentile of the document's."""
    w = W.partitionBy(doc).orderBy(order)
    dot = F.aggregate(F.zip_with(vector, "_before", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    rows = df.select(doc, order, vector, F.lag(vector).over(w).alias("_before"))
    rows = rows.select(doc, order, F.round(F.try_divide(dot, norm(vector) * norm("_before")), 6).alias("similarity"))
    cutoff = F.percentile("similarity", percent / 100).over(W.partitionBy(doc))
    rows = rows.withColumn("_cut", F.when(F.col("similarity") <= cutoff, 1).otherwise(0))
    return rows.select(doc, order, "similarity", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("group"))


def places(text: Column, names: Sequence[str], cap: int = 12) -> Column:
    """Names that a text mentions before its references, most mentions first (ties by longer name, then by the given order), at most `cap`;
    with more than three candidates, only those mentioned twice or more. Meant for a short list, such as countries."""
    head = F.split(F.coalesce(text, F.lit("")), r"(?im)^\s*references\s*$", 2)[0]
    counted = tx.keyword_scores(head, {n: [n] for n in sorted(names, key=lambda n: (-len(n), list(names).index(n)))})
    kept = F.when(F.size(counted) > 3, F.filter(counted, lambda c: c["score"] >= 2)).otherwise(counted)
    return F.slice(F.transform(kept, lambda c: c["name"]), 1, cap)
