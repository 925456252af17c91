"""Per-query and per-conversation jobs whose groups are bounded: memory, budgets, allocations."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_bytes(text: str, most: int) -> str:
    """The text in at most `most` UTF-8 bytes, with an ellipsis where it is cut."""
    if len(text.encode()) <= most:
        return text
    head = text.encode()[: max(0, most - 3)].decode(errors="ignore").rstrip()
    return head + "…" if most >= 3 else ""


def truncate_utf8(text: Column, most: int) -> Column:
    """cut_bytes for a column; texts that fit never leave the JVM."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: cut_bytes(t, most), na_action="ignore")

    return F.when(F.octet_length(text) <= most, text).otherwise(run(text))


def remember(df: DataFrame, conv: str, turn: str, pairs: int) -> DataFrame:
    """conv, turn, folded: whether a message is in the memory's summary. Pairs of a user and an assistant message are read greedily;
    the last `pairs` stay word for word, older ones are folded, and messages before a pair go with it."""
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(turn)
        roles, ends, i = frame["role"].tolist(), [], 0
        while i + 1 < len(roles):
            whole = roles[i] == "user" and roles[i + 1] == "assistant"
            i += 2 if whole else 1
            if whole:
                ends.append(i)
        fold = ends[-pairs - 1] if len(ends) > pairs else 0
        return pd.DataFrame({conv: frame[conv], turn: frame[turn], "folded": [k < fold for k in range(len(roles))]})

    return df.select(conv, turn, "role").groupBy(conv).applyInPandas(run, f"`{conv}` {kinds[conv]}, `{turn}` {kinds[turn]}, folded boolean")


def allocate(ranks: int, structured: Sequence[bool], budget: int, cap: int, floor: int) -> list[int]:
    """Characters for each of `ranks` items: by rank, structured ones at least `floor`; then the largest is lowered until the budget holds, structured ones last."""
    total = ranks * (ranks + 1) // 2
    out = [min(cap, max(1, budget * (ranks - i) // total)) for i in range(ranks)]
    out = [max(a, min(floor, cap)) if s else a for a, s in zip(out, structured, strict=True)]
    over = sum(out) - budget
    for group in ([i for i in range(ranks) if not structured[i]], list(range(ranks))):
        # Lowering the largest one by one ends at a common ceiling; find it by bisection, the earlier items go one lower.
        if over <= 0 or not group:
            continue
        low, high = 1, max(out[i] for i in group)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if sum(max(0, out[i] - mid) for i in group) > over else (low, mid)
        spare = over - sum(max(0, out[i] - low) for i in group)
        for i in group:
            out[i] = min(out[i], low)
        for i in group:
            if spare > 0 and out[i] == low and low > 1:
                out[i] -= 1
                spare -= 1
        over = sum(out) - budget
    return out


def allocate_characters(df: DataFrame, query: str, rank: str, structured: str, budget: int, cap: int, floor: int) -> DataFrame:
    """query, rank, characters of each item of each query."""
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(rank)
        return pd.DataFrame({query: frame[query], rank: frame[rank], "characters": allocate(len(frame), frame[structured].tolist(), budget, cap, floor)})

    return df.select(query, rank, structured).groupBy(query).applyInPandas(run, f"`{query}` {kinds[query]}, `{rank}` {kinds[rank]}, characters int")
