"""Structured Streaming jobs: late data, deduplication, limits, sessions, incremental merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terraloom.operators import star


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Event time as an instant, which watermarks ask for."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def plausible(events: DataFrame, time: str, now: Column | None = None, ahead: str = "2 days") -> DataFrame:
    """Rows whose time is not more than `ahead` after now."""
    return events.where(F.col(time) <= (now if now is not None else F.current_timestamp()) + F.expr(f"interval {ahead}"))


def counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by key and window; rows later than `late` are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return _timed(events, time).withWatermark(time, late).groupBy(*keys, window.alias("window")).agg(F.count("*").alias("n"))


def deduplicate(events: DataFrame, time: str, key: Column, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return _timed(events, time).withColumn("dedupe_key", key).withWatermark(time, late).dropDuplicatesWithinWatermark(["dedupe_key"])


def sessions(events: DataFrame, time: str, key: str, gap: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Sessions of each key, ended by a gap."""
    return _timed(events, time).withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n"))


def accept(times: list[float], recent: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which requests in time order pass a limit of `most` accepted ones in the last `seconds`, and the accepted ones that still count. Refused requests are not counted."""
    out = []
    for t in times:
        recent = [x for x in recent if x > t - seconds]
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out, recent


def limit_rate(events: DataFrame, key: str, time: str, event_id: str, most: int, seconds: float = 60.0) -> DataFrame:
    """key, event_id, accepted of a batch: a sliding-window limit for each key. Rows without a time are not accepted.

    A gap longer than the window ends a run, and what came before it no longer counts, so runs are dealt out on their own. Tasks read
    them sorted and hold a batch and the last accepted times, however long a run is.
    """
    kinds = dict(events.dtypes)
    line = W.partitionBy("key").orderBy("at", "id")
    at = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = events.select(F.col(key).alias("key"), F.col(event_id).alias("id"), at.alias("at"))
    timed = rows.where("at IS NOT NULL").withColumn("gap", F.coalesce((F.col("at") - F.lag("at").over(line) > seconds).cast("int"), F.lit(1)))
    timed = timed.withColumn("run", F.sum("gap").over(line)).drop("gap")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, []
        for frame in frames:
            passed = []
            for name, run, t in zip(frame["key"], frame["run"], frame["at"], strict=True):
                own = (None if pd.isna(name) else name, run)
                if own != last:
                    last, recent = own, []
                (good,), recent = accept([t], recent, most, seconds)
                passed.append(good)
            yield pd.DataFrame({key: frame["key"], event_id: frame["id"], "accepted": passed})

    dealt = timed.repartition("key", "run").sortWithinPartitions("key", "run", "at", "id")
    judged = dealt.mapInPandas(judge, f"`{key}` {kinds[key]}, `{event_id}` {kinds[event_id]}, accepted boolean")
    return judged.unionByName(rows.where("at IS NULL").select(F.col("key").alias(key), F.col("id").alias(event_id), F.lit(False).alias("accepted")))


def limit_rate_stream(events: DataFrame, key: str, time: str, event_id: str, most: int, seconds: float = 60.0, late: str | None = None) -> DataFrame:
    """limit_rate over a stream.

    With `late`, rows wait until the watermark has passed them and are judged in time order, so every row that is not later than that is judged as in
    a batch; a key's state goes when the watermark leaves its last window. Without, rows are judged as they arrive, in time order within a
    micro-batch, against the accepted ones up to `seconds` before and after them, and each key keeps its last accepted times.
    """
    kinds = dict(events.dtypes)
    schema = f"`{key}` {kinds[key]}, `{event_id}` {kinds[event_id]}, accepted boolean"

    def rows(name: tuple, ids: list, passed: list[bool]) -> pd.DataFrame:
        return pd.DataFrame({key: pd.Series([name[0]] * len(ids)), event_id: pd.Series(ids), "accepted": pd.Series(passed, dtype=bool)})

    def arrived(frames: Iterator[pd.DataFrame]) -> list[tuple]:
        return sorted((t.timestamp(), i) for frame in frames for t, i in zip(frame[time], frame[event_id], strict=True))

    def at_once(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, passed = list(state.get[0]) if state.exists else [], []
        new = arrived(frames)
        for t, _ in new:
            passed.append(sum(abs(t - x) < seconds for x in recent) < most)
            if passed[-1]:
                recent = sorted([*recent, t])[-most:]
        state.update((recent,))
        yield rows(name, [i for _, i in new], passed)

    def in_order(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, times, ids = map(list, state.get) if state.exists else ([], [], [])
        waiting = sorted([*zip(times, ids, strict=True), *([] if state.hasTimedOut else arrived(frames))])
        mark = state.getCurrentWatermarkMs() / 1000
        due = [x for x in waiting if x[0] <= mark]
        waiting = waiting[len(due) :]
        passed, recent = accept([t for t, _ in due], recent, most, seconds)
        recent = [t for t in recent if t > mark - seconds]
        if waiting or recent:
            state.update((recent, [t for t, _ in waiting], [i for _, i in waiting]))
            state.setTimeoutTimestamp(int(1000 * max(mark, waiting[0][0] if waiting else recent[-1] + seconds)) + 1)
        elif state.exists:
            state.remove()
        if due:
            yield rows(name, [i for _, i in due], passed)

    slim = _timed(events.select(key, event_id, time), time)
    if late is None:
        return slim.groupBy(key).applyInPandasWithState(at_once, schema, "recent array<double>", "append", GroupStateTimeout.NoTimeout)
    state = f"recent array<double>, times array<double>, ids array<{kinds[event_id]}>"
    return slim.withWatermark(time, late).groupBy(key).applyInPandasWithState(in_order, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def merge_batches(read_target: Callable[[], DataFrame], write_target: Callable[[DataFrame], None], key: list[str], period: str, mode: str = "late_ok", lag: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts each micro-batch; running a batch again gives the same target."""

    def merge(batch: DataFrame, _: int) -> None:
        write_target(star.upsert(read_target(), batch, key, period, mode, lag))

    return merge
