"""Structured Streaming forms of the event operators. Event times must be TIMESTAMP, not NTZ."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, ts): the last event of each burst; bursts are parted by more than the gap."""
    held = events.withWatermark(ts, late)
    return held.groupBy(key, F.session_window(ts, gap)).agg(F.max(ts).alias(ts)).select(key, ts)


def throttle(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """(key, ts) of events later than `seconds` after the key's last one let through; state is one time."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        times = sorted(int(t) for f in frames for t in f["_t"])
        out = []
        for t in times:
            if last is None or t - last > seconds * 1e6:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(out), "t": out})

    kind = dict(events.dtypes)[key]
    rows = events.select(key, F.unix_micros(ts).alias("_t"))
    kept = rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t long", "last long", "append", GroupStateTimeout.NoTimeout)
    return kept.select(key, F.timestamp_micros("t").alias(ts))


def gated(left: DataFrame, right: DataFrame, key: str, ts: str, wait: str = "1 hour") -> DataFrame:
    """Rows once both sides of a key have arrived within the wait."""
    a = left.withWatermark(ts, wait).alias("a")
    b = right.withWatermark(ts, wait).withColumnRenamed(key, "_key").withColumnRenamed(ts, "_ts").alias("b")
    return a.join(b, F.expr(f"{key} = _key and _ts between {ts} - interval {wait} and {ts} + interval {wait}")).drop("_key")


def changes(events: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """(key, tie) of events whose value's digest differs from the key's event before, and the first ones.

    State is one digest a key. Within a micro-batch events are taken in the order of ts and tie;
    later batches are later.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for digest, at in pd.concat(list(frames)).sort_values(["_t", tie])[["_d", tie]].itertuples(index=False):
            if digest != last:
                out.append(at)
                last = digest
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(out), tie: out})

    kinds = dict(events.dtypes)
    rows = events.select(key, tie, F.unix_micros(ts).alias("_t"), F.md5(F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("_d"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {tie} {kinds[tie]}", "last string", "append", GroupStateTimeout.NoTimeout)


def one_shot(events: DataFrame, keys: list[str], ts: str, order: str, late: str = "1 hour") -> DataFrame:
    """(keys, first_at): one row for each registration, its least `order` among the events of the batch it comes with.

    State is a mark for each registration. It goes, and a registration may fire again, only when the
    watermark has passed its last event by `late` once more.
    """
    wait = int(pd.Timedelta(late).total_seconds() * 1000)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        fresh = not state.exists
        state.update((True,))
        state.setTimeoutTimestamp(max(int(rows["_t"].max()), state.getCurrentWatermarkMs()) + wait + 1)
        if fresh:
            yield pd.DataFrame({**{f"k{i}": [v] for i, v in enumerate(name)}, "first_at": [rows[order].min()]})

    kinds = dict(events.dtypes)
    rows = events.withWatermark(ts, late).select(*keys, ts, order, F.unix_millis(ts).alias("_t"))
    held = rows.groupBy(*keys).applyInPandasWithState(step, ", ".join([*(f"k{i} {kinds[k]}" for i, k in enumerate(keys)), f"first_at {kinds[order]}"]), "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return held.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "first_at")
