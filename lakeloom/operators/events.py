"""Event streams as tables: debounce, throttle, change detection, handler de-duplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, ts: str, tie: str, gap: Column) -> DataFrame:
    """Events that no other event of the key follows within the gap."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    return events.withColumn("_next", nxt).filter(F.col("_next").isNull() | (F.col("_next") > F.col(ts) + gap)).drop("_next")


def throttle(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """(key, ts) of events that come later than `seconds` after the last one let through.

    An event later than that after the one just before passes whatever was let through; there a
    key's events are cut and dealt out. Each task reads its runs of events in order, a batch at a
    time, and carries the last run and time over to the next batch, so a run may have any length.
    """
    wait = int(seconds * 1e6)
    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).filter("t is not null")
    w = Window.partitionBy(key).orderBy("t")
    cut = F.coalesce(F.col("t") - F.lag("t").over(w) > wait, F.lit(True))
    rows = rows.withColumn("_cut", cut.cast("int")).withColumn("run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_cut")
    rows = rows.repartition(key, "run").sortWithinPartitions(key, "run", "t").select(key, "t", "run")
    kind = dict(rows.dtypes)[key]

    def run(batches):
        place, last = None, None
        for batch in batches:
            times, runs, names = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0).to_pylist()
            turns = [i for i in range(1, len(names)) if runs[i] != runs[i - 1] or names[i] != names[i - 1]]
            keep = []
            for a, b in zip([0, *turns], [*turns, len(names)], strict=True) if names else []:
                if place != (names[a], runs[a]):
                    keep.append(a)
                    place, last = (names[a], runs[a]), times[a]
                while (at := a + int(np.searchsorted(times[a:b], last + wait, side="right"))) < b:
                    keep.append(at)
                    last = times[at]
            yield batch.take(pa.array(sorted(keep), pa.int64())).select([0, 1])

    return rows.mapInArrow(run, f"`{key}` {kind}, t long").select(key, F.timestamp_micros("t").alias(ts))


def debounce_changed(events: DataFrame, key: str, ts: str, tie: str, gap: Column, value: str, least: float) -> DataFrame:
    """Last events of bursts whose value differs by more than `least` from the last one let through; the key's first one passes.

    The state, one value, is carried along a key from batch to batch. It starts afresh where two
    values in a row differ by more than twice `least`: the one let through last is within `least` of
    the one before, so the second passes whatever it was. There a key's events are cut and dealt
    out. A null value never passes.
    """
    ends = debounce(events, key, ts, tie, gap).filter(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(ts, tie)
    cut = F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)) > 2 * least, F.lit(True))
    rows = ends.withColumn("_cut", cut.cast("int")).withColumn("_run", F.sum("_cut").over(w)).drop("_cut")
    names = [c for c in rows.columns if c != "_run"]
    rows = rows.repartition(key, "_run").sortWithinPartitions(key, "_run", ts, tie).select(*names, "_run")
    k, v, r = names.index(key), names.index(value), len(names)

    def run(batches):
        place, last = None, None
        for batch in batches:
            keep = []
            for i, now in enumerate(zip(batch.column(k).to_pylist(), batch.column(r).to_pylist(), batch.column(v).to_pylist(), strict=True)):
                if now[:2] != place or abs(now[2] - last) > least:
                    place, last = now[:2], now[2]
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(names)

    return rows.mapInArrow(run, events.select(*names).schema)


def changes(events: DataFrame, key: str, ts: str, tie: str, value: Column) -> DataFrame:
    """Events whose value differs from the key's event before, and the first ones."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return events.withColumn("_v", value).withColumn("_before", F.lag("_v").over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col("_v").eqNullSafe(F.col("_before"))).drop("_v", "_before", "_n")


def first_handlers(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each distinct (null-safe) registration: the first."""
    return events.groupBy(*keys).agg(F.min(order).alias("first_at"), F.count("*").alias("n"))
