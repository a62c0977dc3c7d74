"""Operators over positions: ordinals, cyclic neighbours, parity, grids, and first-n lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..sources.tables import scratch_folder

#: Rows of a range that a global order is dealt into, and ranges at most.
ROWS = 200_000
MOST_RANGES = 4096


def value_ranges(df: DataFrame, number: Column, ranges: int | None = None) -> tuple[Column, int]:
    """(range of a value, number of ranges): ranges of about ROWS rows, cut by approximate quantiles; -1 for nulls."""
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, df.count() // ROWS + 1))
    if ranges == 1:
        return F.when(number.isNull(), -1).otherwise(0), 1
    cuts = df.agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)]).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= number)) if cuts else F.lit(0)
    return F.when(number.isNull(), -1).otherwise(part), len(cuts) + 1


def global_ordinal(df: DataFrame, lead: str, *ties: Column, name: str = "ordinal", ranges: int | None = None) -> DataFrame:
    """0-based position in the order of a column and ties, nulls first, without one global task.

    Rows are dealt into ranges of (lead, ties) together, so one value that very many rows share is
    spread by its ties, and rows that are equal in all by a random number. Ranges are cut by
    sampling, and a second sample may cut them elsewhere; so the dealt rows are written to the
    shared folder once, numbered in their range, and shifted by the sizes of the ranges before.
    """
    spark = df.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(lead), *ties]
    dealt = df.withColumn("_salt", F.rand(7)).repartitionByRange(n, *order, F.col("_salt")).sortWithinPartitions(*order).drop("_salt")
    number = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    path = scratch_folder(spark, "ordinals")
    dealt.withColumns({"_part": F.shiftright(number, 33), "_place": number.bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    held = spark.read.parquet(path)
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = held.groupBy("_part").count().select("_part", before.alias("_shift"))  # a row for each range
    return held.join(F.broadcast(shift), "_part").withColumn(name, F.col("_place") + F.coalesce("_shift", F.lit(0))).drop("_part", "_place", "_shift")


def neighbour(df: DataFrame, group: str, order: str, value: str, step: int = 1, cycle: bool = True) -> Column:
    """The next (or previous) value; past the end the first (or last) one, or the value itself."""
    w = Window.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.lead(value).over(w) if step > 0 else F.lag(value).over(w)
    edge = (F.first(value) if step > 0 else F.last(value)).over(whole) if cycle else F.col(value)
    return F.coalesce(near, edge)


def next_present(group: str, order: str, value: str) -> Column:
    """The nearest later value that is not null."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(1, Window.unboundedFollowing))


def last_wins(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row for each key: its last value, at the place of its first."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias("first_at"))


def collected_keys(df: DataFrame, doc: str, pos: str, keys: str, trim: bool = True) -> DataFrame:
    """Distinct comma-separated keys of each document, numbered from 0 by first appearance."""
    key = F.trim("k") if trim else F.col("k")
    each = df.select(doc, pos, F.posexplode(F.split(keys, ",")).alias("at", "k")).withColumn("key", key)
    first = each.groupBy(doc, "key").agg(F.min(F.struct(pos, "at")).alias("first"))
    return first.select(doc, "key", (F.row_number().over(Window.partitionBy(doc).orderBy("first")) - 1).alias("number"))


def diagram_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, y, line) of a text diagram: empty lines, and the first and last one, are left out."""
    lines = F.split(text, "\n", -1)
    return df.select(key, F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))).alias("y", "line")).filter("line <> ''")


def characters(line: Column) -> Column:
    return F.filter(F.split(line, ""), lambda c: c != "")


def quoted(line: Column, ch: Column) -> Column:
    """For each character of a line, whether an odd number of quote marks stands before it; ch is characters(line)."""
    marks = F.split(line, '"', -1)  # characters of odd pieces, and the mark that ends each, stand after an odd number
    flags = F.flatten(F.transform(marks, lambda piece, i: F.array_repeat(i % 2 == 1, F.length(piece) + 1)))
    return F.slice(flags, F.lit(1), F.length(line))  # no mark ends the last piece


def quoted_count(line: Column) -> Column:
    """How many characters of a line stand after an odd number of quote marks, without a list of flags."""
    return F.length(F.regexp_replace(line, r'[^"]*(?:"([^"]*"?)|\z)', "$1"))


def glyph_counts(text: Column) -> Column:
    """(text, space, glyph): how many characters of a text's lines are of each kind.

    Letters beside letters are text, but for v; all others than spaces are glyphs. Runs of letters
    are counted as they stand, so no character becomes a value of its own.
    """
    joined = F.regexp_replace(text, "[^a-zA-Z]+|(?<![a-zA-Z])[a-zA-Z](?![a-zA-Z])|v", "")
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" ")))
    lines = F.length(F.replace(text, F.lit("\n")))
    return F.struct(*(n.cast("long").alias(k) for k, n in (("text", F.length(joined)), ("space", spaces), ("glyph", lines - F.length(joined) - spaces))))


def _ring_batch(lines: list[str], ups: list[str | None], downs: list[str | None]) -> pa.Array:
    """For each line the list of its characters' neighbours, as texts of eight characters."""
    codes = lambda t: np.frombuffer((t or "").encode("utf-32-le"), np.uint32)
    sizes, rings = [], []
    for row in zip(ups, lines, downs, strict=True):
        n = len(row[1])
        up, own, down = padded = np.full((3, n + 2), ord(" "), np.uint32)
        for c, line in zip(padded, row, strict=True):
            beside = codes(line)[: n + 1]
            c[1 : len(beside) + 1] = beside
        sizes.append(n)
        rings.append(np.stack([up[:-2], up[1:-1], up[2:], own[:-2], own[2:], down[:-2], down[1:-1], down[2:]], axis=1))
    ring = np.concatenate(rings)
    widths = 1 + (ring > 0x7F).astype(np.uint8) + (ring > 0x7FF) + (ring > 0xFFFF)
    ends = np.cumsum(widths.sum(axis=1, dtype=np.int64), dtype=np.int64)
    data = ring.tobytes().decode("utf-32-le").encode()
    texts = pa.Array.from_buffers(pa.string(), len(ring), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), texts)


def around(lines: DataFrame, key: str) -> DataFrame:
    """(key, y, ch, ring): a line's characters, and of each its eight neighbours from top left to bottom right; a space where there is none.

    Lines meet their neighbours as texts, and are taken apart where they are read, some at a time.
    """
    w = Window.partitionBy(key).orderBy("y")
    beside = lambda f, step: F.when(f("y").over(w) == F.col("y") + step, f("line").over(w))
    rows = lines.select(key, "y", "line", beside(F.lag, -1).alias("up"), beside(F.lead, 1).alias("down"))

    def run(batches):
        for batch in slices(batches, 2, 3, 4):
            ring = _ring_batch(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ring], names=[key, "y", "line", "ring"])

    kinds = dict(lines.dtypes)
    found = rows.mapInArrow(run, f"`{key}` {kinds[key]}, y {kinds['y']}, line string, ring array<string>")
    return found.select(key, "y", characters(F.col("line")).alias("ch"), "ring")


def first_n(items: Column, n: int) -> Column:
    """(shown, rest, label): the first n joined, how many more, and their label."""
    rest = F.greatest(F.size(items) - n, F.lit(0))
    shown = F.slice(items, 1, n)
    k = F.size(shown)
    text = F.when((rest == 0) & (k > 1), F.concat(F.array_join(F.slice(shown, F.lit(1), F.greatest(k - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(shown, -1))).otherwise(F.array_join(shown, ", "))
    label = F.when(rest > 0, F.concat(rest.cast("string"), F.when(rest == 1, " more author").otherwise(" more authors")))
    return F.struct(text.alias("shown"), rest.alias("rest"), label.alias("label"))
